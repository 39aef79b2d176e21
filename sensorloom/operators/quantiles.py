"""Exact order statistics per key, without gathering a key in one task.

Two scans, whatever the size. The first counts rows per key and cell, a cell being a narrow
range of a monotone scale of the value; running totals over the cells of a key tell which cells
hold the wanted ranks. The second counts the distinct values in those cells only, and running
totals inside a cell find the values. Counts combine before every shuffle, so neither a key that
holds a third of the rows nor one value that most rows share meets in one task, and rows tied
on a value cost one entry. The cells only narrow the search: the value returned is exact.

With quantile sketches of the keys, stored or merged from finer ones, the cells follow the data: the range that
a sketch leaves for a wanted rank is cut into ``PIECES``, and what lies between two such ranges is one cell.
So values that differ in their last digits only are still told apart. Nothing depends on the sketch being
right: if a rank lies outside its range, the larger cell there is looked into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.files import stored
from .sketches import QUANTILE_SIZE, quantile, rank_error

# Cells per unit of the logarithmic scale: neighbouring cells differ by 1 part in CELLS, and values
# below UNIT are told apart in steps of UNIT / CELLS.
CELLS = 16_384
UNIT = 1e-6
# Rank error of an estimate is at most one part in this.
ACCURACY = 10_000
# Cells in the range of a wanted rank, and how far the range goes beyond the rank, in the sketch's rank errors.
PIECES = 256
MARGIN = 3.5


def _cell(x: str) -> Column:
    """A number that never falls as the value rises. NaN, which sorts last, has a cell of its own."""
    return F.expr(f"rint(signum({x}) * log1p(abs({x}) / {UNIT!r}D) * {CELLS}D)")


def _edges(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float], size: int) -> DataFrame:
    """Keys as ``_of_{key}`` and ``_edges``: the sorted ends of the ranges that hold the wanted ranks.

    Written, because a sketch that is built or merged twice differs a little and both scans need the same cells.
    """
    reach = MARGIN * rank_error(size)
    ends = [quantile("sketch", min(1.0, max(0.0, p + way * reach))) for p in probs for way in (-1, 1)]
    edges = sketches.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.sort_array(F.array(*ends)).alias("_edges"))
    return stored(edges, "rank_edges")


def _cell_between(x: str, count: int) -> Column:
    """The number of the range that a value lies in, times PIECES, and the piece of it."""
    edge = [F.get(F.col("_edges"), i) for i in range(count)]
    value, region, piece = F.col(x), F.lit(0), F.lit(0)
    for i in range(count):
        region = region + F.coalesce((value >= edge[i]).cast("int"), F.lit(0))
        if i + 1 < count:
            share = (value - edge[i]) / F.nullif(edge[i + 1] - edge[i], F.lit(0.0))
            inside = (value >= edge[i]) & (value < edge[i + 1])
            cut = F.when(share.between(0.0, 1.0), F.least(F.floor(share * PIECES), F.lit(PIECES - 1)).cast("int"))
            piece = F.when(inside, F.coalesce(cut, F.lit(0))).otherwise(piece)
    return (region * PIECES + piece).cast("double")


def _at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Sequence[tuple[str, str]],
    probs: Sequence[float] = (),
    sketches: DataFrame | None = None,
    size: int = QUANTILE_SIZE,
) -> DataFrame:
    """One row per key: ``_n`` and, for rank pair i, the values ``_a{i}`` and ``_b{i}`` at its ranks.

    ``ranks`` holds pairs of zero-based ranks as SQL expressions of the row count ``_n``.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    if sketches is None:
        rows = rows.withColumn("_cell", _cell("_x"))
    else:  # a key that the sketches lack has one cell
        same = " AND ".join([f"`{k}` <=> `_of_{k}`" for k in keys])
        edges = _edges(sketches, keys, probs, size)
        rows = rows.join(edges, F.expr(same), "left").select(*keys, "_x", _cell_between("_x", 2 * len(probs)).alias("_cell"))

    of_key = Window.partitionBy(*keys)
    upto = of_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    wanted = [r for pair in ranks for r in pair]
    held = " OR ".join(f"(_upto - _c <= CAST({r} AS BIGINT) AND CAST({r} AS BIGINT) < _upto)" for r in wanted)
    cells = (
        rows.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(of_key)})
        .filter(held)
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_cell").alias("_at"), "_n", F.expr("_upto - _c AS _below"))
    )
    # NULL keys match each other; the cells to look into are few and broadcast by their measured size.
    match = " AND ".join(["_cell <=> _at", *[f"`{k}` <=> `_key_{k}`" for k in keys]])
    values = (
        rows.join(cells, F.expr(match))
        .groupBy(*keys, "_cell", "_below", "_n", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("_upto", F.col("_below") + F.sum("_c").over(inside))
    picks = []
    for i, pair in enumerate(ranks):
        for name, rank in zip(("_a", "_b"), pair):
            there = f"_upto - _c <= CAST({rank} AS BIGINT) AND CAST({rank} AS BIGINT) < _upto"
            picks.append(F.expr(f"max(if({there}, _x, NULL)) AS {name}{i}"))
    return placed.groupBy(*keys, "_n").agg(*picks)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    sketches: DataFrame | None = None,
    size: int = QUANTILE_SIZE,
) -> DataFrame:
    """Exact percentiles with linear interpolation. Columns: keys, ``rows``, one per name.

    ``sketches`` are the keys' quantile sketches of that ``size``, for values of a narrow range; they are read at
    once, by a job that writes a row per key. Without them no job runs before the rows are asked for.
    """
    position = [f"((_n - 1) * {p!r}D)" for p in probs.values()]
    ranks = [(f"floor({h})", f"least(floor({h}) + 1, _n - 1)") for h in position]
    found = _at_ranks(df, keys, value, ranks, [*probs.values()], sketches, size)
    between = [
        f"_a{i} + (_b{i} - _a{i}) * ({h} - floor({h})) AS {name}"
        for i, (name, h) in enumerate(zip(probs, position))
    ]
    return found.selectExpr(*keys, "_n AS rows", *between)


def nearest_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    sketches: DataFrame | None = None,
    size: int = QUANTILE_SIZE,
) -> DataFrame:
    """The value at zero-based position ``floor(p * n)`` of the sorted values. ``sketches`` as in ``percentiles``."""
    at = [f"least(floor({p!r}D * _n), _n - 1)" for p in probs.values()]
    found = _at_ranks(df, keys, value, [(r, r) for r in at], [*probs.values()], sketches, size)
    picked = [f"_a{i} AS {name}" for i, name in enumerate(probs)]
    return found.selectExpr(*keys, "_n AS rows", *picked)


def approx_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """One-pass estimate for dashboards, rank error at most 1 / accuracy."""
    sketch = F.approx_percentile(value, [float(p) for p in probs.values()], accuracy)
    named = [F.col("_s")[i].alias(name) for i, name in enumerate(probs)]
    return df.groupBy(*keys).agg(sketch.alias("_s")).select(*keys, *named)
