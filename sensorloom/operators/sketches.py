"""Mergeable sketches: one row per key or window, built in one pass, stored, and merged upwards.

A quantile sketch (KLL) tells any percentile to within a rank error; a distinct sketch
(HyperLogLog) tells how many different values there were. Both combine partially before the
shuffle and merge without another look at the raw rows, so hours add up to days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a quantile sketch: some 25 bytes for each unit, whatever the number of rows.
QUANTILE_SIZE = 1024
# Bits of a distinct sketch's register number.
DISTINCT_BITS = 12


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """The rank error of a quantile sketch as a share of the rows, kept in 99 of 100 sketches."""
    return 2.296 / size**0.9723


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """The standard error of a distinct sketch, relative."""
    return 1.04 / 2 ** (bits / 2)


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, size: int = QUANTILE_SIZE) -> DataFrame:
    """Keys, ``rows`` (those with a value) and ``sketch``. NaN counts as a row but is not in the sketch."""
    x = F.col(value).cast("double")
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan(x), x), size)
    return df.filter(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), sketch.alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], size: int = QUANTILE_SIZE) -> DataFrame:
    """Sketches of finer keys as sketches of coarser ones."""
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def quantile(sketch: Column | str, p: Column | float) -> Column:
    """The estimate at a rank from 0 to 1; NULL for a sketch of no numbers."""
    column = F.col(sketch) if isinstance(sketch, str) else sketch
    rank = F.lit(float(p)) if isinstance(p, (int, float)) else p
    return F.when(F.kll_sketch_get_n_double(column) > 0, F.kll_sketch_get_quantile_double(column, rank))


def distinct_sketches(df: DataFrame, keys: Sequence[str | Column], value: str, bits: int = DISTINCT_BITS) -> DataFrame:
    """Keys, ``rows`` and ``sketch`` of the different values."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(value, bits).alias("sketch"))


def merged_distincts(sketches: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def distincts(sketch: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch)
