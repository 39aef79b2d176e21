"""Time-series features per key.

Input contract: one row per key and time bucket, as ``rate_series`` makes it. The raw
rows meet only a partial aggregation, so a key that holds a third of all messages costs
no more here than any other: a window partition has at most (time span / bucket) rows,
whatever the data volume. Do not feed raw messages to the window functions below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import timeparts

HISTORY = 300
REFRESH_EVERY = 50
MIN_SAMPLES = 5
TREND_SPAN = 10


def rate_series(df: DataFrame, keys: Sequence[str], ts: str = "ts", unit: str = "hour") -> DataFrame:
    """Messages per key and time bucket: columns ``keys``, ``bucket``, ``n``."""
    return (
        df.select(*keys, timeparts.bucket(F.col(ts), unit).alias("bucket"))
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def in_order(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def last_rows(keys: Sequence[str], order: str, n: int) -> WindowSpec:
    return in_order(keys, order).rowsBetween(-(n - 1), 0)


def so_far(keys: Sequence[str], *order: str) -> WindowSpec:
    return in_order(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def velocity(df: DataFrame, keys: Sequence[str], ts: str, x: str) -> DataFrame:
    """Adds ``sample_no``, ``step`` (new velocity or NULL), ``step_no``, ``velocity``, ``acceleration``.

    A step needs time to have passed; on equal times the newest velocity persists.
    """
    w, upto = in_order(keys, ts), so_far(keys, ts)
    seconds = timeparts.seconds_between(timeparts.micros(F.col(ts)), timeparts.micros(F.lag(ts).over(w)))
    change = F.col(x) - F.lag(x).over(w)
    before = in_order(keys, ts).rowsBetween(Window.unboundedPreceding, -1)
    of_step = in_order(keys, "step_no").rangeBetween(Window.currentRow, Window.currentRow)
    return (
        df.withColumns({"sample_no": F.row_number().over(w), "step": F.when(seconds > 0, change / seconds)})
        .withColumns(
            {
                "step_no": F.count("step").over(upto),
                "velocity": F.coalesce(F.last("step", ignorenulls=True).over(upto), F.lit(0.0)),
                "_turn": F.when(
                    F.col("step").isNotNull(), F.col("step") - F.last("step", ignorenulls=True).over(before)
                ),
            }
        )
        .withColumn("_rise", (F.col("_turn") > 0).cast("int"))
        .withColumn("acceleration", F.coalesce(F.max("_turn").over(of_step), F.lit(0.0)))
    )


def rising(moves: DataFrame, keys: Sequence[str], span: int = TREND_SPAN) -> DataFrame:
    """Adds ``rising_share`` to the output of ``velocity``: rising steps among the last ``span`` velocities."""
    recent = in_order(keys, "step_no").rangeBetween(-(span - 2), 0)
    rises = F.coalesce(F.sum("_rise").over(recent), F.lit(0))
    return moves.withColumn("rising_share", rises / F.nullif(F.least(F.col("step_no"), F.lit(span)) - 1, F.lit(0)))


def rolling(df: DataFrame, keys: Sequence[str], ts: str, x: str, rows: int = HISTORY) -> DataFrame:
    """Adds mean and population deviation of the last ``rows`` samples."""
    w = last_rows(keys, ts, rows)
    return df.withColumns({"rolling_mean": F.avg(x).over(w), "rolling_std": F.stddev_pop(x).over(w)})


def threshold(
    moves: DataFrame,
    keys: Sequence[str],
    percentile: float = 0.9,
    history: int = HISTORY,
    every: int = REFRESH_EVERY,
) -> DataFrame:
    """Adds ``burst_threshold`` to the output of ``velocity``.

    The threshold is a percentile of the newest ``history`` velocities. It is taken when
    the fifth velocity arrives and again at every ``every``-th sample, and holds in
    between. Blocks of ``every`` samples begin with such a sample, so a block's rows share one
    threshold, and it is the blocks that look back, not the rows.
    """
    step_no, is_step = F.col("step_no"), F.col("step").isNotNull()
    others = [c for c in moves.columns if c not in keys]
    blocks = moves.groupBy(*keys, F.floor(F.col("sample_no") / every).alias("_block")).agg(
        F.collect_list(F.struct(*others)).alias("_rows"),
        F.collect_list(F.when(is_step, F.struct("step_no", "step"))).alias("_steps"),
        F.min("step_no").alias("_first"),
        F.max("step_no").alias("_last"),
        F.min(F.when(is_step & (step_no == MIN_SAMPLES), F.col("sample_no"))).alias("_warm_at"),
    )
    # Up to which step the block's threshold looks: its first row's, or the fifth if that comes within the block.
    begins_due = F.col("_first") >= MIN_SAMPLES
    upto = F.when(begins_due, F.col("_first")).when(F.col("_warm_at").isNotNull(), MIN_SAMPLES)
    near = in_order(keys, "_last").rangeBetween(-(history + every), 0)
    recent = F.flatten(F.collect_list(F.when(F.size("_steps") > 0, F.col("_steps"))).over(near))
    newest = F.filter("_recent", lambda s: s["step_no"].between(F.col("_upto") - history + 1, F.col("_upto")))
    ordered = F.sort_array(F.transform(newest, lambda s: s["step"]))
    # An array of one, so that the list is sorted once.
    level = F.transform(F.array(ordered), lambda v: sorted_percentile(v, percentile))[0]
    holds = begins_due | (F.col("sample_no") >= F.col("_warm_at"))
    return (
        blocks.withColumns({"_recent": recent, "_upto": upto})
        .withColumn("_level", F.when(F.col("_upto").isNotNull(), level))
        .select(*keys, "_first", "_warm_at", "_level", F.inline("_rows"))
        .select(*moves.columns, F.when(holds, F.col("_level")).alias("burst_threshold"))
    )


def sorted_percentile(values: Column, p: float) -> Column:
    """Linear interpolation between the two nearest entries of a sorted array."""
    at = (F.size(values) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    below = F.get(values, low)
    above = F.coalesce(F.get(values, low + 1), below)
    return below + (above - below) * (at - low)


def burst_probability(moves: DataFrame) -> DataFrame:
    """Adds ``burst_probability`` to the output of ``rising`` and ``threshold``.

    A logistic of velocity over threshold, blended with the share of rising steps.
    """
    ratio = F.col("velocity") / F.col("burst_threshold")
    logistic = 1 / (1 + F.exp(-5 * (ratio - 1)))
    blended = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * logistic + 0.4 * F.col("rising_share")))
    ready = (F.col("step_no") >= MIN_SAMPLES) & (F.col("burst_threshold") > 0)
    return moves.withColumn("burst_probability", F.when(ready, blended).otherwise(0.0))


def traffic_features(
    df: DataFrame, keys: Sequence[str], ts: str, x: str, history: int = HISTORY
) -> DataFrame:
    """The seven features of every sample; all zero until a key has five samples."""
    moves = velocity(rolling(df, keys, ts, x, history), keys, ts, x)
    full = burst_probability(threshold(rising(moves, keys), keys, history=history))
    sin, cos = timeparts.hour_cycle(F.col(ts))
    warm = F.col("sample_no") >= MIN_SAMPLES
    names = ["velocity", "acceleration", "rolling_mean", "rolling_std", "burst_probability"]
    gated = {n: F.when(warm, F.col(n)).otherwise(0.0) for n in names}
    gated |= {"hour_sin": F.when(warm, sin).otherwise(0.0), "hour_cos": F.when(warm, cos).otherwise(0.0)}
    return full.withColumns(gated)


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def burst_zscore(
    df: DataFrame, keys: Sequence[str], ts: str, x: str, rows: int = 20, min_samples: int = 3
) -> DataFrame:
    """Adds ``burst_zscore`` from mean and deviation, both kept to one decimal."""
    w = last_rows(keys, ts, rows)
    mean, std = F.bround(F.avg(x).over(w), 1), F.bround(F.stddev_pop(x).over(w), 1)
    score = F.round(clip01((F.col(x) - mean) / (std + 1e-9) * 0.3), 2)
    enough = F.row_number().over(in_order(keys, ts)) >= min_samples
    return df.withColumn("burst_zscore", F.when(enough, score).otherwise(0.0))


def burst_velocity_ratio(
    df: DataFrame, keys: Sequence[str], ts: str, x: str, rows: int, gain: float, name: str
) -> DataFrame:
    """Adds ``name``: the last change against the recent deviation; zero below three samples."""
    w = last_rows(keys, ts, rows)
    change = F.col(x) - F.lag(x).over(in_order(keys, ts))
    score = clip01(change / (F.stddev_pop(x).over(w) + 1) * gain)
    enough = F.row_number().over(in_order(keys, ts)) >= 3
    return df.withColumn(name, F.when(enough, score).otherwise(0.0))


def moving_forecast(df: DataFrame, keys: Sequence[str], ts: str, x: str, rows: int = 5) -> DataFrame:
    return df.withColumn("forecast", F.avg(x).over(last_rows(keys, ts, rows)))


def moving_smooth(df: DataFrame, keys: Sequence[str], ts: str, x: str, rows: int = 10) -> DataFrame:
    """Moving average over full windows only; the first ``rows - 1`` rows of a key drop out."""
    w = last_rows(keys, ts, rows)
    return (
        df.withColumns({"smoothed": F.avg(x).over(w), "_rows": F.count(F.lit(1)).over(w)})
        .filter(F.col("_rows") == rows)
        .drop("_rows")
    )


def lookahead(df: DataFrame, keys: Sequence[str], ts: str, x: str, steps: int = 10) -> DataFrame:
    """Adds the value ``steps`` rows ahead, NULL at the tail."""
    return df.withColumn("future", F.lead(x, steps).over(in_order(keys, ts)))


def trend_sign(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    w = in_order(keys, order)
    return df.withColumns(
        {f"{c}_trend": F.coalesce(F.signum(F.col(c) - F.lag(c).over(w)), F.lit(0.0)) for c in columns}
    )


def idle_runs(
    df: DataFrame, keys: Sequence[str], ts: str, x: str, below: float = 20.0, timeout: int = 60
) -> DataFrame:
    """Unbroken runs of samples below a level, and how often each run reaches the timeout."""
    keys = list(keys)
    idle = F.col(x) < below
    all_rows = F.row_number().over(in_order(keys, ts))
    idle_rows = F.row_number().over(Window.partitionBy(*keys, "_idle").orderBy(ts))
    return (
        df.withColumns({"_idle": idle, "_row": all_rows})
        .withColumn("_run", F.col("_row") - idle_rows)
        .filter("_idle")
        .groupBy(*keys, "_run")
        .agg(
            F.min(ts).alias("run_start"),
            F.max(ts).alias("run_end"),
            F.count(F.lit(1)).alias("steps"),
        )
        .withColumn("timeouts", F.floor(F.col("steps") / timeout))
        .drop("_run")
    )


def idle_timeouts(
    df: DataFrame, keys: Sequence[str], ts: str, x: str, until: Column, step: str = "1 minute", timeout: int = 60, below: float = 20.0
) -> DataFrame:
    """(keys, run_start, nth, fired_at): every ``timeout`` steps that a key stays idle, up to the moment ``until``.

    A step is idle if its sample is below the level or if there is none. Only busy samples and
    the first one bound a run, so the window sees these and no step is made up.
    """
    keys, width = list(keys), F.expr(f"INTERVAL {step}")
    span = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {step}) * {timeout}")
    busy = ~F.coalesce(F.col(x) < below, F.lit(False))
    dated = df.filter(F.col(ts).isNotNull() & (F.col(ts) <= until)).withColumn(ts, F.col(ts).cast("timestamp"))
    bounds = dated.filter(busy).select(*keys, (F.col(ts) + width).alias("run_start"), F.col(ts).alias("_end"))
    first = dated.groupBy(*keys).agg(F.min(ts).alias("run_start")).withColumn("_end", F.lit(None).cast("timestamp"))
    runs = bounds.unionByName(first)
    of_key = Window.partitionBy(*keys).orderBy("run_start", F.col("_end").isNotNull())
    end = F.coalesce(F.lead("_end").over(of_key), until.cast("timestamp"))
    times = F.floor((F.unix_micros(end) - F.unix_micros("run_start")) / span)
    counted = runs.withColumn("_times", times).filter("_times > 0")
    fired = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")))
    at = F.timestamp_micros(F.unix_micros("run_start") + F.col("nth") * span)
    return fired.select(*keys, "run_start", "nth", at.alias("fired_at"))


def ma_crossover(
    df: DataFrame, keys: Sequence[str], ts: str, x: str, short_s: int = 5, long_s: int = 60, factor: float = 1.5
) -> DataFrame:
    """Adds short and long averages over time ranges, and the signal that the short one runs ahead."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    base = Window.partitionBy(*keys).orderBy(at)
    return df.withColumns(
        {
            "short_avg": F.avg(x).over(base.rangeBetween(-short_s, 0)),
            "long_avg": F.avg(x).over(base.rangeBetween(-long_s, 0)),
        }
    ).withColumn("burst_signal", (F.col("short_avg") > F.col("long_avg") * factor).cast("int"))


def series_diagnostics(df: DataFrame, keys: Sequence[str], ts: str, x: str) -> DataFrame:
    """State of each key's history at its newest sample."""
    keys = list(keys)
    moves = threshold(velocity(df, keys, ts, x), keys)
    oldest = F.first(ts).over(last_rows(keys, ts, HISTORY))
    newest = moves.withColumn("_oldest", oldest)
    picked = F.max_by(F.struct(ts, "_oldest", "sample_no", "step_no", "burst_threshold"), F.col("sample_no"))
    return (
        newest.groupBy(*keys)
        .agg(picked.alias("s"))
        .select(
            *keys,
            F.least(F.col("s.sample_no"), F.lit(HISTORY)).cast("bigint").alias("samples"),
            F.least(F.col("s.step_no"), F.lit(HISTORY)).alias("velocity_samples"),
            F.col("s.burst_threshold").alias("velocity_threshold"),
            timeparts.seconds_between(
                timeparts.micros(F.col(f"s.{ts}")), timeparts.micros(F.col("s._oldest"))
            ).alias("span_seconds"),
        )
    )


def tail_stats(df: DataFrame, keys: Sequence[str], ts: str, x: str, rows: int = 20) -> DataFrame:
    """Mean and deviation of the newest ``rows`` samples of each key."""
    keys = list(keys)
    newest_first = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return (
        df.withColumn("_back", F.row_number().over(newest_first))
        .filter(F.col("_back") <= rows)
        .groupBy(*keys)
        .agg(
            F.avg(x).alias("tail_mean"),
            F.stddev_pop(x).alias("tail_std"),
            F.count(F.lit(1)).alias("tail_rows"),
        )
    )


def backlog(df: DataFrame, keys: Sequence[str], ts: str, arrivals: str, capacity: int) -> DataFrame:
    """Queue length behind a fixed capacity.

    With S the running sum of (arrivals - capacity), the queue is S minus the lowest value
    S has had so far (at most zero), so two window sums replace a row-by-row simulation.
    """
    upto = so_far(keys, ts)
    gap = F.col(arrivals) - F.lit(capacity)
    return (
        df.withColumn("_sum", F.sum(gap).over(upto))
        .withColumn("backlog", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
        .withColumns(
            {
                "dropped": F.greatest(F.lit(0), gap),
                "queued_before_drain": F.coalesce(F.lag("backlog").over(in_order(keys, ts)), F.lit(0))
                + F.greatest(F.lit(0), gap),
            }
        )
        .withColumn("latency_estimate_ms", 100 + 2 * F.col("queued_before_drain"))
        .drop("_sum")
    )
