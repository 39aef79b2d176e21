"""Grouped aggregates. All combine partially before the shuffle, so hot groups stay cheap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import condition


def with_occupancy(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "occupancy_rate", condition.occupancy_rate(F.col("occupied_spots"), F.col("total_spots"))
    )


def sensor_measures(exact_sensors: bool = False) -> list[Column]:
    """Measures of one sensor window. Exact distinct counts are for tables; streams estimate."""
    sensors = F.count_distinct("sensor_id") if exact_sensors else F.approx_count_distinct("sensor_id")
    return [
        F.count(F.lit(1)).alias("message_count"),
        sensors.alias("unique_sensors"),
        *[F.avg(c).alias(f"avg_{n}") for c, n in _AVERAGED.items()],
        *[F.max(c).alias(f"max_{n}") for c, n in _PEAKED.items()],
    ]


# Measured column and output suffix.
_AVERAGED = {
    "vehicle_count": "vehicle_count",
    "average_speed_kmh": "speed",
    "aqi": "aqi",
    "pm25": "pm25",
    "pm10": "pm10",
    "occupancy_rate": "parking_occupancy",
}
_PEAKED = {"vehicle_count": "vehicle_count", "aqi": "aqi", "occupancy_rate": "parking_occupancy"}


def windowed_sensors(
    df: DataFrame,
    ts: str = "ts",
    width: str = "30 seconds",
    slide: str | None = None,
    watermark: str | None = None,
    exact_sensors: bool = False,
) -> DataFrame:
    """Sensor measures per time window, sensor type and city.

    With a watermark the same code runs on a stream and drops rows older than it.
    """
    if watermark:
        df = df.withWatermark(ts, watermark)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = df.groupBy(window.alias("w"), "sensor_type", "city").agg(*sensor_measures(exact_sensors))
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *grouped.columns[1:]
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], *newest_by: str) -> DataFrame:
    """The newest row of every key, as one aggregation: no per-key sort, so no hot task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*newest_by))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def peak(df: DataFrame, keys: Sequence[str], x: str, at: str) -> DataFrame:
    """Largest value per key and the first position it occurs at."""
    first = F.struct(F.col(x).alias("x"), (-F.unix_micros(F.col(at).cast("timestamp"))).alias("earlier"))
    return df.groupBy(*keys).agg(F.max(x).alias("peak"), F.max_by(at, first).alias("peak_at"))


def summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum, one row per key and metric.

    All metrics are aggregated in one pass; only the result is turned into rows.
    """
    aggs = []
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                *[F.col(f"{m}_{s}").cast("double").alias(s) for s in ("mean", "std", "min", "max")],
            )
            for m in metrics
        ]
    )
    return wide.select(*keys, F.inline(rows))


def histogram(df: DataFrame, keys: Sequence[str], x: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between each key's extremes, the last bin closed, empty bins included.

    A key with a single value gets a range of one around it.
    """
    keys, seen = list(keys), df.filter(F.col(x).isNotNull())
    single = F.when(F.min(x) == F.max(x), 0.5).otherwise(0.0)
    limits = seen.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        (F.min(x) - single).alias("_lo"), (F.max(x) + single).alias("_hi")
    )
    width = F.col("_hi") - F.col("_lo")
    slot = F.least(F.floor((F.col(x) - F.col("_lo")) / width * bins), F.lit(bins - 1))
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    filled = (
        seen.join(limits, match)
        .groupBy(*keys, "_lo", "_hi", slot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # A key has at most ``bins`` counts; they meet in one row, which is spread over all bins.
    counts = filled.groupBy(*keys, "_lo", "_hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "rows"))).alias("_counts"))
    return (
        counts.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .withColumn("rows", F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0).cast("bigint")))
        .select(
            *keys,
            "bin",
            (F.col("_lo") + width * F.col("bin") / bins).alias("bin_from"),
            (F.col("_lo") + width * (F.col("bin") + 1) / bins).alias("bin_to"),
            "rows",
        )
    )


def sla_report(df: DataFrame, keys: Sequence[str], latency: str, sla: float) -> DataFrame:
    late = F.col(latency) > sla
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(late).alias("violations"),
        (F.avg(late.cast("double")) * 100).alias("violation_pct"),
        F.avg((~late).cast("double")).alias("compliance"),
    )


def drop_rate(df: DataFrame, keys: Sequence[str], total: str, dropped: str) -> DataFrame:
    lost, seen = F.sum(dropped), F.sum(total)
    return df.groupBy(*keys).agg(
        seen.alias("total_messages"),
        lost.alias("dropped_messages"),
        (lost / F.greatest(F.lit(1), seen) * 100).alias("drop_pct"),
    )


def prediction_outcome(
    df: DataFrame,
    keys: Sequence[str],
    action: str = "action",
    rate: str = "workload_rate",
    burst: str = "burst_probability",
    executors: str = "current_executors",
) -> DataFrame:
    """Pre-warm decisions that paid off, that were wasted, and cold starts that were missed."""
    warmed = F.col(action) == "pre_warm"
    busy = F.col(rate) > 100
    useful = busy | (F.col(burst) > 0.6)
    counts = df.groupBy(*keys).agg(
        F.count_if(warmed).alias("prewarms"),
        F.count_if(warmed & useful).alias("avoided"),
        F.count_if(warmed & ~useful).alias("wasted"),
        F.count_if(~warmed & busy & (F.col(executors) <= 1)).alias("missed"),
    )
    hits = F.try_divide(F.col("avoided"), F.col("avoided") + F.col("wasted"))
    return counts.withColumn("accuracy", F.coalesce(hits, F.lit(0.0)))


def temperature(
    df: DataFrame,
    key: str,
    ts: str,
    as_of: str,
    frequency_weight: float,
    recency_weight: float,
    burst_reads: int = 3,
) -> DataFrame:
    """Access temperature per key: a weighted sum of daily frequency and recency.

    Frequency is rows per day between the first access and ``as_of``; recency is one over
    the hours since the last access. A key read ``burst_reads`` times on the last day is
    bursting. Rows after ``as_of`` have not happened yet and are left out at the scan.
    """
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    stats = df.filter(F.col(ts) <= F.lit(as_of).cast(df.schema[ts].dataType)).groupBy(key).agg(
        F.count(F.lit(1)).alias("accesses"),
        F.min(at).alias("_first"),
        F.max(at).alias("_last"),
        F.count_if(now - at <= 86_400_000_000).alias("_last_day"),
    )
    days = (now - F.col("_first")) / F.lit(86.4e9)
    hours = (now - F.col("_last")) / F.lit(3.6e9)
    score = F.lit(frequency_weight) * F.try_divide(F.col("accesses"), days) + F.lit(
        recency_weight
    ) * F.try_divide(F.lit(1.0), hours)
    return stats.select(key, "accesses", score.alias("score"), (F.col("_last_day") >= burst_reads).alias("burst"))
