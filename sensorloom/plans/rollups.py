"""Queries over stored sketches: built once from the raw rows, merged upwards, refined where an exact value is wanted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quantiles, sketches
from ..session import prepare
from ..sinks.files import stored
from ..sources import views
from . import policies  # noqa: F401  its SQL is taken over
from .registry import ORACLE, query
from .shape import neutral

PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("latency_percentiles_refined", ORACLE["latency_percentiles"])
def latency_percentiles_refined(spark, folder):
    """Sketches per policy and scenario merged to policies, then exact percentiles."""
    runs = views.policy_runs(prepare(spark), folder)
    fine = stored(sketches.quantile_sketches(runs, ["policy", "scenario"], "latency_ms"), "latency_sketches")
    merged = sketches.merged_quantiles(fine, ["policy"])
    return neutral(quantiles.percentiles(runs, ["policy"], "latency_ms", PROBS, merged))


def _times(spark, folder):
    """Event times in microseconds: a range that is narrow for its size."""
    ev = views.events(prepare(spark), folder).filter("ts IS NOT NULL")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select("event_type", at.alias("us"), F.date_trunc("hour", "ts").alias("hour"))


@query(
    "event_time_ranks",
    """SELECT event_type, max(n) AS rows, max(CASE WHEN rn = floor(0.5E0 * n) + 1 THEN us END) AS p50,
              max(CASE WHEN rn = floor(0.95E0 * n) + 1 THEN us END) AS p95, max(CASE WHEN rn = floor(0.99E0 * n) + 1 THEN us END) AS p99
       FROM (SELECT event_type, CAST(epoch_us(ts) AS DOUBLE) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn,
                    count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE ts IS NOT NULL) r GROUP BY event_type""",
)
def event_time_ranks(spark, folder):
    """The moments by which half, 95 % and 99 % of each type's events had come; hourly sketches merged."""
    times = _times(spark, folder)
    hourly = stored(sketches.quantile_sketches(times, ["event_type", "hour"], "us"), "time_sketches")
    return quantiles.nearest_ranks(times, ["event_type"], "us", PROBS, sketches.merged_quantiles(hourly, ["event_type"]))


@query(
    "event_time_estimates",
    """SELECT level, event_type, bucket, count(*) AS rows, TRUE AS within FROM (
         SELECT 'hour' AS level, event_type, date_trunc('hour', ts) AS bucket FROM events WHERE ts IS NOT NULL
         UNION ALL SELECT 'day', event_type, date_trunc('day', ts) FROM events WHERE ts IS NOT NULL
         UNION ALL SELECT 'all', event_type, NULL FROM events WHERE ts IS NOT NULL) l GROUP BY ALL""",
)
def event_time_estimates(spark, folder):
    """The merged estimate of each level's 95th percentile, and whether its rank is within the stated error."""
    times = _times(spark, folder)
    hourly = stored(sketches.quantile_sketches(times, ["event_type", "hour"], "us"), "time_sketches")
    levels = _levels(hourly, lambda rows: sketches.merged_quantiles(rows, ["event_type", "bucket"]))
    told = levels.select("level", "event_type", "bucket", "rows", sketches.quantile("sketch", 0.95).alias("p95"))
    ranked = _by_level(times).join(told, _same_bucket(), "inner").groupBy(*[told[c] for c in ("level", "event_type", "bucket", "rows")]).agg(
        F.count_if(F.col("us") < F.col("p95")).alias("below"), F.count_if(F.col("us") <= F.col("p95")).alias("upto")
    )
    slack = F.greatest(F.lit(1.0), 2 * sketches.rank_error() * F.col("rows"))
    within = (F.col("below") <= 0.95 * F.col("rows") + slack) & (F.col("upto") >= 0.95 * F.col("rows") - slack)
    return neutral(ranked.select("level", "event_type", "bucket", "rows", within.alias("within")))


def _levels(hourly: DataFrame, merge) -> DataFrame:
    """Sketches by hour, day and altogether: each level is merged from the one below it."""
    by_hour = hourly.withColumnRenamed("hour", "bucket")
    by_day = merge(by_hour.withColumn("bucket", F.date_trunc("day", "bucket")))
    whole = merge(by_day.withColumn("bucket", F.lit(None).cast(by_day.schema["bucket"].dataType)))
    parts = [part.withColumn("level", F.lit(name)) for name, part in (("hour", by_hour), ("day", by_day), ("all", whole))]
    return reduce(DataFrame.unionByName, parts)


def _by_level(rows: DataFrame) -> DataFrame:
    """Each raw row once for every level, for checks of the estimates."""
    none = F.lit(None).cast("timestamp")
    buckets = F.array(
        F.struct(F.lit("hour").alias("_level"), F.col("hour").alias("_bucket")),
        F.struct(F.lit("day").alias("_level"), F.date_trunc("day", "hour").alias("_bucket")),
        F.struct(F.lit("all").alias("_level"), none.alias("_bucket")),
    )
    return rows.select("*", F.inline(buckets)).withColumnRenamed("event_type", "_type")


def _same_bucket():
    return F.expr("level = _level AND event_type <=> _type AND bucket <=> _bucket")


@query(
    "distinct_rollup",
    """SELECT level, event_type, bucket, count(*) AS rows, count(DISTINCT user_id) AS users, TRUE AS within FROM (
         SELECT 'hour' AS level, event_type, date_trunc('hour', ts) AS bucket, user_id FROM events WHERE ts IS NOT NULL
         UNION ALL SELECT 'day', event_type, date_trunc('day', ts), user_id FROM events WHERE ts IS NOT NULL
         UNION ALL SELECT 'all', event_type, NULL, user_id FROM events WHERE ts IS NOT NULL) l GROUP BY ALL""",
)
def distinct_rollup(spark, folder):
    """Users per hour, day and altogether from hourly sketches, and whether each is within three standard errors."""
    ev = views.events(prepare(spark), folder).filter("ts IS NOT NULL")
    rows = ev.select("event_type", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    levels = user_levels(rows)
    told = levels.select("level", "event_type", "bucket", "rows", sketches.distincts("sketch").alias("estimate"))
    exact = _by_level(rows).groupBy("_level", "_type", "_bucket").agg(F.count_distinct("user_id").alias("users"))
    off = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), 3 * sketches.distinct_error() * F.col("users"))
    return neutral(told.join(exact, _same_bucket()).select("level", "event_type", "bucket", "rows", "users", off.alias("within")))


def user_levels(rows: DataFrame) -> DataFrame:
    """Distinct sketches of users by hour, day and altogether; the raw rows are read once."""
    hourly = stored(sketches.distinct_sketches(rows, ["event_type", "hour"], "user_id"), "user_sketches")
    return _levels(hourly, lambda finer: sketches.merged_distincts(finer, ["event_type", "bucket"]))
