"""Dimension lookups, presence checks and the as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions


# Settings are broadcast, and written into the plan.
MOST_SCENARIOS = 1000


def route(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds ``target_topic``; topics that are not mapped go to the unknown topic."""
    dim = dimensions.topic_map(df.sparkSession).withColumnRenamed("topic", "_topic")
    return (
        df.join(F.broadcast(dim), F.col(topic) == F.col("_topic"), "left")
        .drop("_topic")
        .withColumn("target_topic", F.coalesce("target_topic", F.lit(dimensions.UNKNOWN_TOPIC)))
    )


def with_scenario(df: DataFrame, name: Column, settings: list[tuple] | None = None) -> DataFrame:
    """Adds ``scenario``, ``alpha``, ``beta``, ``gamma``; an unknown name takes the default.

    ``settings`` is a list in the caller's memory; more names than ``MOST_SCENARIOS`` are refused.
    """
    if len(settings or ()) > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} scenarios")
    dim = dimensions.scenarios(df.sparkSession, settings)
    known = [s[0] for s in settings or dimensions.SCENARIOS]
    chosen = F.when(name.isin(known), name).otherwise(F.lit(dimensions.DEFAULT_SCENARIO))
    return df.withColumn("scenario", chosen).join(F.broadcast(dim), "scenario", "left")


def with_every_scenario(df: DataFrame, settings: list[tuple] | None = None) -> DataFrame:
    """Each row once per scenario with that scenario's weights: a fixed expansion, not a join."""
    weights = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"), *[F.lit(w).alias(n) for n, w in zip(_WEIGHTS, values)]
            )
            for name, *values in settings or dimensions.SCENARIOS
        ]
    )
    return df.select("*", F.inline(weights))


_WEIGHTS = ("alpha", "beta", "gamma")


def with_tier(df: DataFrame, tier_id: str, codec_id: str) -> DataFrame:
    """Adds price and access time of the tier, size ratio and decode time of the codec."""
    spark = df.sparkSession
    tier = dimensions.tiers(spark).select(F.col("tier_id").alias(tier_id), "store", "price", "access_ms")
    codec = dimensions.codecs(spark).select(F.col("codec_id").alias(codec_id), "size_ratio", "decode_ms")
    return df.join(F.broadcast(tier), tier_id, "left").join(F.broadcast(codec), codec_id, "left")


def present(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return expected.join(seen.select(key).distinct(), key, "left_semi")


def missing(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return expected.join(seen.select(key).distinct(), key, "left_anti")


def retained(
    df: DataFrame, ts: str, as_of: str, topic: str = "target_topic", default_days: int | None = None
) -> DataFrame:
    """Rows young enough for their topic's retention.

    Topics without a policy keep ``default_days``, or never expire when it is None. With a
    default no row can be older than the longest retention; that bound reaches the scan.
    """
    kind = df.schema[ts].dataType
    now = F.lit(as_of).cast("timestamp")

    def cutoff(days: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(now) - days.cast("bigint") * 86_400_000_000).cast(kind)

    dim = dimensions.topic_policy(df.sparkSession).select(
        F.col("target_topic").alias("_topic"), cutoff(F.col("retention_days")).alias("_cutoff")
    )
    keep = F.col(ts) >= F.col("_cutoff")
    if default_days is None:
        keep = F.col("_cutoff").isNull() | keep
    else:
        longest = max(default_days, *[days for _, _, days, _, _ in dimensions.TOPIC_POLICY])
        df = df.filter(F.col(ts) >= cutoff(F.lit(longest)))
        keep = F.col(ts) >= F.coalesce("_cutoff", cutoff(F.lit(default_days)))
    joined = df.join(F.broadcast(dim), F.col(topic) == F.col("_topic"), "left")
    return joined.filter(keep).drop("_topic", "_cutoff")


def against_baseline(
    summary: DataFrame, groups: Sequence[str], policy: str, baseline: str, metrics: Sequence[str]
) -> DataFrame:
    """Puts the baseline policy's metrics beside every policy of the same group.

    Works on the aggregated summary: a window partition holds one row per policy.
    """
    w = Window.partitionBy(*groups)
    is_base = F.col(policy) == baseline
    return summary.withColumns({f"base_{m}": F.max(F.when(is_base, F.col(m))).over(w) for m in metrics})


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    slice_seconds: int = 3600,
    salts: int = 4,
) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time.

    Both sides are cut into (key, time slice) groups, and the left rows of a group are
    spread over ``salts`` parts that each see all right rows of the slice. So neither a hot
    key nor a hot slice ends in one task, at the price of ``salts`` copies of the right
    side, which is meant to be the thinner one. Each part also gets, as its first entry, the
    newest right row of the earlier slices; that one is found on a table of one row per
    part. Then the newest right row is carried forward inside the part. The left rows
    shuffle once, and there is no inequality join.
    """
    keys, group = list(keys), [*keys, "_slice"]
    cut = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slice_seconds).alias("_slice")
    signal = F.struct(F.col(ts).alias("at"), *columns)
    kept = right.dropna(subset=[*keys, ts]).select(*keys, F.col(ts), cut, signal.alias("_signal"))
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int").alias("_salt")
    rows = left.select(*keys, F.col(ts), cut, salt, F.struct(*left.columns).alias("_row"))
    copies = kept.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))

    newest = kept.groupBy(*group).agg(F.max("_signal").alias("_newest"))
    parts = rows.select(*group, "_salt").distinct().unionByName(newest, allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = F.last("_newest", ignorenulls=True).over(earlier)
    first_entries = (
        parts.withColumn("_signal", carried)
        .filter(F.col("_salt").isNotNull() & F.col("_signal").isNotNull())
        .select(*group, "_salt", F.col("_signal.at").alias(ts), "_signal")
    )

    upto = (
        Window.partitionBy(*group, "_salt")
        .orderBy(ts, F.col("_signal").isNull(), "_signal")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    entries = copies.unionByName(first_entries)
    return (
        rows.unionByName(entries, allowMissingColumns=True)
        .withColumn("_found", F.last("_signal", ignorenulls=True).over(upto))
        .filter(F.col("_row").isNotNull())
        .select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])
    )
