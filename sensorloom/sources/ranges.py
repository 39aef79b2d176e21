"""Bounded reads of a log by offset ranges, and whether anything is missing from them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .topics import SourceConfig, read_topics


@dataclass(frozen=True)
class OffsetRange:
    """The offsets from ``first`` up to but not including ``end`` of one partition of a topic."""

    topic: str
    partition: int
    first: int
    end: int

    def __post_init__(self) -> None:
        if not 0 <= self.first <= self.end:
            raise ValueError(f"no range of offsets: {self}")


class MissingOffsets(ValueError):
    """Offsets that a range should hold are not there any more, or not yet."""


def offsets_json(ranges: Iterable[OffsetRange], end: bool) -> str:
    """The start or end offsets as the log connector takes them."""
    told: dict[str, dict[str, int]] = {}
    for r in ranges:
        if str(r.partition) in told.setdefault(r.topic, {}):
            raise ValueError(f"two ranges of {r.topic}, partition {r.partition}")
        told[r.topic][str(r.partition)] = r.end if end else r.first
    return json.dumps(told, sort_keys=True)


def within(ranges: Sequence[OffsetRange]) -> Column:
    """Rows of the ranges. Files skip what lies outside the lowest and highest offset, and partitions and topics not asked for."""
    full = [r for r in ranges if r.first < r.end]
    if not full:
        return F.lit(False)
    offset, by_bounds = F.col("offset"), {}
    for r in full:  # partitions that share their bounds share a condition
        by_bounds.setdefault((r.topic, r.first, r.end), []).append(r.partition)
    own = [
        (F.col("topic") == topic) & F.col("partition").isin(*parts) & (offset >= first) & (offset < end)
        for (topic, first, end), parts in by_bounds.items()
    ]
    return (offset >= min(r.first for r in full)) & (offset < max(r.end for r in full)) & reduce(Column.__or__, own)


def read_ranges(spark: SparkSession, config: SourceConfig, ranges: Sequence[OffsetRange], on_loss: str = "raise") -> DataFrame:
    """The rows of the ranges, once. ``on_loss`` is "raise", which looks for missing offsets first, or "ignore"."""
    if on_loss not in ("raise", "ignore"):
        raise ValueError("on_loss is raise or ignore")
    if config.format == "kafka":
        topics = tuple(dict.fromkeys(r.topic for r in ranges))
        bounded = replace(config, topics=topics, topic_pattern=None, first_offsets=offsets_json(ranges, False), ending_offsets=offsets_json(ranges, True))
        rows = read_topics(spark, replace(bounded, fail_on_data_loss=on_loss == "raise"))
    else:
        rows = read_topics(spark, replace(config, topics=(), topic_pattern=None)).filter(within(ranges))
    return complete(rows, ranges) if on_loss == "raise" else rows


def losses(rows: DataFrame, ranges: Sequence[OffsetRange]) -> DataFrame:
    """(topic, partition, expected, found, missing): a row for each range. Offsets that come twice are found once.

    Offsets are counted as bits of 32,768 at a time, which combine in each task, so neither a partition that holds
    most rows nor a repeated offset costs more than its bits. A log that is compacted lacks offsets by nature.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(r.topic, r.partition, r.first, r.end) for r in ranges], "topic string, partition int, first bigint, end bigint")
    bits = rows.filter(within(ranges)).groupBy("topic", "partition", F.bitmap_bucket_number("offset").alias("_bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("offset"))).alias("_found")
    )
    found = bits.groupBy(F.col("topic").alias("_topic"), F.col("partition").alias("_partition")).agg(F.sum("_found").alias("_found"))
    # A topic and partition may be asked for in one range only, so the sums are those of the ranges.
    met = asked.join(found, F.expr("topic = _topic AND partition = _partition"), "left")
    expected, there = F.col("end") - F.col("first"), F.coalesce("_found", F.lit(0).cast("bigint"))
    return met.select("topic", "partition", expected.alias("expected"), there.alias("found"), (expected - there).alias("missing"))


def complete(rows: DataFrame, ranges: Sequence[OffsetRange]) -> DataFrame:
    """The rows, or an error that names what is missing from which partition."""
    lost = losses(rows, ranges).filter("missing > 0").orderBy("topic", "partition").collect()
    if lost:
        told = ", ".join(f"{r.topic}/{r.partition}: {r.missing} of {r.expected}" for r in lost[:20])
        raise MissingOffsets(f"offsets are missing in {len(lost)} ranges: {told}")
    return rows
