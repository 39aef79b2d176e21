"""Decoding of message envelopes: identity, payload kind, topic patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*names: str) -> Column:
    """First value that is neither NULL nor an empty string."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def device_ref(prefix: str = "") -> Column:
    return first_filled(*[prefix + n for n in ("sensor_id", "device_id", "machine_id")])


def device_kind(prefix: str = "") -> Column:
    return first_filled(*[prefix + n for n in ("sensor_type", "device_type", "machine_type")])


def event_time(text: Column) -> Column:
    """ISO text to a timestamp in the session zone (pinned to UTC); unreadable text gives NULL."""
    return F.try_to_timestamp(text)


def payload_kind(prefix: str = "") -> Column:
    """The first payload block that is present: metrics, vitals, sensors, else none."""
    kind = F.lit("none")
    for block in ("sensors", "vitals", "metrics"):
        kind = F.when(F.col(prefix + block).isNotNull(), F.lit(block)).otherwise(kind)
    return kind


def first_entries(entries: Column, n: int = 3) -> Column:
    """First ``n`` map entries in message order, as ``key=value`` text."""
    pairs = F.slice(F.map_entries(entries), 1, n)
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def topic_regex(pattern: str) -> str:
    """Anchored regex of a broker subscription: ``+`` is one level, a final ``#`` is any tail."""
    levels = pattern.split("/")
    tail = ""
    if levels[-1] == "#":
        levels = levels[:-1]
        if not levels:
            return "^.*$"
        tail = "(/.*)?"
    body = "/".join("[^/]+" if level == "+" else re.escape(level) for level in levels)
    return f"^{body}{tail}$"


def topic_matches(topic: Column, pattern: str) -> Column:
    if "+" not in pattern and "#" not in pattern:
        return topic == F.lit(pattern)
    return topic.rlike(topic_regex(pattern))


def topic_level(topic: Column, level: int) -> Column:
    """Zero-based topic level, NULL when the topic is shorter."""
    return F.get(F.split(topic, "/"), level)


def partition_of(key: Column, partitions: int = 8) -> Column:
    """Stable partition number of a key: equal keys share one. Any engine with MD5 gives the same."""
    head = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (head % partitions).cast("int")
