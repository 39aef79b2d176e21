"""Derived time columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference of two epoch-microsecond columns, in seconds."""
    return (later - earlier) / F.lit(1e6)


def bucket(ts: Column, unit: str = "hour") -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hour_cycle(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the time of day, to the minute."""
    angle = F.lit(2 * math.pi) * (F.hour(ts) + F.minute(ts) / F.lit(60.0)) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def is_rush_hour(ts: Column) -> Column:
    hour = F.hour(ts)
    return hour.between(7, 9) | hour.between(17, 19)


def is_daytime(ts: Column) -> Column:
    return F.hour(ts).between(6, 20)


def is_business_hour(ts: Column) -> Column:
    """9 to 17 inclusive, Monday to Friday."""
    return F.hour(ts).between(9, 17) & (F.weekday(ts) < 5)
