"""State of one reading: congestion, occupancy, vital-sign rules, machine wear."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import ALERT_ORDER, CLAMPS, SEPSIS_SIGNS, Rule


def congestion(vehicles: Column, speed: Column) -> Column:
    return (
        F.when((vehicles > 80) & (speed < 25), "HIGH")
        .when((vehicles > 50) & (speed < 40), "MEDIUM")
        .otherwise("LOW")
    )


def occupancy_rate(occupied: Column, total: Column) -> Column:
    return F.round(F.try_divide(occupied.cast("double"), total.cast("double")) * 100, 2)


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` kept within the limits; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def clamp_vital(name: str) -> Column:
    low, high = CLAMPS[name]
    return clamp(F.col(name), low, high)


def breaks(rule: Rule) -> Column:
    value = F.col(rule.metric)
    tests = []
    if rule.low is not None:
        tests.append(value < F.lit(rule.low))
    if rule.high is not None:
        tests.append(value > F.lit(rule.high))
    test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return F.coalesce(test, F.lit(False))


def sepsis() -> Column:
    signs = [breaks(s) for s in SEPSIS_SIGNS]
    return signs[0] & signs[1] & signs[2] & signs[3]


def raised(rules: Sequence[Rule]) -> Column:
    """Whether any rule fires."""
    return reduce(lambda a, b: a | b, [breaks(r) for r in rules])


def alert_labels(rules: Sequence[Rule], with_sepsis: bool = False) -> Column:
    """Labels of the rules that fire, in rule order. Plain functions only, no lambda per element."""
    found = [F.when(breaks(r), F.lit(r.label)).otherwise(F.lit("")) for r in rules]
    if with_sepsis:
        found.append(F.when(sepsis(), F.lit("Sepsis Risk")).otherwise(F.lit("")))
    return F.array_remove(F.array(*found), "")


def alert_entries(rules: Sequence[Rule]) -> Column:
    """Array of (label, metric, value), one entry per rule; the label is NULL where it does not fire."""
    return F.array(
        *[
            F.struct(
                F.when(breaks(r), F.lit(r.label)).alias("label"),
                F.lit(r.metric).alias("metric"),
                F.col(r.metric).alias("value"),
            )
            for r in rules
        ]
    )


def leading_alert(labels: Column) -> Column:
    """The most pressing label present, NULL when there is none."""
    return F.coalesce(*[F.when(F.array_contains(labels, x), F.lit(x)) for x in ALERT_ORDER])


def machine_status(wear: Column, anomalous: Column) -> dict[str, Column]:
    return {
        "operational": wear < 0.95,
        "alert_level": F.when(anomalous & (wear > 0.7), "CRITICAL")
        .when(anomalous, "WARNING")
        .otherwise("NORMAL"),
        "remaining_life_hours": ((F.lit(1.0) - wear) * 1000).cast("int"),
        "efficiency_percent": F.greatest(F.lit(50.0), F.lit(100.0) - wear * 30),
    }
