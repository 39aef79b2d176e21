"""Capacity decisions and storage tiers, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_regime(rate: Column, cpu: Column) -> Column:
    return (
        F.when((rate < 20) & (cpu < 15), "NIGHT_IDLE")
        .when((rate > 400) & (cpu > 80), "TRAFFIC_BURST")
        .when(rate.between(100, 300), "BUSINESS_HOURS")
        .otherwise("NORMAL")
    )


def tier_label(rate: Column) -> Column:
    return F.when(rate > 250, "HOT").when(rate > 100, "WARM").otherwise("COLD")


def misplaced(temperature: Column, tier_id: Column) -> Column:
    """Hot data in a cold tier."""
    return (temperature > 0.7) & (tier_id > 1)


def temperature_route(score: Column, burst: Column, hot: float = 0.8, warm: float = 0.3) -> Column:
    return F.when(burst | (score > hot), "HOT").when(score > warm, "WARM").otherwise("COLD")


def fixed_capacity(rate: Column, executors: int, per_executor: int = 50) -> dict[str, Column]:
    """What a fixed pool does with the arriving rate."""
    capacity = F.lit(executors * per_executor)
    used = rate / F.greatest(capacity, F.lit(1)).cast("double")
    return {
        "utilisation": used,
        "pool_latency_ms": F.greatest(F.lit(60), (100 + used * 800).cast("int")),
        "processed": F.least(rate, capacity.cast("double")),
        "overloaded": used > 1,
    }


# Per case of the recommendation its action and confidence.
CASES = {
    "idle": ("scale_down", 0.95),
    "quiet": ("scale_down", 0.85),
    "burst": ("pre_warm", 0.92),
    "edge": ("pre_warm", 0.90),
    "busy": ("scale_up", 0.88),
    "late": ("scale_up", 0.85),
    "frugal": ("scale_down", 0.75),
    "frugal_floor": ("maintain", 0.0),
    "steady": ("maintain", 0.80),
}
# The limits that tell the cases apart, and how many executors a case adds.
LIMITS = {
    "idle_cpu": 20,
    "busy_cpu": 80,
    "burst_probability": 0.6,
    "edge_signal": 0.5,
    "weight": 0.5,
    "late_ms": 1000,
    "frugal_share": 0.7,
    "rate_per_executor": 50,
}
ADDED = {"burst": 4, "busy": 2, "late": 3}
EDGE_FACTOR = 2.5


def _decision(case: str, target: Column) -> Column:
    action, confidence = CASES[case]
    return F.struct(
        F.lit(action).alias("action"),
        target.cast("int").alias("target"),
        F.lit(confidence).alias("confidence"),
    )


def recommendation(
    rate: Column,
    cpu: Column,
    latency_ms: Column,
    current: Column,
    burst_probability: Column,
    velocity: Column,
    edge_signal: Column,
    alpha: Column,
    beta: Column,
    low: float = 20.0,
    high: float = 200.0,
    max_executors: int = 50,
    velocity_over: float = 5.0,
) -> Column:
    """First matching case as (action, target, confidence)."""
    at = LIMITS

    def more(case: str) -> Column:
        return current + ADDED[case]

    def capped(target: Column) -> Column:
        return F.least(F.lit(max_executors), target)

    halved = F.greatest(F.lit(1), F.floor(current / 2))
    one_less = F.greatest(F.lit(1), current - 1)
    needed = F.greatest((rate / at["rate_per_executor"]).cast("int"), more("busy"))
    frugal = (alpha > at["weight"]) & (rate < high * at["frugal_share"])
    cases = [
        ("idle", (rate < low) & (cpu < at["idle_cpu"]), F.lit(0)),
        ("quiet", rate < low * 2, halved),
        ("burst", (burst_probability > at["burst_probability"]) & (velocity > velocity_over), capped(more("burst"))),
        ("edge", edge_signal > at["edge_signal"], capped((current * EDGE_FACTOR).cast("int"))),
        ("busy", (rate > high) | (cpu > at["busy_cpu"]), capped(needed)),
        ("late", (beta > at["weight"]) & (latency_ms > at["late_ms"]), capped(more("late"))),
        ("frugal", frugal & (one_less < current), one_less),
        ("frugal_floor", frugal, current),
    ]
    chosen = F
    for case, holds, target in cases:
        chosen = chosen.when(holds, _decision(case, target))
    return chosen.otherwise(_decision("steady", current))


def mode_target(rate: Column, mode: str, max_executors: int = 50, min_executors: int = 0) -> Column:
    """Executors one fixed operating mode would ask for."""
    base = F.greatest(F.lit(1), (rate / 50).cast("int") + 1)
    if mode == "low_latency":
        return F.least(F.lit(max_executors), base + 4)
    if mode == "cost_saving":
        return F.when(rate < 30, F.lit(0)).otherwise(F.greatest(F.lit(min_executors), base - 2))
    return base


def step_plan(rate: Column) -> tuple[Column, Column]:
    """Three-step sizing: (executors, memory GB)."""
    return (
        F.when(rate > 300, 15).when(rate > 150, 10).otherwise(5),
        F.when(rate > 300, 6).when(rate > 150, 4).otherwise(2),
    )
