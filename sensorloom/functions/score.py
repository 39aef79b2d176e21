"""Weights, scores and cost formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisors that bring raw metrics to comparable size.
STREAM_DIVISORS = {
    "workload": 1000.0,
    "data_volume_mb": 500.0,
    "cpu_util": 100.0,
    "memory_util": 100.0,
    "latency_ms": 1000.0,
    "cost": 10.0,
    "shuffle_mb": 100.0,
    "data_temp": 1.0,
    "edge_workload": 1000.0,
    "burst_signal": 1.0,
}
SERVICE_DIVISORS = {
    "workload": 500.0,
    "data_volume_mb": 500.0,
    "cpu_util": 100.0,
    "memory_util": 100.0,
    "latency_ms": 1000.0,
    "cost": 10.0,
    "shuffle_mb": 200.0,
    "data_temp": 1.0,
    "edge_workload": 500.0,
    "burst_signal": 1.0,
}


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def normalised(*weights: Column) -> list[Column]:
    """Shares of the absolute weights; equal shares when all are zero."""
    total = _sum([F.abs(w) for w in weights])
    return [F.coalesce(F.try_divide(F.abs(w), total), F.lit(1.0 / len(weights))) for w in weights]


def softmax(*values: Column) -> list[Column]:
    top = F.greatest(*values)
    shares = [F.exp(v - top) for v in values]
    return [s / _sum(shares) for s in shares]


def weighted_score(
    weights: tuple[Column, Column, Column], cost: Column, latency: Column, throughput: Column
) -> Column:
    """Throughput earns, cost and latency cost; all three already scaled."""
    alpha, beta, gamma = weights
    return gamma * throughput - alpha * cost - beta * latency


def dominant(alpha: Column, beta: Column, gamma: Column) -> Column:
    """The strictly largest weight; any tie goes to throughput."""
    return (
        F.when((beta > alpha) & (beta > gamma), "LATENCY")
        .when((alpha > beta) & (alpha > gamma), "COST")
        .otherwise("THROUGHPUT")
    )


def overrun(value: Column, limit: float) -> Column:
    """How far ``value`` exceeds ``limit``, as a negative share."""
    return -(value / F.lit(limit) - 1)


def latency_score(mean_latency: Column, sla: float = 200.0) -> Column:
    return F.when(mean_latency <= sla, F.lit(1.0)).otherwise(overrun(mean_latency, sla))


def cost_score(cost: Column, budget: float = 10.0, flat_overrun: bool = False) -> Column:
    over = F.lit(-1.0) if flat_overrun else overrun(cost, budget)
    return F.when(cost <= budget, 1.0 - cost / F.lit(budget) * 0.5).otherwise(over)


def context_weights(latency_ratio: Column, cost_ratio: Column, business: Column) -> Column:
    """Weights (alpha, beta, gamma) for the current pressure."""

    def weights(alpha: float, beta: float, gamma: float) -> Column:
        return F.struct(
            F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), F.lit(gamma).alias("gamma")
        )

    return (
        F.when(latency_ratio > 1.2, weights(0.2, 0.6, 0.2))
        .when(cost_ratio > 1.0, weights(0.6, 0.2, 0.2))
        .when(business, weights(0.3, 0.5, 0.2))
        .otherwise(weights(0.5, 0.3, 0.2))
    )


def improvement(base: Column, value: Column, lower_is_better: bool = True) -> Column:
    """Percent gain over ``base``, one decimal; a zero base counts as all or nothing."""
    if lower_is_better:
        at_zero = F.when(value == 0, 0.0).otherwise(-100.0)
        gain = base - value
    else:
        at_zero = F.when(value > 0, 100.0).otherwise(0.0)
        gain = value - base
    return F.when(base == 0, at_zero).otherwise(F.round(F.try_divide(gain, base) * 100, 1))


def improvement_floored(base: Column, value: Column, lower_is_better: bool = True) -> Column:
    """Percent gain with the base held at 1 or more."""
    gain = base - value if lower_is_better else value - base
    return gain / F.greatest(F.lit(1.0), base) * 100


def resource_cost(
    executors: Column, memory_gb: Column, size_mb: Column, size_ratio: Column, price: Column
) -> Column:
    return executors * 0.1 + executors * memory_gb * 0.05 + size_mb * size_ratio / 1024.0 * price
