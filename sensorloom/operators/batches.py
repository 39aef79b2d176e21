"""Rollups over a log of micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score, timeparts
from .aggregates import latest_per_key
from .series import in_order, so_far

SLA_MS = 200.0
BUDGET = 10.0
WEIGHTS = (0.33, 0.33, 0.34)


def batch_volume(df: DataFrame, keys: Sequence[str], ts: str, bucket: str) -> DataFrame:
    """Rows per batch and rows per second of the time the batch spans; a zero span gives the count."""
    at = timeparts.micros(F.col(ts))
    stats = df.groupBy(*keys, bucket).agg(
        F.count(F.lit(1)).alias("message_count"),
        timeparts.seconds_between(F.max(at), F.min(at)).alias("elapsed_s"),
    )
    n = F.col("message_count").cast("double")
    rate = F.when(F.col("elapsed_s") > 0, n / F.col("elapsed_s")).otherwise(n)
    return stats.withColumn("throughput", rate)


def cumulative(df: DataFrame, keys: Sequence[str], order: str, sla: float = SLA_MS) -> DataFrame:
    upto = so_far(keys, order)
    late = (F.col("latency_ms") > sla).cast("bigint")
    return df.withColumns(
        {
            "total_batches": F.count(F.lit(1)).over(upto),
            "total_messages": F.sum("message_count").over(upto),
            "total_violations": F.sum(late).over(upto),
        }
    )


def step_reward(weights: tuple[float, float, float] = WEIGHTS):
    return score.weighted_score(
        tuple(F.lit(w) for w in weights),
        F.col("cost") / 10.0,
        F.col("latency_ms") / 1000.0,
        F.col("throughput") / 200.0,
    )


def episodes(
    df: DataFrame, keys: Sequence[str], order: str, length: int = 5, sla: float = SLA_MS
) -> DataFrame:
    """Every ``length`` consecutive batches of a key as one row; an unfinished group is left out."""
    keys = list(keys)
    number = F.floor((F.row_number().over(in_order(keys, order)) - 1) / length) + 1
    return (
        df.withColumns({"episode": number, "_reward": step_reward()})
        .groupBy(*keys, "episode")
        .agg(
            F.min(order).alias("started_at"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.sum("cost").alias("total_cost"),
            F.avg("throughput").alias("avg_throughput"),
            F.count_if(F.col("latency_ms") > sla).alias("violations"),
            F.sum("_reward").alias("reward_sum"),
            F.count(F.lit(1)).alias("steps"),
        )
        .filter(F.col("steps") == length)
    )


def episode_scores(
    eps: DataFrame, keys: Sequence[str], sla: float = SLA_MS, budget: float = BUDGET
) -> DataFrame:
    """Adds the episode score, its stability-aware form and its flat-overrun form.

    Stability compares the weights an episode's context asks for with the previous ones.
    """
    base = score.latency_score(F.col("avg_latency_ms"), sla) - 0.5 * F.col("violations")
    flat = base + score.cost_score(F.col("total_cost"), budget, flat_overrun=True)
    weights = score.context_weights(
        F.col("avg_latency_ms") / sla,
        F.col("total_cost") / budget,
        timeparts.is_business_hour(F.col("started_at")),
    )
    w = in_order(keys, "episode")
    names = ("alpha", "beta", "gamma")
    moved = sum(
        F.abs(F.col(f"_w.{n}") - F.coalesce(F.lag(f"_w.{n}").over(w), F.lit(start)))
        for n, start in zip(names, WEIGHTS)
    )
    return (
        eps.withColumn("_w", weights)
        .withColumns(
            {
                "score": base + score.cost_score(F.col("total_cost"), budget),
                "score_flat": flat,
                "weight_shift": moved,
            }
        )
        .withColumn("score_stable", F.col("score") + 0.2 * (1 - F.col("weight_shift")))
        .drop("_w")
    )




def newest_batches(log: DataFrame) -> DataFrame:
    """One row per (query, batch): a batch that was retried keeps its last record."""
    return latest_per_key(log, ["query_id", "batch_id"], "finished_at")
