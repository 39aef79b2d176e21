"""Queries over policy runs: percentiles, summaries and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score
from ..operators import aggregates, lookups, quantiles
from ..sources import views
from .registry import query
from .shape import neutral

BASELINE = "A"
SLA_MS = 500.0


@query(
    "latency_percentiles",
    """SELECT policy, count(*) AS rows, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
              round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM policy_runs GROUP BY policy""",
    views=("policy_runs",),
)
def latency_percentiles(spark, folder):
    runs = views.policy_runs(spark, folder)
    return neutral(
        quantiles.percentiles(runs, ["policy"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    )


@query(
    "latency_nearest_rank",
    """SELECT policy, max(n) AS rows, max(CASE WHEN rn = floor(0.95E0 * n) + 1 THEN latency_ms END) AS p95,
              max(CASE WHEN rn = floor(0.99E0 * n) + 1 THEN latency_ms END) AS p99
       FROM (SELECT policy, latency_ms, row_number() OVER (PARTITION BY policy ORDER BY latency_ms) AS rn,
                    count(*) OVER (PARTITION BY policy) AS n FROM policy_runs) r GROUP BY policy""",
    views=("policy_runs",),
)
def latency_nearest_rank(spark, folder):
    runs = views.policy_runs(spark, folder)
    return quantiles.nearest_ranks(runs, ["policy"], "latency_ms", {"p95": 0.95, "p99": 0.99})


@query(
    "latency_percentiles_tied",
    """SELECT policy, count(*) AS rows, round(quantile_cont(executors, 0.5), 6) AS p50, round(quantile_cont(executors, 0.95), 6) AS p95,
              round(quantile_cont(executors, 0.99), 6) AS p99 FROM policy_runs GROUP BY policy""",
    views=("policy_runs",),
)
def latency_percentiles_tied(spark, folder):
    """Percentiles of a metric with a few whole values, each shared by very many rows."""
    runs = views.policy_runs(spark, folder)
    return neutral(
        quantiles.percentiles(runs, ["policy"], "executors", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    )


@query(
    "latency_estimate",
    "SELECT policy, count(*) AS rows, TRUE AS p95_within, TRUE AS p99_within FROM policy_runs GROUP BY policy",
    views=("policy_runs",),
)
def latency_estimate(spark, folder):
    """The one-pass estimates checked: whether their ranks are within twice the stated error."""
    runs, probs = views.policy_runs(spark, folder), {"p95": 0.95, "p99": 0.99}
    told = quantiles.approx_percentiles(runs, ["policy"], "latency_ms", probs)
    slack = F.greatest(F.lit(2.0), 2.0 * F.col("rows") / quantiles.ACCURACY)
    counts = [F.count_if(F.col("latency_ms") < F.col(p)).alias(f"{p}_below") for p in probs]
    counts += [F.count_if(F.col("latency_ms") <= F.col(p)).alias(f"{p}_upto") for p in probs]
    ranked = runs.join(told, "policy").groupBy("policy").agg(F.count(F.lit(1)).alias("rows"), *counts)
    within = [
        ((F.col(f"{p}_below") <= q * F.col("rows") + slack) & (F.col(f"{p}_upto") >= q * F.col("rows") - slack)).alias(
            f"{p}_within"
        )
        for p, q in probs.items()
    ]
    return ranked.select("policy", "rows", *within)


_METRICS = ("latency_ms", "executors", "cost")


@query(
    "summary_stats",
    " UNION ALL ".join(
        f"""SELECT policy, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std,
                   round(min({m}), 6) AS min, round(max({m}), 6) AS max FROM policy_runs GROUP BY policy"""
        for m in _METRICS
    ),
    views=("policy_runs",),
)
def summary_stats(spark, folder):
    return neutral(aggregates.summary(views.policy_runs(spark, folder), ["policy"], _METRICS))


@query(
    "value_histogram",
    """+ lim AS (SELECT policy, min(latency_ms) AS lo, max(latency_ms) AS hi FROM policy_runs GROUP BY policy),
       hits AS (SELECT policy, CAST(least(floor((latency_ms - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS rows
                FROM policy_runs JOIN lim USING (policy) GROUP BY 1, 2),
       bins AS (SELECT policy, lo, hi, CAST(b AS INT) AS bin FROM lim, range(10) r(b))
       SELECT policy, bin, round(lo + (hi - lo) * bin / 10, 6) AS bin_from, round(lo + (hi - lo) * (bin + 1) / 10, 6) AS bin_to,
              coalesce(rows, 0) AS rows FROM bins LEFT JOIN hits USING (policy, bin)""",
    views=("policy_runs",),
)
def value_histogram(spark, folder):
    return neutral(aggregates.histogram(views.policy_runs(spark, folder), ["policy"], "latency_ms"))


def _policy_summary(spark, folder):
    runs = views.policy_runs(spark, folder)
    late = F.col("latency_ms") > SLA_MS
    return runs.groupBy("scenario", "policy").agg(
        F.sum("cost").alias("total_cost"),
        F.avg("latency_ms").alias("avg_latency"),
        F.max("latency_ms").alias("max_latency"),
        F.avg("executors").alias("throughput"),
        (F.avg(late.cast("double")) * 100).alias("sla_pct"),
        F.count_if(late).alias("violations"),
    )


_SUMMARY_SQL = """+ s AS (
  SELECT scenario, policy, sum(cost) AS total_cost, avg(latency_ms) AS avg_latency, max(latency_ms) AS max_latency, avg(executors) AS throughput,
         avg(CASE WHEN latency_ms > 500 THEN 1.0E0 ELSE 0 END) * 100 AS sla_pct, count(*) FILTER (WHERE latency_ms > 500) AS violations
  FROM policy_runs GROUP BY scenario, policy),
 c AS (SELECT s.*, b.total_cost AS b_cost, b.avg_latency AS b_avg, b.max_latency AS b_max, b.throughput AS b_thr, b.sla_pct AS b_sla, b.violations AS b_vio
       FROM s JOIN s b ON s.scenario = b.scenario AND b.policy = 'A')
"""


def _compared(spark, folder):
    metrics = ["total_cost", "avg_latency", "max_latency", "throughput", "sla_pct", "violations"]
    return lookups.against_baseline(
        _policy_summary(spark, folder), ["scenario"], "policy", BASELINE, metrics
    )


@query(
    "improvement_vs_baseline",
    _SUMMARY_SQL
    + """SELECT scenario, policy, round((b_sla - sla_pct) / b_sla * 100, 1) AS sla_gain, round((b_avg - avg_latency) / b_avg * 100, 1) AS latency_gain,
          round((throughput - b_thr) / b_thr * 100, 1) AS throughput_gain, round((total_cost - b_cost) / b_cost * 100, 1) AS cost_change,
          round((b_avg - avg_latency) / greatest(1, b_avg) * 100, 6) AS latency_gain_floored,
          round((b_max - max_latency) / greatest(1, b_max) * 100, 6) AS max_latency_gain_floored, b_vio - violations AS violations_avoided FROM c""",
    views=("policy_runs",),
)
def improvement_vs_baseline(spark, folder):
    c = F.col
    return neutral(
        _compared(spark, folder).select(
            "scenario",
            "policy",
            score.improvement(c("base_sla_pct"), c("sla_pct")).alias("sla_gain"),
            score.improvement(c("base_avg_latency"), c("avg_latency")).alias("latency_gain"),
            score.improvement(c("base_throughput"), c("throughput"), lower_is_better=False).alias(
                "throughput_gain"
            ),
            score.improvement(c("base_total_cost"), c("total_cost"), lower_is_better=False).alias(
                "cost_change"
            ),
            score.improvement_floored(c("base_avg_latency"), c("avg_latency")).alias(
                "latency_gain_floored"
            ),
            score.improvement_floored(c("base_max_latency"), c("max_latency")).alias(
                "max_latency_gain_floored"
            ),
            (c("base_violations") - c("violations")).alias("violations_avoided"),
        )
    )


@query(
    "improvement_overall",
    _SUMMARY_SQL
    + """SELECT policy, round(avg((b_avg - avg_latency) / greatest(1, b_avg) * 100), 6) AS mean_latency_gain,
          round(avg((b_max - max_latency) / greatest(1, b_max) * 100), 6) AS mean_max_latency_gain,
          CAST(sum(b_vio - violations) AS BIGINT) AS violations_avoided FROM c GROUP BY policy""",
    views=("policy_runs",),
)
def improvement_overall(spark, folder):
    c = F.col
    gain = score.improvement_floored(c("base_avg_latency"), c("avg_latency"))
    peak_gain = score.improvement_floored(c("base_max_latency"), c("max_latency"))
    return neutral(
        _compared(spark, folder)
        .groupBy("policy")
        .agg(
            F.avg(gain).alias("mean_latency_gain"),
            F.avg(peak_gain).alias("mean_max_latency_gain"),
            F.sum(c("base_violations") - c("violations")).alias("violations_avoided"),
        )
    )


@query(
    "scorecard",
    _SUMMARY_SQL
    + """SELECT scenario, policy, round(total_cost / 10 + avg_latency / 500 - throughput / 100, 4) AS efficiency,
          CAST(b_avg > avg_latency AS INT) + CAST(b_vio > violations AS INT) + CAST(b_cost > total_cost AS INT) AS wins FROM c""",
    views=("policy_runs",),
)
def scorecard(spark, folder):
    c = F.col
    better = [
        (c(f"base_{m}") > c(m)).cast("int") for m in ("avg_latency", "violations", "total_cost")
    ]
    efficiency = c("total_cost") / 10 + c("avg_latency") / 500 - c("throughput") / 100
    return neutral(
        _compared(spark, folder).select(
            "scenario", "policy", efficiency.alias("efficiency"), sum(better[1:], better[0]).alias("wins")
        ),
        digits=4,
    )
