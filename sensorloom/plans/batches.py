"""Queries over the micro-batch log: volume, episodes, scores, capacity and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import capacity, score, timeparts
from ..operators import aggregates, batches, lookups, series
from ..sources import views
from .registry import query
from .shape import neutral

KEYS, TS, RATE = ["event_type"], "bucket", "workload_rate"
_W = "PARTITION BY event_type ORDER BY bucket"

# Which operating scenario a feed runs under; "night_shift" has no weights of its own.
_SCENARIO_OF = {
    "view": "healthcare_critical",
    "purchase": "industrial_high_throughput",
    "click": "smart_city_budget",
    "signup": "balanced",
    "error": "night_shift",
}
_WEIGHTS_SQL = """
CASE event_type WHEN 'view' THEN 'healthcare_critical' WHEN 'purchase' THEN 'industrial_high_throughput'
     WHEN 'click' THEN 'smart_city_budget' ELSE 'balanced' END AS scenario,
CASE event_type WHEN 'view' THEN 0.1E0 WHEN 'purchase' THEN 0.2E0 WHEN 'click' THEN 0.9E0 ELSE 0.33E0 END AS alpha,
CASE event_type WHEN 'view' THEN 0.8E0 WHEN 'purchase' THEN 0.3E0 WHEN 'click' THEN 0.05E0 ELSE 0.33E0 END AS beta,
CASE event_type WHEN 'view' THEN 0.1E0 WHEN 'purchase' THEN 0.5E0 WHEN 'click' THEN 0.05E0 ELSE 0.33E0 END AS gamma"""


def _scenario_name() -> Column:
    name = F.lit(None).cast("string")
    for kind, scenario in _SCENARIO_OF.items():
        name = F.when(F.col("event_type") == kind, scenario).otherwise(name)
    return name


@query(
    "batch_volume",
    """SELECT event_type, bucket, count(*) AS message_count, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed_s,
              round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE count(*) END, 6) AS throughput
       FROM (SELECT event_type, ts, date_trunc('hour', ts) AS bucket FROM events) e GROUP BY event_type, bucket""",
)
def batch_volume(spark, folder):
    rows = views.events(spark, folder).select(
        "event_type", "ts", timeparts.bucket(F.col("ts")).alias("bucket")
    )
    return neutral(batches.batch_volume(rows, KEYS, "ts", "bucket"))


@query(
    "cumulative_totals",
    f"""SELECT event_type, bucket, count(*) OVER w AS total_batches, CAST(sum(message_count) OVER w AS BIGINT) AS total_messages,
               CAST(sum(CASE WHEN latency_ms > 200 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS total_violations
        FROM batch_log WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""",
    views=("batch_log",),
)
def cumulative_totals(spark, folder):
    out = batches.cumulative(views.batch_log(spark, folder), KEYS, TS)
    return neutral(out.select(*KEYS, TS, "total_batches", "total_messages", "total_violations"))


_EPISODE_SQL = """event_type, episode, started_at, round(avg_latency_ms, 6) AS avg_latency_ms, round(total_cost, 6) AS total_cost,
 round(avg_throughput, 6) AS avg_throughput, violations, round(reward_sum, 6) AS reward_sum, steps"""


@query("episode_rollup", f"SELECT {_EPISODE_SQL} FROM episodes", views=("episodes",))
def episode_rollup(spark, folder):
    return neutral(batches.episodes(views.batch_log(spark, folder), KEYS, TS))


@query(
    "episode_score",
    """SELECT event_type, episode, round(base + c, 6) AS score, round(base + cf, 6) AS score_flat, round(shift, 6) AS weight_shift,
              round(base + c + 0.2E0 * (1 - shift), 6) AS score_stable
       FROM (SELECT *, abs(a - coalesce(lag(a) OVER w, 0.33E0)) + abs(b - coalesce(lag(b) OVER w, 0.33E0))
                       + abs(g - coalesce(lag(g) OVER w, 0.34E0)) AS shift
             FROM (SELECT *,
                     CASE WHEN avg_latency_ms <= 200 THEN 1.0E0 ELSE -(avg_latency_ms / 200 - 1) END - 0.5E0 * violations AS base,
                     CASE WHEN total_cost <= 10 THEN 1 - 0.5E0 * total_cost / 10 ELSE -(total_cost / 10 - 1) END AS c,
                     CASE WHEN total_cost <= 10 THEN 1 - 0.5E0 * total_cost / 10 ELSE -1 END AS cf,
                     CASE WHEN hot THEN 0.2E0 WHEN dear THEN 0.6E0 WHEN day THEN 0.3E0 ELSE 0.5E0 END AS a,
                     CASE WHEN hot THEN 0.6E0 WHEN dear THEN 0.2E0 WHEN day THEN 0.5E0 ELSE 0.3E0 END AS b, 0.2E0 AS g
                   FROM (SELECT *, avg_latency_ms / 200 > 1.2 AS hot, total_cost / 10 > 1 AS dear,
                                hour(started_at) BETWEEN 9 AND 17 AND isodow(started_at) <= 5 AS day FROM episodes) e) s
             WINDOW w AS (PARTITION BY event_type ORDER BY episode)) z""",
    views=("episodes",),
)
def episode_score(spark, folder):
    eps = batches.episodes(views.batch_log(spark, folder), KEYS, TS)
    out = batches.episode_scores(eps, KEYS)
    return neutral(out.select(*KEYS, "episode", "score", "score_flat", "weight_shift", "score_stable"))


@query(
    "episode_trend",
    """SELECT event_type, episode, round(least(3, avg_latency_ms / 200), 6) AS latency_ratio, round(least(3, total_cost / 10), 6) AS cost_ratio,
              round(least(3, avg_throughput / 100), 6) AS throughput_ratio, round(least(1, violations / 10.0E0), 6) AS violation_ratio,
              CAST(coalesce(sign(avg_latency_ms - lag(avg_latency_ms) OVER w), 0) AS DOUBLE) AS avg_latency_ms_trend,
              CAST(coalesce(sign(total_cost - lag(total_cost) OVER w), 0) AS DOUBLE) AS total_cost_trend
       FROM episodes WINDOW w AS (PARTITION BY event_type ORDER BY episode)""",
    views=("episodes",),
)
def episode_trend(spark, folder):
    eps = batches.episodes(views.batch_log(spark, folder), KEYS, TS)
    out = series.trend_sign(eps, KEYS, "episode", ["avg_latency_ms", "total_cost"])

    def capped(x: Column, target: float, top: float) -> Column:
        return F.least(F.lit(top), x / F.lit(target))

    return neutral(
        out.select(
            *KEYS,
            "episode",
            capped(F.col("avg_latency_ms"), batches.SLA_MS, 3.0).alias("latency_ratio"),
            capped(F.col("total_cost"), batches.BUDGET, 3.0).alias("cost_ratio"),
            capped(F.col("avg_throughput"), 100.0, 3.0).alias("throughput_ratio"),
            capped(F.col("violations"), 10.0, 1.0).alias("violation_ratio"),
            "avg_latency_ms_trend",
            "total_cost_trend",
        )
    )


@query(
    "sla_report",
    """SELECT event_type, count(*) AS steps, count(*) FILTER (WHERE latency_ms > 200) AS violations,
              round(avg(CASE WHEN latency_ms > 200 THEN 1.0E0 ELSE 0 END) * 100, 6) AS violation_pct,
              round(avg(CASE WHEN latency_ms <= 200 THEN 1.0E0 ELSE 0 END), 6) AS compliance FROM rate_hourly GROUP BY event_type""",
    views=("rate_hourly",),
)
def sla_report(spark, folder):
    return neutral(
        aggregates.sla_report(views.rate_hourly(spark, folder), KEYS, "latency_ms", batches.SLA_MS)
    )


@query(
    "time_context",
    """SELECT event_type, bucket, round(hour(bucket) / 24.0E0, 6) AS hour_norm, round((isodow(bucket) - 1) / 7.0E0, 6) AS day_norm, day AS business,
              CASE WHEN hot THEN 0.2E0 WHEN dear THEN 0.6E0 WHEN day THEN 0.3E0 ELSE 0.5E0 END AS alpha,
              CASE WHEN hot THEN 0.6E0 WHEN dear THEN 0.2E0 WHEN day THEN 0.5E0 ELSE 0.3E0 END AS beta, 0.2E0 AS gamma
       FROM (SELECT *, latency_ms / 200 > 1.2 AS hot, cost / 2 > 1 AS dear,
                    hour(bucket) BETWEEN 9 AND 17 AND isodow(bucket) <= 5 AS day FROM batch_log) b""",
    views=("batch_log",),
)
def time_context(spark, folder):
    ts = F.col(TS)
    business = timeparts.is_business_hour(ts)
    weights = score.context_weights(F.col("latency_ms") / batches.SLA_MS, F.col("cost") / 2, business)
    return neutral(
        views.batch_log(spark, folder)
        .withColumn("w", weights)
        .select(
            *KEYS,
            TS,
            (F.hour(ts) / 24.0).alias("hour_norm"),
            (F.weekday(ts) / 7.0).alias("day_norm"),
            business.alias("business"),
            "w.alpha",
            "w.beta",
            "w.gamma",
        )
    )


@query(
    "load_regime",
    """SELECT event_type, bucket, CASE WHEN workload_rate < 20 AND cpu_util < 15 THEN 'NIGHT_IDLE'
              WHEN workload_rate > 400 AND cpu_util > 80 THEN 'TRAFFIC_BURST'
              WHEN workload_rate BETWEEN 100 AND 300 THEN 'BUSINESS_HOURS' ELSE 'NORMAL' END AS regime FROM rate_hourly""",
    views=("rate_hourly",),
)
def load_regime(spark, folder):
    regime = capacity.load_regime(F.col(RATE), F.col("cpu_util"))
    return views.rate_hourly(spark, folder).select(*KEYS, TS, regime.alias("regime"))


def _raw_metrics(log):
    """The metrics that get scaled; sizes follow from the message count."""
    n = F.col("message_count")
    return log.select(
        *KEYS,
        TS,
        "workload",
        (n * 10.0).alias("data_volume_mb"),
        "cpu_util",
        F.least(F.lit(100.0), 25 + n * 0.4).alias("memory_util"),
        "latency_ms",
        "cost",
        (n * 0.1).alias("shuffle_mb"),
        F.least(F.lit(1.0), F.col("workload") / 400).alias("data_temp"),
        (F.col("workload") * 1.1).alias("edge_workload"),
        (n > 5).cast("double").alias("burst_signal"),
    )


_RAW_SQL = """(SELECT event_type, bucket, workload, message_count * 10.0E0 AS data_volume_mb, cpu_util,
  least(100, 25 + message_count * 0.4E0) AS memory_util, latency_ms, cost, message_count * 0.1E0 AS shuffle_mb,
  least(1, workload / 400) AS data_temp, workload * 1.1E0 AS edge_workload, CAST(message_count > 5 AS DOUBLE) AS burst_signal
  FROM batch_log) r"""


def _scaled_sql(divisors: dict[str, float], prefix: str) -> str:
    return ", ".join(f"round({n} / {d}E0, 6) AS {prefix}_{n}" for n, d in divisors.items())


@query(
    "scaled_metrics",
    f"""SELECT event_type, bucket, {_scaled_sql(score.STREAM_DIVISORS, "stream")},
               {_scaled_sql(score.SERVICE_DIVISORS, "service")} FROM {_RAW_SQL}""",
    views=("batch_log",),
)
def scaled_metrics(spark, folder):
    raw = _raw_metrics(views.batch_log(spark, folder))
    sets = {"stream": score.STREAM_DIVISORS, "service": score.SERVICE_DIVISORS}
    columns = [
        (F.col(n) / F.lit(d)).alias(f"{prefix}_{n}")
        for prefix, divisors in sets.items()
        for n, d in divisors.items()
    ]
    return neutral(raw.select(*KEYS, TS, *columns))


@query(
    "softmax_weights",
    """SELECT event_type, bucket, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS alpha,
              round(exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS beta,
              round(exp(c - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS gamma
       FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT event_type, bucket, cost / 10 AS a, latency_ms / 1000 AS b, throughput / 200 AS c FROM batch_log) x) y""",
    views=("batch_log",),
)
def softmax_weights(spark, folder):
    shares = score.softmax(F.col("cost") / 10, F.col("latency_ms") / 1000, F.col("throughput") / 200)
    named = [s.alias(n) for s, n in zip(shares, ("alpha", "beta", "gamma"))]
    return neutral(views.batch_log(spark, folder).select(*KEYS, TS, *named))


@query(
    "scenario_score",
    f"""SELECT event_type, bucket, scenario, round(alpha / t, 6) AS alpha, round(beta / t, 6) AS beta, round(gamma / t, 6) AS gamma,
               round(gamma / t * throughput / 200 - alpha / t * cost / 10 - beta / t * latency_ms / 1000, 6) AS stream_score,
               round(gamma / t * least(1, cpu_util / 100) - alpha / t * least(1, latency_ms / 5000) - beta / t * least(1, cost / 100), 6) AS mode_score,
               round(gamma / t * throughput / 1000 - alpha / t * cost / 10 - beta / t * latency_ms / 1000, 6) AS plan_score,
               CASE WHEN beta > alpha AND beta > gamma THEN 'LATENCY' WHEN alpha > beta AND alpha > gamma THEN 'COST' ELSE 'THROUGHPUT' END AS priority
        FROM (SELECT *, alpha + beta + gamma AS t FROM (SELECT *, {_WEIGHTS_SQL} FROM batch_log) w) z""",
    views=("batch_log",),
)
def scenario_score(spark, folder):
    log = lookups.with_scenario(views.batch_log(spark, folder), _scenario_name())
    alpha, beta, gamma = score.normalised(F.col("alpha"), F.col("beta"), F.col("gamma"))
    cost, latency, done = F.col("cost"), F.col("latency_ms"), F.col("throughput")
    weights = (alpha, beta, gamma)
    mode = score.weighted_score(
        (alpha, beta, gamma),
        F.least(F.lit(1.0), latency / 5000),
        F.least(F.lit(1.0), cost / 100),
        F.least(F.lit(1.0), F.col("cpu_util") / 100),
    )
    return neutral(
        log.select(
            *KEYS,
            TS,
            "scenario",
            alpha.alias("alpha"),
            beta.alias("beta"),
            gamma.alias("gamma"),
            score.weighted_score(weights, cost / 10, latency / 1000, done / 200).alias("stream_score"),
            mode.alias("mode_score"),
            score.weighted_score(weights, cost / 10, latency / 1000, done / 1000).alias("plan_score"),
            score.dominant(F.col("alpha"), F.col("beta"), F.col("gamma")).alias("priority"),
        )
    )


@query(
    "scenario_matrix",
    """SELECT event_type, bucket, scenario, round(gamma * throughput / 200 - alpha * cost / 10 - beta * latency_ms / 1000, 6) AS score
       FROM batch_log, (VALUES ('healthcare_critical', 0.1E0, 0.8E0, 0.1E0), ('industrial_high_throughput', 0.2E0, 0.3E0, 0.5E0),
                               ('smart_city_budget', 0.9E0, 0.05E0, 0.05E0), ('balanced', 0.33E0, 0.33E0, 0.33E0)) s(scenario, alpha, beta, gamma)""",
    views=("batch_log",),
)
def scenario_matrix(spark, folder):
    """What every batch would score under every scenario."""
    rows = lookups.with_every_scenario(views.batch_log(spark, folder))
    weights = tuple(F.col(n) for n in ("alpha", "beta", "gamma"))
    value = score.weighted_score(
        weights, F.col("cost") / 10, F.col("latency_ms") / 1000, F.col("throughput") / 200
    )
    return neutral(rows.select(*KEYS, TS, "scenario", value.alias("score")))


def _decisions(spark, folder):
    """Features, edge signal and the pool sized for the previous step, with the recommended action."""
    rates = views.rate_hourly(spark, folder).select(*KEYS, TS, RATE, "cpu_util", "latency_ms")
    rows = series.traffic_features(rates, KEYS, TS, RATE)
    rows = series.ma_crossover(rows, KEYS, TS, RATE, short_s=2 * 3600, long_s=24 * 3600)
    previous = F.coalesce(F.lag(RATE).over(series.in_order(KEYS, TS)), F.lit(0.0))
    rows = rows.withColumn("current_executors", F.floor(previous / 50))
    rows = lookups.with_scenario(rows, _scenario_name())
    advice = capacity.recommendation(
        F.col(RATE),
        F.col("cpu_util"),
        F.col("latency_ms") * 4,
        F.col("current_executors"),
        F.col("burst_probability"),
        F.col("velocity"),
        F.col("burst_signal"),
        F.col("alpha"),
        F.col("beta"),
        velocity_over=0.01,
    )
    return rows.withColumn("_advice", advice).select(
        *KEYS, TS, RATE, "burst_probability", "current_executors", "_advice.*"
    )


_DECISION_SQL = f"""+ decisions AS (
 SELECT event_type, bucket, workload_rate, burst_probability, cur,
   CASE WHEN c = 1 THEN 'scale_down' WHEN c = 2 THEN 'scale_down' WHEN c IN (3, 4) THEN 'pre_warm' WHEN c IN (5, 6) THEN 'scale_up'
        WHEN c = 7 THEN 'scale_down' ELSE 'maintain' END AS action,
   CAST(CASE c WHEN 1 THEN 0 WHEN 2 THEN greatest(1, cur // 2) WHEN 3 THEN least(50, cur + 4) WHEN 4 THEN least(50, trunc(cur * 2.5E0))
        WHEN 5 THEN least(50, greatest(trunc(workload_rate / 50), cur + 2)) WHEN 6 THEN least(50, cur + 3) WHEN 7 THEN cur - 1 ELSE cur END AS INT) AS target,
   CASE c WHEN 1 THEN 0.95E0 WHEN 2 THEN 0.85E0 WHEN 3 THEN 0.92E0 WHEN 4 THEN 0.9E0 WHEN 5 THEN 0.88E0 WHEN 6 THEN 0.85E0 WHEN 7 THEN 0.75E0
        WHEN 8 THEN 0.0E0 ELSE 0.8E0 END AS confidence
 FROM (SELECT *, CASE WHEN workload_rate < 20 AND cpu_util < 20 THEN 1 WHEN workload_rate < 40 THEN 2
          WHEN burst_probability > 0.6 AND velocity > 0.01 THEN 3 WHEN s > l * 1.5E0 THEN 4
          WHEN workload_rate > 200 OR cpu_util > 80 THEN 5 WHEN beta > 0.5 AND latency_ms * 4 > 1000 THEN 6
          WHEN alpha > 0.5 AND workload_rate < 140 AND cur > 1 THEN 7 WHEN alpha > 0.5 AND workload_rate < 140 THEN 8 ELSE 9 END AS c
       FROM (SELECT event_type, bucket, workload_rate, cpu_util, latency_ms, {_WEIGHTS_SQL},
                    CASE WHEN sample_no >= 5 THEN burst_probability ELSE 0 END AS burst_probability,
                    CASE WHEN sample_no >= 5 THEN velocity ELSE 0 END AS velocity,
                    avg(workload_rate) OVER ({_W} RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS s,
                    avg(workload_rate) OVER ({_W} RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS l,
                    CAST(floor(coalesce(lag(workload_rate) OVER ({_W}), 0) / 50) AS BIGINT) AS cur
             FROM features) f) g)
"""


@query(
    "capacity_recommendation",
    _DECISION_SQL
    + "SELECT event_type, bucket, cur AS current_executors, action, target, confidence FROM decisions",
    views=("features",),
)
def capacity_recommendation(spark, folder):
    return neutral(
        _decisions(spark, folder).select(
            *KEYS, TS, "current_executors", "action", "target", "confidence"
        )
    )


@query(
    "prediction_outcome",
    _DECISION_SQL
    + """SELECT event_type, prewarms, avoided, wasted, missed, round(coalesce(avoided / nullif(avoided + wasted, 0)::DOUBLE, 0), 6) AS accuracy
  FROM (SELECT event_type, count(*) FILTER (WHERE action = 'pre_warm') AS prewarms,
               count(*) FILTER (WHERE action = 'pre_warm' AND (workload_rate > 100 OR burst_probability > 0.6)) AS avoided,
               count(*) FILTER (WHERE action = 'pre_warm' AND NOT (workload_rate > 100 OR burst_probability > 0.6)) AS wasted,
               count(*) FILTER (WHERE action <> 'pre_warm' AND workload_rate > 100 AND cur <= 1) AS missed
        FROM decisions GROUP BY event_type) o""",
    views=("features",),
)
def prediction_outcome(spark, folder):
    return neutral(aggregates.prediction_outcome(_decisions(spark, folder), KEYS))


@query(
    "mode_targets",
    """SELECT event_type, bucket, CAST(least(50, b + 4) AS INT) AS low_latency,
              CAST(CASE WHEN workload_rate < 30 THEN 0 ELSE greatest(0, b - 2) END AS INT) AS cost_saving, CAST(b AS INT) AS balanced,
              CASE WHEN workload_rate > 300 THEN 15 WHEN workload_rate > 150 THEN 10 ELSE 5 END AS step_executors,
              CASE WHEN workload_rate > 300 THEN 6 WHEN workload_rate > 150 THEN 4 ELSE 2 END AS step_memory_gb
       FROM (SELECT *, greatest(1, trunc(workload_rate / 50) + 1) AS b FROM rate_hourly) r""",
    views=("rate_hourly",),
)
def mode_targets(spark, folder):
    rate = F.col(RATE)
    executors, memory = capacity.step_plan(rate)
    modes = [capacity.mode_target(rate, m).alias(m) for m in ("low_latency", "cost_saving", "balanced")]
    return views.rate_hourly(spark, folder).select(
        *KEYS, TS, *modes, executors.alias("step_executors"), memory.alias("step_memory_gb")
    )


def _arrivals(spark, folder):
    return views.rate_hourly(spark, folder).select(*KEYS, TS, F.col(RATE).cast("bigint").alias("arrivals"))


@query(
    "capacity_backlog",
    f"""SELECT event_type, bucket, arrivals, CAST(s - least(0, min(s) OVER w) AS BIGINT) AS backlog, greatest(0, arrivals - 100) AS dropped,
               CAST(coalesce(lag(s) OVER ({_W}) - least(0, min(s) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0)
                    + greatest(0, arrivals - 100) AS BIGINT) AS queued_before_drain,
               CAST(100 + 2 * (coalesce(lag(s) OVER ({_W}) - least(0, min(s) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0)
                    + greatest(0, arrivals - 100)) AS BIGINT) AS latency_estimate_ms
        FROM (SELECT *, sum(arrivals - 100) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s
              FROM (SELECT event_type, bucket, CAST(workload_rate AS BIGINT) AS arrivals FROM rate_hourly) a) b
        WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""",
    views=("rate_hourly",),
)
def capacity_backlog(spark, folder):
    """Queue behind two executors of fifty messages each."""
    out = series.backlog(_arrivals(spark, folder), KEYS, TS, "arrivals", 100)
    return neutral(
        out.select(
            *KEYS, TS, "arrivals", "backlog", "dropped", "queued_before_drain", "latency_estimate_ms"
        )
    )


@query(
    "drop_rate",
    """SELECT event_type, CAST(sum(a) AS BIGINT) AS total_messages, CAST(sum(greatest(0, a - 100)) AS BIGINT) AS dropped_messages,
              round(sum(greatest(0, a - 100)) / greatest(1, sum(a))::DOUBLE * 100, 6) AS drop_pct
       FROM (SELECT event_type, CAST(workload_rate AS BIGINT) AS a FROM rate_hourly) r GROUP BY event_type""",
    views=("rate_hourly",),
)
def drop_rate(spark, folder):
    rows = _arrivals(spark, folder).withColumn(
        "dropped", F.greatest(F.lit(0), F.col("arrivals") - 100)
    )
    return neutral(aggregates.drop_rate(rows, KEYS, "arrivals", "dropped"))


@query(
    "fixed_capacity",
    """SELECT event_type, bucket, round(workload_rate / 250, 6) AS utilisation, CAST(greatest(60, trunc(100 + workload_rate / 250 * 800)) AS INT) AS pool_latency_ms,
              least(workload_rate, 250) AS processed, workload_rate / 250 > 1 AS overloaded FROM rate_hourly""",
    views=("rate_hourly",),
)
def fixed_capacity(spark, folder):
    pool = capacity.fixed_capacity(F.col(RATE), executors=5)
    return neutral(
        views.rate_hourly(spark, folder).select(*KEYS, TS, *[c.alias(n) for n, c in pool.items()])
    )


@query(
    "tier_label",
    """SELECT event_type, bucket, workload_rate, CASE WHEN workload_rate > 250 THEN 'HOT' WHEN workload_rate > 100 THEN 'WARM' ELSE 'COLD' END AS tier FROM rate_hourly""",
    views=("rate_hourly",),
)
def tier_label(spark, folder):
    return views.rate_hourly(spark, folder).select(
        *KEYS, TS, RATE, capacity.tier_label(F.col(RATE)).alias("tier")
    )


@query(
    "tier_cost",
    """SELECT event_type, bucket, tier_id, codec_id, store, round(executors * 0.1E0 + executors * 4 * 0.05E0 + size_mb * ratio / 1024 * price, 6) AS total_cost,
              round(access_ms * (size_mb * ratio / 100), 6) AS access_latency_ms, round(decode_ms * (size_mb / 100), 6) AS decode_latency_ms,
              workload / 400 > 0.7 AND tier_id > 1 AS misplaced
       FROM (SELECT *, CASE tier_id WHEN 0 THEN 'Redis' WHEN 1 THEN 'NVMe' WHEN 2 THEN 'S3' ELSE 'Glacier' END AS store,
                    CASE tier_id WHEN 0 THEN 0.1E0 WHEN 1 THEN 0.05E0 WHEN 2 THEN 0.02E0 ELSE 0.005E0 END AS price,
                    CASE tier_id WHEN 0 THEN 5.0E0 WHEN 1 THEN 20.0E0 WHEN 2 THEN 100.0E0 ELSE 5000.0E0 END AS access_ms,
                    CASE codec_id WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.6E0 ELSE 0.3E0 END AS ratio,
                    CASE codec_id WHEN 0 THEN 0.0E0 WHEN 1 THEN 10.0E0 ELSE 50.0E0 END AS decode_ms
             FROM (SELECT event_type, bucket, workload, executors, message_count * 12.5E0 AS size_mb,
                          CAST(message_count % 4 AS INT) AS tier_id, CAST(message_count % 3 AS INT) AS codec_id FROM batch_log) b) c""",
    views=("batch_log",),
)
def tier_cost(spark, folder):
    n = F.col("message_count")
    rows = views.batch_log(spark, folder).select(
        *KEYS,
        TS,
        "workload",
        "executors",
        (n * 12.5).alias("size_mb"),
        (n % 4).cast("int").alias("tier_id"),
        (n % 3).cast("int").alias("codec_id"),
    )
    size, ratio = F.col("size_mb"), F.col("size_ratio")
    cost = score.resource_cost(F.col("executors"), F.lit(4), size, ratio, F.col("price"))
    return neutral(
        lookups.with_tier(rows, "tier_id", "codec_id").select(
            *KEYS,
            TS,
            "tier_id",
            "codec_id",
            "store",
            cost.alias("total_cost"),
            (F.col("access_ms") * (size * ratio / 100)).alias("access_latency_ms"),
            (F.col("decode_ms") * (size / 100)).alias("decode_latency_ms"),
            capacity.misplaced(F.col("workload") / 400, F.col("tier_id")).alias("misplaced"),
        )
    )
