"""Queries over hourly rate series, one series per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeparts
from ..operators import aggregates, series
from ..sources import views
from .registry import query
from .shape import neutral

KEYS, TS, RATE = ["event_type"], "bucket", "workload_rate"
_W = "PARTITION BY event_type ORDER BY bucket"


def _rates(spark, folder):
    return views.rate_hourly(spark, folder).select(*KEYS, TS, RATE)


@query(
    "traffic_velocity",
    "SELECT event_type, bucket, sample_no, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration FROM moves",
    views=("moves",),
)
def traffic_velocity(spark, folder):
    moves = series.velocity(_rates(spark, folder), KEYS, TS, RATE)
    return neutral(
        moves.select(*KEYS, TS, F.col("sample_no").cast("bigint"), "velocity", "acceleration")
    )


@query(
    "rolling_stats",
    f"""SELECT event_type, bucket, round(avg(workload_rate) OVER ({_W} ROWS 299 PRECEDING), 6) AS rolling_mean,
               round(stddev_pop(workload_rate) OVER ({_W} ROWS 299 PRECEDING), 6) AS rolling_std FROM rate_hourly""",
    views=("rate_hourly",),
)
def rolling_stats(spark, folder):
    out = series.rolling(_rates(spark, folder), KEYS, TS, RATE)
    return neutral(out.select(*KEYS, TS, "rolling_mean", "rolling_std"))


@query(
    "burst_probability",
    """SELECT event_type, bucket, round(threshold, 6) AS burst_threshold, round(burst_probability, 6) AS burst_probability
       FROM features""",
    views=("features",),
)
def burst_probability(spark, folder):
    moves = series.rising(series.velocity(_rates(spark, folder), KEYS, TS, RATE), KEYS)
    out = series.burst_probability(series.threshold(moves, KEYS))
    return neutral(out.select(*KEYS, TS, "burst_threshold", "burst_probability"))


@query(
    "hour_cycle",
    """SELECT event_type, bucket, round(sin(2 * pi() * (hour(bucket) + minute(bucket) / 60.0E0) / 24), 6) AS hour_sin,
              round(cos(2 * pi() * (hour(bucket) + minute(bucket) / 60.0E0) / 24), 6) AS hour_cos FROM rate_hourly""",
    views=("rate_hourly",),
)
def hour_cycle(spark, folder):
    sin, cos = timeparts.hour_cycle(F.col(TS))
    return neutral(_rates(spark, folder).select(*KEYS, TS, sin.alias("hour_sin"), cos.alias("hour_cos")))


@query(
    "traffic_features",
    """SELECT event_type, bucket, round(CASE WHEN warm THEN velocity ELSE 0 END, 6) AS velocity,
              round(CASE WHEN warm THEN acceleration ELSE 0 END, 6) AS acceleration,
              round(CASE WHEN warm THEN rolling_mean ELSE 0 END, 6) AS rolling_mean,
              round(CASE WHEN warm THEN rolling_std ELSE 0 END, 6) AS rolling_std,
              round(CASE WHEN warm THEN burst_probability ELSE 0 END, 6) AS burst_probability,
              round(CASE WHEN warm THEN sin(2 * pi() * hour(bucket) / 24) ELSE 0 END, 6) AS hour_sin,
              round(CASE WHEN warm THEN cos(2 * pi() * hour(bucket) / 24) ELSE 0 END, 6) AS hour_cos
       FROM (SELECT *, sample_no >= 5 AS warm FROM features) f""",
    views=("features",),
)
def traffic_features(spark, folder):
    out = series.traffic_features(_rates(spark, folder), KEYS, TS, RATE)
    names = ["velocity", "acceleration", "rolling_mean", "rolling_std", "burst_probability"]
    return neutral(out.select(*KEYS, TS, *names, "hour_sin", "hour_cos"))


@query(
    "burst_zscore",
    f"""SELECT event_type, bucket, CASE WHEN n >= 3 THEN
               round(greatest(0, least(1, (workload_rate - m) / (s + 1e-9) * 0.3E0)), 2) ELSE 0 END AS burst_zscore
        FROM (SELECT *, round_even(avg(workload_rate) OVER ({_W} ROWS 19 PRECEDING), 1) AS m,
                     round_even(stddev_pop(workload_rate) OVER ({_W} ROWS 19 PRECEDING), 1) AS s,
                     row_number() OVER ({_W}) AS n FROM (SELECT event_type, bucket, workload_rate FROM rate_hourly) r) z""",
    views=("rate_hourly",),
)
def burst_zscore(spark, folder):
    out = series.burst_zscore(_rates(spark, folder), KEYS, TS, RATE)
    return neutral(out.select(*KEYS, TS, "burst_zscore"))


@query(
    "burst_velocity_ratio",
    f"""SELECT event_type, bucket,
               round(CASE WHEN n >= 3 THEN greatest(0, least(1, v / (s10 + 1) * 0.35E0)) ELSE 0 END, 6) AS ratio_10,
               round(CASE WHEN n >= 3 THEN greatest(0, least(1, v / (s8 + 1) * 0.4E0)) ELSE 0 END, 6) AS ratio_8
        FROM (SELECT event_type, bucket, row_number() OVER ({_W}) AS n, workload_rate - lag(workload_rate) OVER ({_W}) AS v,
                     stddev_pop(workload_rate) OVER ({_W} ROWS 9 PRECEDING) AS s10,
                     stddev_pop(workload_rate) OVER ({_W} ROWS 7 PRECEDING) AS s8
              FROM (SELECT event_type, bucket, workload_rate FROM rate_hourly) r) z""",
    views=("rate_hourly",),
)
def burst_velocity_ratio(spark, folder):
    out = series.burst_velocity_ratio(_rates(spark, folder), KEYS, TS, RATE, 10, 0.35, "ratio_10")
    out = series.burst_velocity_ratio(out, KEYS, TS, RATE, 8, 0.4, "ratio_8")
    return neutral(out.select(*KEYS, TS, "ratio_10", "ratio_8"))


@query(
    "moving_forecast",
    f"""SELECT event_type, bucket, round(f, 6) AS forecast, least(25, greatest(2, CAST(trunc(f * 0.05E0) AS INT))) AS planned_executors
        FROM (SELECT event_type, bucket, avg(workload_rate) OVER ({_W} ROWS 4 PRECEDING) AS f FROM rate_hourly) z""",
    views=("rate_hourly",),
)
def moving_forecast(spark, folder):
    out = series.moving_forecast(_rates(spark, folder), KEYS, TS, RATE)
    planned = F.least(F.lit(25), F.greatest(F.lit(2), (F.col("forecast") * 0.05).cast("int")))
    return neutral(out.select(*KEYS, TS, "forecast", planned.alias("planned_executors")))


@query(
    "moving_smooth",
    f"""SELECT event_type, bucket, round(smoothed, 6) AS smoothed
        FROM (SELECT event_type, bucket, avg(workload_rate) OVER ({_W} ROWS 9 PRECEDING) AS smoothed,
                     row_number() OVER ({_W}) AS n FROM rate_hourly) z WHERE n >= 10""",
    views=("rate_hourly",),
)
def moving_smooth(spark, folder):
    out = series.moving_smooth(_rates(spark, folder), KEYS, TS, RATE)
    return neutral(out.select(*KEYS, TS, "smoothed"))


@query(
    "lookahead_label",
    f"""SELECT event_type, bucket, future, CASE WHEN future IS NOT NULL THEN greatest(1, CAST(trunc(future / 50) AS INT) + 1) END AS future_executors
        FROM (SELECT event_type, bucket, lead(workload_rate, 10) OVER ({_W}) AS future FROM rate_hourly) z""",
    views=("rate_hourly",),
)
def lookahead_label(spark, folder):
    out = series.lookahead(_rates(spark, folder), KEYS, TS, RATE)
    needed = F.when(
        F.col("future").isNotNull(), F.greatest(F.lit(1), (F.col("future") / 50).cast("int") + 1)
    )
    return out.select(*KEYS, TS, "future", needed.alias("future_executors"))


@query(
    "idle_runs",
    f"""SELECT event_type, min(bucket) AS run_start, max(bucket) AS run_end, count(*) AS steps, CAST(floor(count(*) / 2) AS BIGINT) AS timeouts
        FROM (SELECT event_type, bucket, workload_rate,
                     row_number() OVER ({_W}) - row_number() OVER (PARTITION BY event_type, workload_rate < 20 ORDER BY bucket) AS run
              FROM rate_hourly) z WHERE workload_rate < 20 GROUP BY event_type, run""",
    views=("rate_hourly",),
)
def idle_runs(spark, folder):
    """Idle hours in a row; two of them count as one timeout at this resolution."""
    return neutral(series.idle_runs(_rates(spark, folder), KEYS, TS, RATE, below=20.0, timeout=2))


@query(
    "ma_crossover",
    f"""SELECT event_type, bucket, round(s, 6) AS short_avg, round(l, 6) AS long_avg, CAST(s > l * 1.5E0 AS INT) AS burst_signal
        FROM (SELECT event_type, bucket, avg(workload_rate) OVER ({_W} RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS s,
                     avg(workload_rate) OVER ({_W} RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS l FROM rate_hourly) z""",
    views=("rate_hourly",),
)
def ma_crossover(spark, folder):
    out = series.ma_crossover(_rates(spark, folder), KEYS, TS, RATE, short_s=2 * 3600, long_s=24 * 3600)
    return neutral(out.select(*KEYS, TS, "short_avg", "long_avg", "burst_signal"))


@query(
    "series_diagnostics",
    """SELECT event_type, CAST(least(sample_no, 300) AS BIGINT) AS samples, CAST(least(step_no, 300) AS BIGINT) AS velocity_samples,
              round(threshold, 6) AS velocity_threshold, round((epoch_us(bucket) - epoch_us(oldest)) / 1e6, 6) AS span_seconds
       FROM (SELECT *, first_value(bucket) OVER (PARTITION BY event_type ORDER BY bucket ROWS 299 PRECEDING) AS oldest,
                    row_number() OVER (PARTITION BY event_type ORDER BY bucket DESC) AS back FROM features) f WHERE back = 1""",
    views=("features",),
)
def series_diagnostics(spark, folder):
    return neutral(series.series_diagnostics(_rates(spark, folder), KEYS, TS, RATE))


@query(
    "tail_stats",
    """SELECT event_type, round(avg(workload_rate), 6) AS tail_mean, round(stddev_pop(workload_rate), 6) AS tail_std, count(*) AS tail_rows
       FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket DESC) AS back FROM rate_hourly) r
       WHERE back <= 20 GROUP BY event_type""",
    views=("rate_hourly",),
)
def tail_stats(spark, folder):
    return neutral(series.tail_stats(_rates(spark, folder), KEYS, TS, RATE))


@query(
    "peak_bucket",
    """SELECT event_type, workload_rate AS peak, bucket AS peak_at
       FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY workload_rate DESC, bucket) AS place FROM rate_hourly) r
       WHERE place = 1""",
    views=("rate_hourly",),
)
def peak_bucket(spark, folder):
    return neutral(aggregates.peak(_rates(spark, folder), KEYS, RATE, TS))
