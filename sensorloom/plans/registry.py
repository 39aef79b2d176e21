"""Query registry and the SQL text of the fixture views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Build], Build]:
    """Register a query; ``sql`` is its twin over the raw tables plus the named views."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return build

    return register


def with_views(sql: str, views: tuple[str, ...]) -> str:
    if not views:
        return sql.strip()
    needed: list[str] = []
    for view in views:
        for name in (*VIEW_NEEDS.get(view, ()), view):
            if name not in needed:
                needed.append(name)
    clauses = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    body = sql.strip()
    joiner = ",\n" if body.startswith("+") else "\n"
    return f"WITH {clauses}{joiner}{body.lstrip('+').strip()}"


VIEW_NEEDS = {
    "batch_log": ("rate_hourly",),
    "probe": ("envelope",),
    "moves": ("rate_hourly",),
    "features": ("rate_hourly", "moves"),
    "episodes": ("rate_hourly", "batch_log"),
}

VIEWS = {
    "readings": """
SELECT event_id, ts, 'SC-' || CAST(user_id AS VARCHAR) AS sensor_id, sensor_type,
       'city_' || CAST(user_id % 4 AS VARCHAR) AS city,
       CASE WHEN sensor_type = 'traffic' THEN CAST(20 + (event_id * 37) % 130 AS INT) END AS vehicle_count,
       CASE WHEN sensor_type = 'traffic' THEN 15 + CAST((event_id * 13) % 500 AS DOUBLE) / 10 END AS average_speed_kmh,
       CASE WHEN sensor_type = 'pollution' THEN CAST(30 + (event_id * 17) % 90 AS INT) END AS aqi,
       CASE WHEN sensor_type = 'pollution' THEN value END AS pm25,
       CASE WHEN sensor_type = 'pollution' THEN value * 2 END AS pm10,
       CASE WHEN sensor_type = 'parking' THEN CAST(50 + (event_id * 7) % 151 AS INT) END AS total_spots,
       CASE WHEN sensor_type = 'parking' THEN CAST((event_id * 11) % (51 + (event_id * 7) % 151) AS INT) END AS occupied_spots
FROM (SELECT *, CASE WHEN event_type IN ('click', 'signup') THEN 'traffic' WHEN event_type = 'view' THEN 'pollution' ELSE 'parking' END AS sensor_type
      FROM events) e""",
    "vitals": """
SELECT event_id, ts, 'PT-' || CAST(user_id AS VARCHAR) AS patient_id,
       CASE user_id % 5 WHEN 0 THEN 'ICU' WHEN 1 THEN 'Emergency' WHEN 2 THEN 'Cardiology' WHEN 3 THEN 'Neonatal' ELSE 'General' END AS ward,
       CAST(35 + (event_id * 37) % 141 AS DOUBLE) AS heart_rate,
       80 + CAST((event_id * 17) % 200 AS DOUBLE) / 10 AS spo2,
       35 + CAST((event_id * 23) % 60 AS DOUBLE) / 10 AS temperature,
       CAST(70 + (event_id * 29) % 81 AS DOUBLE) AS systolic_bp,
       CAST(45 + (event_id * 19) % 91 AS DOUBLE) AS diastolic_bp,
       CAST(8 + (event_id * 31) % 25 AS DOUBLE) AS resp_rate
FROM events""",
    "machines": """
SELECT event_id, ts, 'MCH-' || CAST(user_id % 20 AS VARCHAR) AS machine_id,
       CASE user_id % 5 WHEN 0 THEN 'CNC_Mill' WHEN 1 THEN 'Lathe' WHEN 2 THEN 'Press' WHEN 3 THEN 'Welder' ELSE 'Conveyor' END AS machine_type,
       CAST((event_id * 41) % 1000 AS DOUBLE) / 1000 AS wear_level, event_id % 7 = 0 AS is_anomaly, value AS vibration_mms
FROM events""",
    "rate_hourly": """
SELECT event_type, bucket, n, (n - 1) * 45.0E0 AS workload_rate,
       least(100.0E0, (n - 1) * 9.0E0) AS cpu_util,
       100 + (n - 1) * 22.5E0 AS latency_ms
FROM (SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n
      FROM events GROUP BY event_type, date_trunc('hour', ts)) g""",
    "batch_log": """
SELECT event_type, bucket, n AS message_count, workload_rate AS workload, latency_ms, cpu_util,
       CAST(floor(workload_rate / 50) AS BIGINT) + 1 AS executors,
       (CAST(floor(workload_rate / 50) AS BIGINT) + 1) * 0.5E0 AS cost,
       workload_rate * 0.9E0 AS throughput
FROM rate_hourly""",
    "signals": """
SELECT 'PT-' || CAST(user_id AS VARCHAR) AS patient_id, ts, value AS predicted_load, event_id % 2 = 0 AS burst_alarm
FROM events WHERE event_type = 'signup'""",
    "envelope": """
SELECT CASE WHEN event_type = 'click' THEN 'iot/smartcity/sensors' WHEN event_type = 'view' THEN 'iot/healthcare/vitals'
            WHEN event_type = 'purchase' THEN 'iot/industrial/machines' ELSE 'iot/other/raw' END AS topic,
       CAST(user_id % 8 AS INT) AS partition,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS key,
       CASE WHEN event_id % 50 = 0 THEN '{bad' WHEN event_id % 50 = 1 THEN '' WHEN event_id % 50 = 2 THEN '   '
         WHEN event_id % 50 = 3 THEN NULL WHEN event_id % 50 = 4 THEN traffic || ' junk' WHEN event_id % 50 = 5 THEN '{''sensor_id'':''q''}'
         WHEN event_type = 'click' THEN traffic
         WHEN event_type = 'view' THEN '{"sensor_id":"","device_id":"DEV-' || CAST(user_id AS VARCHAR) || '","device_type":"vital_signs_monitor","timestamp":"2024-01-01T' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':30:00","vitals":{"heart_rate_bpm":' || CAST(40 + (event_id * 37) % 141 AS VARCHAR) || ',"oxygen_saturation_percent":' || CAST(85 + event_id % 15 AS VARCHAR) || '}}'
         WHEN event_type = 'purchase' THEN '{"machine_id":"MCH-' || CAST(user_id % 20 AS VARCHAR) || '","machine_type":"Press","timestamp":"not a time","sensors":{"temperature_celsius":' || CAST(60 + event_id % 40 AS VARCHAR) || ',"vibration_mms":' || CAST(event_id % 5 AS VARCHAR) || '}}'
         ELSE '{"note":"unidentified"}' END AS value,
       ts AS timestamp, event_id AS offset
FROM (SELECT *, '{"sensor_id":"SC-' || CAST(user_id AS VARCHAR) || '","sensor_type":"traffic","city":"city_' || CAST(user_id % 4 AS VARCHAR) || '","timestamp":"2024-01-01T' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':00:00","location":{"latitude":40,"longitude":-74},"metrics":{"vehicle_count":' || CAST(20 + (event_id * 37) % 130 AS VARCHAR) || ',"average_speed_kmh":' || CAST(15 + (event_id * 13) % 50 AS VARCHAR) || ',"congestion_level":"LOW"}}' AS traffic FROM events) e""",
    "probe": """
SELECT *, CASE WHEN json_valid(value) THEN value END AS j FROM envelope""",
    "policy_runs": """
SELECT l_linestatus AS scenario, l_returnflag AS policy, l_orderkey * 10 + l_linenumber AS step,
       l_extendedprice / 100 AS latency_ms, l_quantity AS executors, l_quantity * 0.1E0 AS cost
FROM lineitem""",
    "moves": """
SELECT *, coalesce(last_value(step IGNORE NULLS) OVER w, 0) AS velocity,
       coalesce(step - lag(step) OVER w, 0) AS acceleration, sample_no - 1 AS step_no
FROM (SELECT *, row_number() OVER w AS sample_no,
             (workload_rate - lag(workload_rate) OVER w) / ((epoch_us(bucket) - lag(epoch_us(bucket)) OVER w) / 1e6) AS step
      FROM rate_hourly WINDOW w AS (PARTITION BY event_type ORDER BY bucket)) s
WINDOW w AS (PARTITION BY event_type ORDER BY bucket)""",
    "features": """
SELECT *, CASE WHEN step_no >= 5 AND threshold > 0
               THEN greatest(0, least(1, 0.6E0 / (1 + exp(-5 * (velocity / threshold - 1)))
                    + 0.4E0 * coalesce(rises, 0) / (least(step_no, 10) - 1))) ELSE 0 END AS burst_probability,
       avg(workload_rate) OVER (PARTITION BY event_type ORDER BY bucket ROWS 299 PRECEDING) AS rolling_mean,
       stddev_pop(workload_rate) OVER (PARTITION BY event_type ORDER BY bucket ROWS 299 PRECEDING) AS rolling_std
FROM (SELECT *, last_value(CASE WHEN sample_no = 6 OR (sample_no >= 50 AND sample_no % 50 = 0) THEN p90 END IGNORE NULLS)
                  OVER (PARTITION BY event_type ORDER BY bucket) AS threshold,
             sum(rise) OVER (PARTITION BY event_type ORDER BY bucket ROWS 8 PRECEDING) AS rises
      FROM (SELECT *, quantile_cont(step, 0.9) OVER (PARTITION BY event_type ORDER BY bucket ROWS 299 PRECEDING) AS p90,
                   CAST(acceleration > 0 AS INT) AS rise FROM moves) a) b""",
    "episodes": """
SELECT event_type, episode, min(bucket) AS started_at, avg(latency_ms) AS avg_latency_ms, sum(cost) AS total_cost,
       avg(throughput) AS avg_throughput, count(*) FILTER (WHERE latency_ms > 200) AS violations,
       sum(0.34E0 * throughput / 200 - 0.33E0 * cost / 10 - 0.33E0 * latency_ms / 1000) AS reward_sum, count(*) AS steps
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY bucket) - 1) / 5) AS BIGINT) + 1 AS episode
      FROM batch_log) b
GROUP BY event_type, episode HAVING count(*) = 5""",
}
