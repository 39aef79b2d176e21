"""Queries over smart-city readings, vitals, machines and waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dimensions
from ..functions import capacity, condition, timeparts
from ..operators import aggregates, lookups
from ..sources import views
from ..sources.tables import table
from .registry import query
from .shape import neutral

AS_OF = "2024-01-31 00:00:00"

_WINDOW_SQL = """
SELECT time_bucket(INTERVAL '{width}', ts) AS window_start, time_bucket(INTERVAL '{width}', ts) + INTERVAL '{width}' AS window_end,
       sensor_type, city, count(*) AS message_count, count(DISTINCT sensor_id) AS unique_sensors,
       round(avg(vehicle_count), 6) AS avg_vehicle_count, round(avg(average_speed_kmh), 6) AS avg_speed,
       round(avg(aqi), 6) AS avg_aqi, round(avg(pm25), 6) AS avg_pm25, round(avg(pm10), 6) AS avg_pm10,
       round(avg(occupancy_rate), 6) AS avg_parking_occupancy, max(vehicle_count) AS max_vehicle_count,
       max(aqi) AS max_aqi, max(occupancy_rate) AS max_parking_occupancy
FROM (SELECT *, round(CAST(occupied_spots AS DOUBLE) / total_spots * 100, 2) AS occupancy_rate FROM readings) r
GROUP BY ALL"""


@query("windowed_sensor_agg", _WINDOW_SQL.format(width="1 hour"), views=("readings",))
def windowed_sensor_agg(spark, folder):
    rows = aggregates.with_occupancy(views.readings(spark, folder))
    return neutral(aggregates.windowed_sensors(rows, width="1 hour", exact_sensors=True))


@query("windowed_sensor_agg_30s", _WINDOW_SQL.format(width="30 seconds"), views=("readings",))
def windowed_sensor_agg_30s(spark, folder):
    rows = aggregates.with_occupancy(views.readings(spark, folder))
    return neutral(aggregates.windowed_sensors(rows, width="30 seconds", exact_sensors=True))


@query(
    "approx_sensors",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, sensor_type, city, count(DISTINCT sensor_id) AS exact_sensors,
              TRUE AS within FROM readings GROUP BY ALL""",
    views=("readings",),
)
def approx_sensors(spark, folder):
    """Distinct sensors per window, type and city, and whether the estimate is within three times its error of 5 %."""
    rows = aggregates.with_occupancy(views.readings(spark, folder))
    keys = ["window_start", "sensor_type", "city"]
    told = aggregates.windowed_sensors(rows, width="1 hour").select(*keys, "unique_sensors")
    exact = aggregates.windowed_sensors(rows, width="1 hour", exact_sensors=True).select(
        *keys, F.col("unique_sensors").alias("exact_sensors")
    )
    off = F.abs(F.col("unique_sensors") - F.col("exact_sensors"))
    within = off <= F.greatest(F.lit(1.0), 0.15 * F.col("exact_sensors"))
    return neutral(exact.join(told, keys).select(*keys, "exact_sensors", within.alias("within")))


def raw_columns(rows):
    """The nine columns of the raw view, from a table or a stream."""
    level = condition.congestion(F.col("vehicle_count"), F.col("average_speed_kmh"))
    return rows.select(
        "sensor_id",
        "sensor_type",
        F.col("ts").alias("event_ts"),
        "vehicle_count",
        "average_speed_kmh",
        level.alias("congestion_level"),
        "aqi",
        "pm25",
        "occupancy_rate",
    )


@query(
    "raw_view",
    """SELECT sensor_id, sensor_type, ts AS event_ts, vehicle_count, average_speed_kmh,
              CASE WHEN vehicle_count > 80 AND average_speed_kmh < 25 THEN 'HIGH'
                   WHEN vehicle_count > 50 AND average_speed_kmh < 40 THEN 'MEDIUM' ELSE 'LOW' END AS congestion_level,
              aqi, pm25, round(CAST(occupied_spots AS DOUBLE) / total_spots * 100, 2) AS occupancy_rate FROM readings""",
    views=("readings",),
)
def raw_view(spark, folder):
    return neutral(raw_columns(aggregates.with_occupancy(views.readings(spark, folder))))


@query(
    "congestion_level",
    """SELECT city, CASE WHEN vehicle_count > 80 AND average_speed_kmh < 25 THEN 'HIGH'
                         WHEN vehicle_count > 50 AND average_speed_kmh < 40 THEN 'MEDIUM' ELSE 'LOW' END AS congestion_level,
              count(*) AS readings, round(avg(average_speed_kmh), 6) AS avg_speed
       FROM readings WHERE sensor_type = 'traffic' GROUP BY ALL""",
    views=("readings",),
)
def congestion_level(spark, folder):
    traffic = views.readings(spark, folder, "traffic")
    level = condition.congestion(F.col("vehicle_count"), F.col("average_speed_kmh"))
    return neutral(
        traffic.groupBy("city", level.alias("congestion_level")).agg(
            F.count(F.lit(1)).alias("readings"), F.avg("average_speed_kmh").alias("avg_speed")
        )
    )


@query(
    "parking_occupancy",
    """SELECT event_id, sensor_id, total_spots, occupied_spots, total_spots - occupied_spots AS available_spots,
              round(CAST(occupied_spots AS DOUBLE) / total_spots * 100, 2) AS occupancy_rate
       FROM readings WHERE sensor_type = 'parking'""",
    views=("readings",),
)
def parking_occupancy(spark, folder):
    parking = views.readings(spark, folder, "parking")
    return aggregates.with_occupancy(parking).select(
        "event_id",
        "sensor_id",
        "total_spots",
        "occupied_spots",
        (F.col("total_spots") - F.col("occupied_spots")).alias("available_spots"),
        "occupancy_rate",
    )


@query(
    "rush_hour_profile",
    """SELECT sensor_type, hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 AS rush_hour,
              hour(ts) BETWEEN 6 AND 20 AS daytime, count(*) AS readings, round(avg(vehicle_count), 6) AS avg_vehicles
       FROM readings GROUP BY ALL""",
    views=("readings",),
)
def rush_hour_profile(spark, folder):
    ts = F.col("ts")
    return neutral(
        views.readings(spark, folder)
        .groupBy(
            "sensor_type",
            timeparts.is_rush_hour(ts).alias("rush_hour"),
            timeparts.is_daytime(ts).alias("daytime"),
        )
        .agg(F.count(F.lit(1)).alias("readings"), F.avg("vehicle_count").alias("avg_vehicles"))
    )


@query(
    "latest_per_key",
    """SELECT sensor_id, sensor_type, ts, event_id, city, vehicle_count, aqi, pm25, occupied_spots
       FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, sensor_type ORDER BY ts DESC, event_id DESC) AS rn
             FROM readings) r WHERE rn = 1""",
    views=("readings",),
)
def latest_per_key(spark, folder):
    rows = views.readings(spark, folder).select(
        "sensor_id", "sensor_type", "ts", "event_id", "city", "vehicle_count", "aqi", "pm25", "occupied_spots"
    )
    return neutral(aggregates.latest_per_key(rows, ["sensor_id", "sensor_type"], "ts", "event_id"))


@query(
    "temperature_route",
    f"""SELECT sensor_id, accesses, round(score, 6) AS score, burst,
               CASE WHEN burst OR score > 0.8 THEN 'HOT' WHEN score > 0.3 THEN 'WARM' ELSE 'COLD' END AS tier
        FROM (SELECT sensor_id, count(*) AS accesses,
                     0.5E0 * count(*) / ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(ts))) / 86.4e9)
                     + 2.0E0 / ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3.6e9) AS score,
                     count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) >= 3 AS burst
              FROM readings WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY sensor_id) s""",
    views=("readings",),
)
def temperature_route(spark, folder):
    scored = aggregates.temperature(views.readings(spark, folder), "sensor_id", "ts", AS_OF, 0.5, 2.0)
    return neutral(
        scored.withColumn("tier", capacity.temperature_route(F.col("score"), F.col("burst")))
    )


@query(
    "waveform_prefix",
    """SELECT vec_id, CAST(len(embedding[1:20]) AS INT) AS points, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[1:20]]), 6) AS total,
              round(CAST(embedding[1] AS DOUBLE), 6) AS first_point, round(CAST(embedding[20] AS DOUBLE), 6) AS last_point
       FROM embeddings""",
)
def waveform_prefix(spark, folder):
    """The first 20 points of each waveform; the vectors stand in for ECG waves."""
    head = F.slice("embedding", 1, 20)
    doubles = F.transform(head, lambda x: x.cast("double"))
    return neutral(
        table(spark, folder, "embeddings").select(
            "vec_id",
            F.size(head).alias("points"),
            F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x).alias("total"),
            F.get(head, F.lit(0)).cast("double").alias("first_point"),
            F.get(head, F.lit(19)).cast("double").alias("last_point"),
        )
    )


@query(
    "vitals_clamp",
    """SELECT event_id, greatest(40, least(180, heart_rate)) AS heart_rate, greatest(85, least(100, spo2)) AS spo2,
              greatest(35, least(42, temperature)) AS temperature, greatest(80, least(200, systolic_bp)) AS systolic_bp,
              greatest(50, least(120, diastolic_bp)) AS diastolic_bp,
              greatest(8, least(30, resp_rate)) AS resp_rate FROM vitals""",
    views=("vitals",),
)
def vitals_clamp(spark, folder):
    names = ["heart_rate", "spo2", "temperature", "systolic_bp", "diastolic_bp", "resp_rate"]
    return neutral(
        views.vitals(spark, folder).select(
            "event_id", *[condition.clamp_vital(n).alias(n) for n in names]
        )
    )


def _labels_sql(low_hr: int, high_hr: int, sbp: int, sepsis: bool) -> str:
    parts = [
        f"CASE WHEN heart_rate < {low_hr} OR heart_rate > {high_hr} THEN 'Cardiac Risk' END",
        "CASE WHEN spo2 < 92 THEN 'Hypoxia' END",
        "CASE WHEN temperature > 39.5 THEN 'Hyperthermia' END",
        f"CASE WHEN systolic_bp < {sbp} THEN 'Haemodynamic Shock' END",
        "CASE WHEN resp_rate > 22 THEN 'Respiratory Distress' END",
    ]
    if sepsis:
        parts.append(
            "CASE WHEN spo2 < 92 AND heart_rate > 106 AND temperature > 38.8 AND resp_rate > 22 THEN 'Sepsis Risk' END"
        )
    return f"concat_ws('|', {', '.join(parts)})"


@query(
    "vitals_alerts",
    f"SELECT * FROM (SELECT event_id, patient_id, ward, {_labels_sql(40, 120, 90, False)} AS alerts FROM vitals) v WHERE alerts <> ''",
    views=("vitals",),
)
def vitals_alerts(spark, folder):
    rules = dimensions.RULES["base"]
    labels = F.array_join(condition.alert_labels(rules), "|")
    rows = views.vitals(spark, folder).filter(condition.raised(rules))
    return rows.select("event_id", "patient_id", "ward", labels.alias("alerts"))


@query(
    "vitals_alerts_strict",
    f"SELECT * FROM (SELECT event_id, patient_id, ward, {_labels_sql(45, 130, 88, True)} AS alerts FROM vitals) v WHERE alerts <> ''",
    views=("vitals",),
)
def vitals_alerts_strict(spark, folder):
    rules = dimensions.RULES["strict"]
    labels = F.array_join(condition.alert_labels(rules, with_sepsis=True), "|")
    rows = views.vitals(spark, folder).filter(condition.raised(rules) | condition.sepsis())
    return rows.select("event_id", "patient_id", "ward", labels.alias("alerts"))


@query(
    "rule_variants",
    """SELECT ward, count(*) FILTER (WHERE heart_rate < 40 OR heart_rate > 120 OR spo2 < 92 OR temperature > 39.5 OR systolic_bp < 90 OR resp_rate > 22) AS base,
              count(*) FILTER (WHERE heart_rate < 45 OR heart_rate > 130 OR spo2 < 92 OR temperature > 39.5 OR systolic_bp < 88 OR resp_rate > 22) AS strict,
              count(*) FILTER (WHERE heart_rate > 130 OR spo2 < 92 OR temperature > 39.5 OR systolic_bp < 88) AS capacity
       FROM vitals GROUP BY ward""",
    views=("vitals",),
)
def rule_variants(spark, folder):
    """Patients alerted per ward under each rule set."""
    counts = [
        F.count_if(condition.raised(dimensions.RULES[r])).alias(r)
        for r in ("base", "strict", "capacity")
    ]
    return views.vitals(spark, folder).groupBy("ward").agg(*counts)


@query(
    "alert_priority",
    """SELECT event_id, patient_id, CASE WHEN heart_rate < 45 OR heart_rate > 130 THEN 'Cardiac Risk'
              WHEN spo2 < 92 AND heart_rate > 106 AND temperature > 38.8 AND resp_rate > 22 THEN 'Sepsis Risk'
              WHEN temperature > 39.5 THEN 'Hyperthermia' WHEN spo2 < 92 THEN 'Hypoxia'
              WHEN systolic_bp < 88 THEN 'Haemodynamic Shock' END AS alert FROM vitals""",
    views=("vitals",),
)
def alert_priority(spark, folder):
    labels = condition.alert_labels(dimensions.RULES["strict"], with_sepsis=True)
    return views.vitals(spark, folder).select(
        "event_id", "patient_id", condition.leading_alert(labels).alias("alert")
    )


@query(
    "alerts_long",
    """SELECT event_id, patient_id, 'Cardiac Risk' AS label, 'heart_rate' AS metric, heart_rate AS value FROM vitals WHERE heart_rate < 40 OR heart_rate > 120
       UNION ALL SELECT event_id, patient_id, 'Hypoxia', 'spo2', spo2 FROM vitals WHERE spo2 < 92
       UNION ALL SELECT event_id, patient_id, 'Hyperthermia', 'temperature', temperature FROM vitals WHERE temperature > 39.5
       UNION ALL SELECT event_id, patient_id, 'Haemodynamic Shock', 'systolic_bp', systolic_bp FROM vitals WHERE systolic_bp < 90
       UNION ALL SELECT event_id, patient_id, 'Respiratory Distress', 'resp_rate', resp_rate FROM vitals WHERE resp_rate > 22""",
    views=("vitals",),
)
def alerts_long(spark, folder):
    rules = dimensions.RULES["base"]
    alerted = views.vitals(spark, folder).filter(condition.raised(rules))
    entries = alerted.select("event_id", "patient_id", F.inline(condition.alert_entries(rules)))
    return entries.filter(F.col("label").isNotNull())


@query(
    "alert_rate_by_ward",
    """SELECT ward, count(*) AS processed, count(*) FILTER (WHERE raised) AS alerted, round(avg(CAST(raised AS INT)), 6) AS alert_rate
       FROM (SELECT ward, heart_rate < 40 OR heart_rate > 120 OR spo2 < 92 OR temperature > 39.5 OR systolic_bp < 90 OR resp_rate > 22 AS raised
             FROM vitals) v GROUP BY ward""",
    views=("vitals",),
)
def alert_rate_by_ward(spark, folder):
    raised = condition.raised(dimensions.RULES["base"])
    return neutral(
        views.vitals(spark, folder)
        .select("ward", raised.alias("raised"))
        .groupBy("ward")
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if("raised").alias("alerted"),
            F.avg(F.col("raised").cast("int")).alias("alert_rate"),
        )
    )


@query(
    "distinct_wards",
    """SELECT date_trunc('hour', ts) AS bucket, string_agg(DISTINCT ward, ',' ORDER BY ward) AS wards, count(DISTINCT ward) AS ward_count
       FROM vitals GROUP BY 1""",
    views=("vitals",),
)
def distinct_wards(spark, folder):
    """Wards heard from in each hour. The set of wards is fixed and short, so the set stays small."""
    per_ward = (
        views.vitals(spark, folder).select(timeparts.bucket(F.col("ts")).alias("bucket"), "ward").distinct()
    )
    return per_ward.groupBy("bucket").agg(
        F.array_join(F.sort_array(F.collect_set("ward")), ",").alias("wards"),
        F.count("ward").alias("ward_count"),
    )


@query(
    "machine_status",
    """SELECT event_id, machine_id, machine_type, wear_level < 0.95 AS operational,
              CASE WHEN is_anomaly AND wear_level > 0.7 THEN 'CRITICAL' WHEN is_anomaly THEN 'WARNING' ELSE 'NORMAL' END AS alert_level,
              CAST(trunc((1.0E0 - wear_level) * 1000) AS INT) AS remaining_life_hours,
              round(greatest(50, 100 - wear_level * 30), 6) AS efficiency_percent FROM machines""",
    views=("machines",),
)
def machine_status(spark, folder):
    status = condition.machine_status(F.col("wear_level"), F.col("is_anomaly"))
    return neutral(
        views.machines(spark, folder).select(
            "event_id", "machine_id", "machine_type", *[c.alias(n) for n, c in status.items()]
        )
    )


@query(
    "edge_asof_join",
    """SELECT v.event_id, v.patient_id, v.ts, v.heart_rate, s.predicted_load, s.burst_alarm
       FROM vitals v ASOF LEFT JOIN signals s ON v.patient_id = s.patient_id AND v.ts >= s.ts""",
    views=("vitals", "signals"),
)
def edge_asof_join(spark, folder):
    rows = views.vitals(spark, folder).select("event_id", "patient_id", "ts", "heart_rate")
    return neutral(
        lookups.asof_join(
            rows, views.signals(spark, folder), ["patient_id"], "ts", ["predicted_load", "burst_alarm"]
        )
    )


MID = "2024-01-15 12:00:00"


@query(
    "temperature_midway",
    f"""SELECT sensor_id, count(*) AS accesses,
               round(0.5E0 * count(*) / ((epoch_us(TIMESTAMP '{MID}') - epoch_us(min(ts))) / 86.4e9)
                     + 2.0E0 / ((epoch_us(TIMESTAMP '{MID}') - epoch_us(max(ts))) / 3.6e9), 6) AS score,
               count(*) FILTER (WHERE ts >= TIMESTAMP '{MID}' - INTERVAL 1 DAY) >= 2 AS burst
        FROM readings WHERE ts <= TIMESTAMP '{MID}' GROUP BY sensor_id""",
    views=("readings",),
)
def temperature_midway(spark, folder):
    """Temperatures as of a moment within the table; what comes later has not happened yet."""
    rows = views.readings(spark, folder)
    return neutral(aggregates.temperature(rows, "sensor_id", "ts", MID, 0.5, 2.0, burst_reads=2))
