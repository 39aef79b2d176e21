"""Queries over message envelopes: decode, parse, route, set aside."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dimensions, schemas
from ..functions import condition, message
from ..operators import lookups, messages
from ..sources import ranges, views
from ..sources.tables import table
from .registry import query
from .shape import neutral

AS_OF = "2024-01-31 00:00:00"
CITY_TOPICS = ("iot/smartcity/sensors", "iot/healthcare/vitals", "iot/industrial/machines")
PATTERNS = {
    "any_iot": "iot/#",
    "any_vitals": "iot/+/vitals",
    "any_data": "iot/+/data",
    "machine_feed": "iot/industrial/machines",
}


def _decoded(spark, folder):
    """Envelopes as the log delivers them: key and value are bytes."""
    raw = views.envelope(spark, folder).withColumns(
        {"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary")}
    )
    return messages.decode(raw)


@query(
    "envelope_decode",
    'SELECT topic, key, value, "timestamp" AS broker_ts, partition, "offset" FROM envelope',
    views=("envelope",),
)
def envelope_decode(spark, folder):
    return neutral(_decoded(spark, folder))


@query(
    "multi_topic_preview",
    """SELECT "offset", topic, key AS sensor_id, length(value) AS data_length FROM envelope
       WHERE topic IN ('iot/smartcity/sensors', 'iot/healthcare/vitals', 'iot/industrial/machines')""",
    views=("envelope",),
)
def multi_topic_preview(spark, folder):
    subscribed = views.envelope(spark, folder).filter(F.col("topic").isin(*CITY_TOPICS))
    out = messages.preview(subscribed)
    return out.withColumn("data_length", F.col("data_length").cast("bigint"))


@query(
    "bounded_read",
    'SELECT "offset", topic, key, value FROM envelope ORDER BY "offset" LIMIT 100',
    views=("envelope",),
)
def bounded_read(spark, folder):
    return _decoded(spark, folder).select("offset", "topic", "key", "value").orderBy("offset").limit(100)


# Two topics, each partition from its own offset to its own end.
_RANGES = [
    ranges.OffsetRange(topic, p, 40 * p, 700 + 90 * p) for topic in ("iot/smartcity/sensors", "iot/healthcare/vitals") for p in range(8)
]
_IN_RANGES = """topic IN ('iot/smartcity/sensors', 'iot/healthcare/vitals') AND "offset" >= 40 * partition AND "offset" < 700 + 90 * partition"""


@query("bounded_read_ranges", f'SELECT "offset", topic, partition, key FROM envelope WHERE {_IN_RANGES}', views=("envelope",))
def bounded_read_ranges(spark, folder):
    return _decoded(spark, folder).filter(ranges.within(_RANGES)).select("offset", "topic", "partition", "key")


@query(
    "range_losses",
    f"""SELECT r.topic, r.partition, r.last - r.first AS expected, count(DISTINCT e."offset") AS found, r.last - r.first - count(DISTINCT e."offset") AS missing
        FROM (SELECT t.topic, CAST(p AS INT) AS partition, 40 * p AS first, 700 + 90 * p AS last
              FROM (VALUES ('iot/smartcity/sensors'), ('iot/healthcare/vitals')) t(topic), range(8) r(p)) r
        LEFT JOIN (SELECT * FROM envelope WHERE {_IN_RANGES}) e ON e.topic = r.topic AND e.partition = r.partition
        GROUP BY r.topic, r.partition, r.first, r.last""",
    views=("envelope",),
)
def range_losses(spark, folder):
    """How many offsets of each range the log holds; its topics share one count, so most are missing."""
    return ranges.losses(_decoded(spark, folder), _RANGES)


@query(
    "json_parse",
    """SELECT "offset", j ->> '$.sensor_id' AS sensor_id, j ->> '$.sensor_type' AS sensor_type, j ->> '$.city' AS city,
              CAST(j ->> '$.metrics.vehicle_count' AS INT) AS vehicle_count,
              j ->> '$.metrics.congestion_level' AS congestion_level
       FROM probe""",
    views=("probe",),
)
def json_parse(spark, folder):
    parsed = messages.parse(_decoded(spark, folder), schemas.SMART_CITY)
    return parsed.select(
        "offset",
        "data.sensor_id",
        "data.sensor_type",
        "data.city",
        "data.metrics.vehicle_count",
        "data.metrics.congestion_level",
    )


_METRIC_SQL = ", ".join(
    f"CAST(j ->> '$.metrics.{n}' AS {t}) AS {n}"
    for n, t in [
        ("vehicle_count", "INT"),
        ("average_speed_kmh", "DOUBLE"),
        ("congestion_level", "VARCHAR"),
        ("lane_occupancy_percent", "DOUBLE"),
        ("aqi", "INT"),
        ("pm25", "DOUBLE"),
        ("pm10", "DOUBLE"),
        ("co2_ppm", "INT"),
        ("temperature_celsius", "DOUBLE"),
        ("humidity_percent", "DOUBLE"),
        ("total_spots", "INT"),
        ("occupied_spots", "INT"),
        ("available_spots", "INT"),
        ("occupancy_rate", "DOUBLE"),
    ]
)


@query(
    "json_flatten",
    f"""SELECT key AS sensor_key, "offset", j ->> '$.sensor_id' AS sensor_id, j ->> '$.sensor_type' AS sensor_type,
               j ->> '$.city' AS city, TRY_CAST(j ->> '$.timestamp' AS TIMESTAMP) AS event_ts,
               CAST(j ->> '$.location.latitude' AS DOUBLE) AS latitude,
               CAST(j ->> '$.location.longitude' AS DOUBLE) AS longitude, {_METRIC_SQL}, "timestamp" AS broker_ts
        FROM probe""",
    views=("probe",),
)
def json_flatten(spark, folder):
    return neutral(messages.flatten_city(_decoded(spark, folder)))


@query(
    "event_time_parse",
    """SELECT "offset", j ->> '$.timestamp' AS raw_time, TRY_CAST(j ->> '$.timestamp' AS TIMESTAMP) AS event_ts FROM probe""",
    views=("probe",),
)
def event_time_parse(spark, folder):
    probed = messages.probe(_decoded(spark, folder))
    raw = F.col("m.timestamp")
    return neutral(
        probed.select("offset", raw.alias("raw_time"), message.event_time(raw).alias("event_ts"))
    )


_IDENTITY = ", ".join(f"nullif(j ->> '$.{n}_id', '')" for n in ("sensor", "device", "machine"))
_KIND = ", ".join(f"nullif(j ->> '$.{n}_type', '')" for n in ("sensor", "device", "machine"))


@query(
    "canonical_identity",
    f"""SELECT "offset", coalesce({_IDENTITY}, 'unknown') AS device_ref,
               coalesce({_KIND}, 'unknown') AS device_kind FROM probe""",
    views=("probe",),
)
def canonical_identity(spark, folder):
    probed = messages.identified(messages.probe(_decoded(spark, folder)))
    return probed.select("offset", "device_ref", "device_kind")


@query(
    "payload_kind",
    """SELECT "offset",
              CASE WHEN (j -> '$.metrics') IS NOT NULL THEN 'metrics' WHEN (j -> '$.vitals') IS NOT NULL THEN 'vitals'
                   WHEN (j -> '$.sensors') IS NOT NULL THEN 'sensors' ELSE 'none' END AS kind,
              CASE WHEN (j -> '$.metrics') IS NOT NULL THEN
                'vehicle_count=' || (j ->> '$.metrics.vehicle_count') || ',average_speed_kmh='
                || (j ->> '$.metrics.average_speed_kmh') || ',congestion_level=' || (j ->> '$.metrics.congestion_level') END AS first_metrics,
              j ->> '$.vitals.heart_rate_bpm' AS heart_rate, j ->> '$.vitals.oxygen_saturation_percent' AS spo2,
              j ->> '$.sensors.temperature_celsius' AS temperature, j ->> '$.sensors.vibration_mms' AS vibration
       FROM probe""",
    views=("probe",),
)
def payload_kind(spark, folder):
    probed = messages.probe(_decoded(spark, folder), blocks=True)
    return probed.select(
        "offset",
        message.payload_kind("m.").alias("kind"),
        F.when(F.col("m.metrics").isNotNull(), message.first_entries(F.col("m.metrics"))).alias(
            "first_metrics"
        ),
        F.col("m.vitals")["heart_rate_bpm"].alias("heart_rate"),
        F.col("m.vitals")["oxygen_saturation_percent"].alias("spo2"),
        F.col("m.sensors")["temperature_celsius"].alias("temperature"),
        F.col("m.sensors")["vibration_mms"].alias("vibration"),
    )


@query(
    "domain_union",
    """SELECT "offset", CASE topic WHEN 'iot/smartcity/sensors' THEN 'smartcity' WHEN 'iot/healthcare/vitals' THEN 'healthcare'
                             ELSE 'industrial' END AS domain,
              CASE topic WHEN 'iot/smartcity/sensors' THEN j ->> '$.sensor_id' WHEN 'iot/healthcare/vitals' THEN j ->> '$.device_id'
                         ELSE j ->> '$.machine_id' END AS device_ref,
              TRY_CAST(j ->> '$.timestamp' AS TIMESTAMP) AS event_ts,
              CAST(j ->> '$.metrics.vehicle_count' AS INT) AS vehicle_count,
              CAST(j ->> '$.metrics.average_speed_kmh' AS DOUBLE) AS speed_kmh,
              CAST(j ->> '$.vitals.heart_rate_bpm' AS INT) AS heart_rate_bpm,
              CAST(j ->> '$.vitals.oxygen_saturation_percent' AS DOUBLE) AS oxygen_percent,
              CAST(j ->> '$.sensors.temperature_celsius' AS DOUBLE) AS machine_celsius,
              CAST(j ->> '$.sensors.vibration_mms' AS DOUBLE) AS vibration_mms
       FROM probe WHERE topic <> 'iot/other/raw'""",
    views=("probe",),
)
def domain_union(spark, folder):
    """One scan; the topic chooses the schema each payload is parsed with."""
    return neutral(messages.merged_domains(_decoded(spark, folder)))


@query(
    "topic_match",
    r"""SELECT "offset", topic, split_part(topic, '/', 2) AS domain, split_part(topic, '/', 3) AS feed,
               regexp_matches(topic, '^iot(/.*)?$') AS any_iot, regexp_matches(topic, '^iot/[^/]+/vitals$') AS any_vitals,
               regexp_matches(topic, '^iot/[^/]+/data$') AS any_data, topic = 'iot/industrial/machines' AS machine_feed
        FROM envelope""",
    views=("envelope",),
)
def topic_match(spark, folder):
    topic = F.col("topic")
    return views.envelope(spark, folder).select(
        "offset",
        "topic",
        message.topic_level(topic, 1).alias("domain"),
        message.topic_level(topic, 2).alias("feed"),
        *[message.topic_matches(topic, p).alias(name) for name, p in PATTERNS.items()],
    )


_TARGET = """CASE topic WHEN 'iot/smartcity/sensors' THEN 'iot-smartcity-raw' WHEN 'iot/healthcare/vitals' THEN 'iot-healthcare-raw'
                    WHEN 'iot/industrial/machines' THEN 'iot-industrial-raw' ELSE 'iot-unknown-raw' END"""


@query(
    "route_topics",
    f"""SELECT "offset", {_TARGET} AS topic, coalesce({_IDENTITY}) AS key, value FROM probe WHERE j IS NOT NULL""",
    views=("probe",),
)
def route_topics(spark, folder):
    good, _ = messages.split_faulty(messages.probe(_decoded(spark, folder)))
    return lookups.route(good).select(
        "offset", F.col("target_topic").alias("topic"), message.device_ref("m.").alias("key"), "value"
    )


@query(
    "json_serialize",
    """SELECT 'iot-analytics-results' AS topic, patient_id AS key,
              '{"event_id":' || CAST(event_id AS VARCHAR) || ',"patient_id":"' || patient_id || '","ward":"' || ward
              || '","heart_rate":' || CAST(CAST(heart_rate AS BIGINT) AS VARCHAR) || '}' AS value
       FROM vitals""",
    views=("vitals",),
)
def json_serialize(spark, folder):
    rows = views.vitals(spark, folder).withColumn("heart_rate", F.col("heart_rate").cast("bigint"))
    return messages.as_records(
        rows,
        F.lit(dimensions.ANALYTICS_TOPIC),
        F.col("patient_id"),
        "event_id",
        "patient_id",
        "ward",
        "heart_rate",
    )


@query(
    "dead_letter",
    """SELECT topic AS original_topic, key AS original_key, value AS original_data,
              CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty payload' ELSE 'malformed JSON' END AS error,
              "timestamp" AS failed_at FROM probe WHERE j IS NULL""",
    views=("probe",),
)
def dead_letter(spark, folder):
    return neutral(messages.dead_letters(messages.probe(_decoded(spark, folder))))


@query(
    "invalid_letter",
    f"""SELECT * FROM (
          SELECT topic AS original_topic, key AS original_key, value AS original_data,
                 CASE WHEN coalesce({_IDENTITY}) IS NULL THEN 'no device identity'
                      WHEN (j ->> '$.timestamp') IS NOT NULL AND TRY_CAST(j ->> '$.timestamp' AS TIMESTAMP) IS NULL THEN 'unreadable time' END AS error,
                 "timestamp" AS failed_at FROM probe WHERE j IS NOT NULL) e WHERE error IS NOT NULL""",
    views=("probe",),
)
def invalid_letter(spark, folder):
    """Readable messages that fail validation, with the cause."""
    good, _ = messages.split_faulty(messages.probe(_decoded(spark, folder)))
    return neutral(messages.dead_letters(good, messages.invalid()))


@query(
    "alert_envelope",
    """SELECT * FROM (
         SELECT event_id, patient_id, ward, CASE WHEN spo2 < 92 AND heart_rate > 106 AND temperature > 38.8 AND resp_rate > 22
                  THEN 'critical' ELSE 'normal' END AS alert_priority, ts AS alert_time, 'iot-alerts-critical' AS target_topic,
                heart_rate > 120 OR heart_rate < 40 OR spo2 < 92 OR temperature > 39.5 OR systolic_bp < 90 OR resp_rate > 22 AS raised
         FROM vitals) v WHERE raised""",
    views=("vitals",),
)
def alert_envelope(spark, folder):
    rows = views.vitals(spark, folder)
    raised = condition.raised(dimensions.RULES["base"])
    priority = F.when(condition.sepsis(), "critical").otherwise("normal")
    alerts = messages.as_alert(rows.withColumn("raised", raised).filter("raised"), priority, F.col("ts"))
    return neutral(
        alerts.select(
            "event_id", "patient_id", "ward", "alert_priority", "alert_time", "target_topic", "raised"
        )
    )


@query(
    "heat_alerts",
    """SELECT "offset", temperature_celsius, temperature_celsius > 45 AS over_45, temperature_celsius > 80 AS over_80
       FROM (SELECT "offset", CAST(j ->> '$.sensors.temperature_celsius' AS DOUBLE) AS temperature_celsius FROM probe) t
       WHERE temperature_celsius IS NOT NULL""",
    views=("probe",),
)
def heat_alerts(spark, folder):
    machine = messages.merged_domains(_decoded(spark, folder).filter(F.col("topic") == CITY_TOPICS[2]))
    rows = machine.select("offset", F.col("machine_celsius").alias("temperature_celsius"))
    (warm,), (hot,) = dimensions.RULES["heat_45"], dimensions.RULES["heat_80"]
    return neutral(
        rows.dropna().withColumns({"over_45": condition.breaks(warm), "over_80": condition.breaks(hot)})
    )


def _topic_names(spark, folder):
    """Topics as a broker lists them: one per route, and one internal one per event type."""
    routed = lookups.route(views.envelope(spark, folder)).select("target_topic", "topic")
    return routed.select(
        F.explode(
            F.array("target_topic", F.concat(F.lit("_"), F.replace("topic", F.lit("/"), F.lit("-"))))
        ).alias("target_topic")
    ).distinct()


@query(
    "visible_topics",
    f"""SELECT target_topic FROM (
          SELECT DISTINCT {_TARGET} AS target_topic FROM envelope
          UNION SELECT DISTINCT '_' || replace(topic, '/', '-') FROM envelope) t
        WHERE NOT starts_with(target_topic, '_') ORDER BY target_topic""",
    views=("envelope",),
)
def visible_topics(spark, folder):
    names = _topic_names(spark, folder)
    return names.filter(~F.col("target_topic").startswith("_")).orderBy("target_topic")


_EXPECTED = ", ".join(f"('{t[0]}')" for t in dimensions.TOPIC_POLICY)


@query(
    "expected_present",
    f"""SELECT target_topic FROM (VALUES {_EXPECTED}) e(target_topic)
        WHERE target_topic IN (SELECT {_TARGET} FROM envelope)""",
    views=("envelope",),
)
def expected_present(spark, folder):
    expected = dimensions.topic_policy(spark).select("target_topic")
    return lookups.present(expected, lookups.route(views.envelope(spark, folder)), "target_topic")


@query(
    "expected_missing",
    f"""SELECT target_topic FROM (VALUES {_EXPECTED}) e(target_topic)
        WHERE target_topic NOT IN (SELECT {_TARGET} FROM envelope)""",
    views=("envelope",),
)
def expected_missing(spark, folder):
    expected = dimensions.topic_policy(spark).select("target_topic")
    return lookups.missing(expected, lookups.route(views.envelope(spark, folder)), "target_topic")


@query(
    "retention_filter",
    f"""SELECT "offset", target_topic, ts FROM (SELECT "offset", {_TARGET} AS target_topic, "timestamp" AS ts FROM envelope) e
        WHERE ts >= TIMESTAMP '{AS_OF}' - CASE target_topic WHEN 'iot-healthcare-raw' THEN INTERVAL 14 DAY
                 WHEN 'iot-unknown-raw' THEN INTERVAL 1000 YEAR ELSE INTERVAL 7 DAY END""",
    views=("envelope",),
)
def retention_filter(spark, folder):
    routed = lookups.route(views.envelope(spark, folder)).withColumnRenamed("timestamp", "ts")
    return neutral(lookups.retained(routed, "ts", AS_OF).select("offset", "target_topic", "ts"))


@query(
    "partition_spread",
    """SELECT CAST(CAST('0x' || substr(md5(coalesce(key, CAST("offset" AS VARCHAR))), 1, 8) AS BIGINT) % 8 AS INT) AS partition,
              count(DISTINCT key) AS keys, count(*) AS rows FROM envelope GROUP BY 1""",
    views=("envelope",),
)
def partition_spread(spark, folder):
    """Keys and rows per log partition; messages without a key are spread by their offset."""
    keyed = views.envelope(spark, folder).select(
        "key", message.partition_of(F.coalesce("key", F.col("offset").cast("string"))).alias("partition")
    )
    per_key = keyed.groupBy("partition", "key").agg(F.count(F.lit(1)).alias("rows"))
    return per_key.groupBy("partition").agg(F.count("key").alias("keys"), F.sum("rows").alias("rows"))


@query(
    "topic_partitions",
    f"""SELECT {_TARGET} AS target_topic, count(DISTINCT partition) AS partitions, count(*) AS rows FROM envelope GROUP BY 1""",
    views=("envelope",),
)
def topic_partitions(spark, folder):
    """Distinct partitions that each topic's messages came from."""
    routed = lookups.route(_decoded(spark, folder))
    return routed.groupBy("target_topic").agg(
        F.count_distinct("partition").alias("partitions"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "flat_reading_parse",
    """SELECT event_id, 'SC-' || CAST(user_id AS VARCHAR) AS sensor_id, event_type AS sensor_type, round(value, 6) AS value,
              CAST(date_trunc('second', ts) AS TIMESTAMP) AS event_ts, 'zone-' || CAST(user_id % 4 AS VARCHAR) AS location FROM events""",
)
def flat_reading_parse(spark, folder):
    """Flat sensor readings as JSON text, parsed into typed columns."""
    sent = views.events(spark, folder).select(
        "event_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("SC-"), F.col("user_id").cast("string")).alias("sensor_id"),
                F.col("event_type").alias("sensor_type"),
                "value",
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                F.concat(F.lit("zone-"), (F.col("user_id") % 4).cast("string")).alias("location"),
            )
        ).alias("value"),
    )
    data = messages.parse(sent, schemas.FLAT_READING)
    return neutral(
        data.select(
            "event_id", "data.sensor_id", "data.sensor_type", "data.value",
            message.event_time(F.col("data.timestamp")).alias("event_ts"), "data.location",
        )
    )


@query(
    "ecg_prefix",
    """SELECT vec_id, 'Lead_II' AS lead, 250 AS sample_rate_hz, CAST(len(embedding[1:20]) AS INT) AS points,
              round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[1:20]]), 6) AS total FROM embeddings""",
)
def ecg_prefix(spark, folder):
    """The first 20 points of each wave, read from ECG messages as JSON text."""
    wave = F.transform("embedding", lambda x: x.cast("double"))
    ecg = F.struct(F.lit(250).alias("sample_rate_hz"), F.lit("Lead_II").alias("lead"), wave.alias("waveform"))
    sent = table(spark, folder, "embeddings").select("vec_id", F.to_json(F.struct(ecg.alias("ecg_data"))).alias("value"))
    data = messages.parse(sent, schemas.ECG)
    head = F.slice("data.ecg_data.waveform", 1, 20)
    return neutral(
        data.select(
            "vec_id", "data.ecg_data.lead", "data.ecg_data.sample_rate_hz", F.size(head).alias("points"),
            F.aggregate(head, F.lit(0.0), lambda a, x: a + x).alias("total"),
        )
    )


@query(
    "vitals_nested",
    """SELECT event_id, patient_id, CAST(heart_rate AS INT) AS heart_rate_bpm, CAST(systolic_bp AS INT) AS systolic,
              CAST(diastolic_bp AS INT) AS diastolic, round(spo2, 6) AS oxygen_saturation_percent FROM vitals""",
    views=("vitals",),
)
def vitals_nested(spark, folder):
    """Vital-sign messages with their three levels: message, vitals, blood pressure."""
    pressure = F.struct(F.col("systolic_bp").cast("int").alias("systolic"), F.col("diastolic_bp").cast("int").alias("diastolic"))
    block = F.struct(
        F.col("heart_rate").cast("int").alias("heart_rate_bpm"), pressure.alias("blood_pressure"),
        F.col("spo2").alias("oxygen_saturation_percent"),
    )
    sent = views.vitals(spark, folder).select("event_id", F.to_json(F.struct("patient_id", block.alias("vitals"))).alias("value"))
    data = messages.parse(sent, schemas.VITAL_SIGNS)
    return neutral(
        data.select(
            "event_id", "data.patient_id", "data.vitals.heart_rate_bpm", "data.vitals.blood_pressure.systolic",
            "data.vitals.blood_pressure.diastolic", "data.vitals.oxygen_saturation_percent",
        )
    )


@query(
    "production_parse",
    """SELECT event_id, machine_id, CAST(20 + event_id % 80 AS INT) AS units_produced_hour, round(wear_level, 6) AS defect_rate_percent FROM machines""",
    views=("machines",),
)
def production_parse(spark, folder):
    """Production messages of machines."""
    block = F.struct(
        (20 + F.col("event_id") % 80).cast("int").alias("units_produced_hour"), F.col("wear_level").alias("defect_rate_percent")
    )
    sent = views.machines(spark, folder).select("event_id", F.to_json(F.struct("machine_id", block.alias("production"))).alias("value"))
    data = messages.parse(sent, schemas.PRODUCTION)
    return neutral(
        data.select("event_id", "data.machine_id", "data.production.units_produced_hour", "data.production.defect_rate_percent")
    )
