"""Telemetry-shaped views over the test tables.

Every view is a projection or a pre-aggregation of a whole table. The derivations are
deterministic functions of the row, so any engine gives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import rate_series
from .tables import table

# Wards and machine types of the device generators.
WARDS = ("ICU", "Emergency", "Cardiology", "Neonatal", "General")
MACHINE_TYPES = ("CNC_Mill", "Lathe", "Press", "Welder", "Conveyor")


def _one_of(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)


def _mod(column: str, times: int, by: int) -> Column:
    return (F.col(column) * times) % by


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


# The event types that each kind of sensor reads; any other type is a parking reading.
SENSOR_FEEDS = {"traffic": ("click", "signup"), "pollution": ("view",)}


def as_readings(ev: DataFrame, *sensor_types: str) -> DataFrame:
    """Smart-city readings: three kinds share one schema, absent metrics are NULL.

    With ``sensor_types`` only those feeds are read; the choice reaches the scan.
    """
    event_type = F.col("event_type")
    kind = F.lit("parking")
    for name, types in SENSOR_FEEDS.items():
        kind = F.when(event_type.isin(*types), name).otherwise(kind)
    spots = _mod("event_id", 7, 151)
    if sensor_types:
        listed = [t for types in SENSOR_FEEDS.values() for t in types]
        chosen = [t for s in sensor_types for t in SENSOR_FEEDS.get(s, ())]
        keep = event_type.isin(*chosen) if chosen else F.lit(False)
        if "parking" in sensor_types:
            keep = keep | ~event_type.isin(*listed)
        ev = ev.filter(keep)
    return ev.withColumn("_kind", kind).select(
        "event_id",
        "ts",
        F.concat(F.lit("SC-"), F.col("user_id").cast("string")).alias("sensor_id"),
        F.col("_kind").alias("sensor_type"),
        F.concat(F.lit("city_"), (F.col("user_id") % 4).cast("string")).alias("city"),
        F.when(F.col("_kind") == "traffic", (20 + _mod("event_id", 37, 130)).cast("int")).alias("vehicle_count"),
        F.when(F.col("_kind") == "traffic", 15 + _mod("event_id", 13, 500).cast("double") / 10).alias(
            "average_speed_kmh"
        ),
        F.when(F.col("_kind") == "pollution", (30 + _mod("event_id", 17, 90)).cast("int")).alias("aqi"),
        F.when(F.col("_kind") == "pollution", F.col("value")).alias("pm25"),
        F.when(F.col("_kind") == "pollution", F.col("value") * 2).alias("pm10"),
        F.when(F.col("_kind") == "parking", (50 + spots).cast("int")).alias("total_spots"),
        F.when(F.col("_kind") == "parking", ((F.col("event_id") * 11) % (51 + spots)).cast("int")).alias(
            "occupied_spots"
        ),
    )


def readings(spark: SparkSession, folder: str, *sensor_types: str) -> DataFrame:
    return as_readings(events(spark, folder), *sensor_types)


def as_vitals(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id",
        "ts",
        F.concat(F.lit("PT-"), F.col("user_id").cast("string")).alias("patient_id"),
        _one_of(F.col("user_id") % 5, WARDS).alias("ward"),
        (35 + _mod("event_id", 37, 141)).cast("double").alias("heart_rate"),
        (80 + _mod("event_id", 17, 200).cast("double") / 10).alias("spo2"),
        (35 + _mod("event_id", 23, 60).cast("double") / 10).alias("temperature"),
        (70 + _mod("event_id", 29, 81)).cast("double").alias("systolic_bp"),
        (45 + _mod("event_id", 19, 91)).cast("double").alias("diastolic_bp"),
        (8 + _mod("event_id", 31, 25)).cast("double").alias("resp_rate"),
    )


def vitals(spark: SparkSession, folder: str) -> DataFrame:
    return as_vitals(events(spark, folder))


def machines(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "event_id",
        "ts",
        F.concat(F.lit("MCH-"), (F.col("user_id") % 20).cast("string")).alias("machine_id"),
        _one_of(F.col("user_id") % 5, MACHINE_TYPES).alias("machine_type"),
        (_mod("event_id", 41, 1000).cast("double") / 1000).alias("wear_level"),
        (F.col("event_id") % 7 == 0).alias("is_anomaly"),
        F.col("value").alias("vibration_mms"),
    )


def as_signals(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("PT-"), F.col("user_id").cast("string")).alias("patient_id"),
        "ts",
        F.col("value").alias("predicted_load"),
        (F.col("event_id") % 2 == 0).alias("burst_alarm"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return as_signals(events(spark, folder))


def as_rates(ev: DataFrame) -> DataFrame:
    """Arrival rate per type and hour, with the load figures that follow from it."""
    hourly = rate_series(ev, ["event_type"], "ts", "hour")
    return hourly.select(
        "event_type",
        "bucket",
        "n",
        ((F.col("n") - 1) * 45.0).alias("workload_rate"),
        F.least(F.lit(100.0), (F.col("n") - 1) * 9.0).alias("cpu_util"),
        (100 + (F.col("n") - 1) * 22.5).alias("latency_ms"),
    )


def rate_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return as_rates(events(spark, folder))


def batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly rates read as micro-batches: each hour is a batch with its cost."""
    executors = F.floor(F.col("workload_rate") / 50) + 1
    return rate_hourly(spark, folder).select(
        "event_type",
        "bucket",
        F.col("n").alias("message_count"),
        F.col("workload_rate").alias("workload"),
        "latency_ms",
        "cpu_util",
        executors.alias("executors"),
        (executors * 0.5).alias("cost"),
        (F.col("workload_rate") * 0.9).alias("throughput"),
    )


def envelope(spark: SparkSession, folder: str) -> DataFrame:
    return as_envelope(events(spark, folder))


def as_envelope(ev: DataFrame) -> DataFrame:
    """Message-log rows carrying JSON text, with the faults a real feed has."""
    kind, eid, uid = F.col("event_type"), F.col("event_id"), F.col("user_id")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    hour = F.lpad((eid % 24).cast("string"), 2, "0")
    traffic = text(
        '{"sensor_id":"SC-', uid, '","sensor_type":"traffic","city":"city_', uid % 4,
        '","timestamp":"2024-01-01T', hour, ':00:00","location":{"latitude":40,"longitude":-74}',
        ',"metrics":{"vehicle_count":', 20 + (eid * 37) % 130,
        ',"average_speed_kmh":', 15 + (eid * 13) % 50, ',"congestion_level":"LOW"}}',
    )
    vital = text(
        '{"sensor_id":"","device_id":"DEV-', uid, '","device_type":"vital_signs_monitor"',
        ',"timestamp":"2024-01-01T', hour, ':30:00","vitals":{"heart_rate_bpm":', 40 + (eid * 37) % 141,
        ',"oxygen_saturation_percent":', 85 + eid % 15, "}}",
    )
    machine = text(
        '{"machine_id":"MCH-', uid % 20, '","machine_type":"Press","timestamp":"not a time"',
        ',"sensors":{"temperature_celsius":', 60 + eid % 40, ',"vibration_mms":', eid % 5, "}}",
    )
    return ev.select(
        F.when(kind == "click", "iot/smartcity/sensors")
        .when(kind == "view", "iot/healthcare/vitals")
        .when(kind == "purchase", "iot/industrial/machines")
        .otherwise("iot/other/raw")
        .alias("topic"),
        (uid % 8).cast("int").alias("partition"),
        F.when(eid % 11 != 0, uid.cast("string")).alias("key"),
        F.when(eid % 50 == 0, "{bad")
        .when(eid % 50 == 1, "")
        .when(eid % 50 == 2, "   ")
        .when(eid % 50 == 3, F.lit(None).cast("string"))
        .when(eid % 50 == 4, F.concat(traffic, F.lit(" junk")))
        .when(eid % 50 == 5, "{'sensor_id':'q'}")
        .when(kind == "click", traffic)
        .when(kind == "view", vital)
        .when(kind == "purchase", machine)
        .otherwise('{"note":"unidentified"}')
        .alias("value"),
        F.col("ts").alias("timestamp"),
        eid.alias("offset"),
    )


def policy_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Long metric table: one row per step of a policy under a scenario."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("scenario"),
        F.col("l_returnflag").alias("policy"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("step"),
        (F.col("l_extendedprice") / 100).alias("latency_ms"),
        F.col("l_quantity").alias("executors"),
        (F.col("l_quantity") * 0.1).alias("cost"),
    )

