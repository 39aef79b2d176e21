"""From message envelopes to typed rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import dimensions, schemas
from ..functions import message


def decode(df: DataFrame) -> DataFrame:
    """Key and value bytes as text; the broker time keeps its own name."""
    return df.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("broker_ts"),
        "partition",
        "offset",
    )


def preview(df: DataFrame) -> DataFrame:
    """Topic, key and payload length; the payload itself goes no further."""
    return df.selectExpr(
        "offset", "topic", "CAST(key AS STRING) AS sensor_id", "length(CAST(value AS STRING)) AS data_length"
    )


def parsed(value: Column, schema: str) -> Column:
    """One JSON object as a struct; NULL for anything else.

    A lenient parser stops after the first object and takes single quotes. Here the text is read as
    the first of two array elements, the second being a mark, so that text behind the object, a
    second object, blank text and single quotes are all unreadable.
    """
    typed = f"array<struct<{schema.strip()}, _mark: boolean>>"
    text = F.concat(F.lit("["), value, F.lit(',{"_mark":true}]'))

    def first_of(both: Column) -> Column:
        return F.when((F.size(both) == 2) & F.get(both, F.lit(1))["_mark"], F.get(both, F.lit(0)).dropFields("_mark"))

    # The lambda names the parsed array, so that it is parsed once however often it is used.
    return F.get(F.transform(F.array(F.from_json(text, typed, {"allowSingleQuotes": "false"})), first_of), F.lit(0))


def parse(df: DataFrame, schema: str, into: str = "data") -> DataFrame:
    """Adds the parsed payload. Unreadable text keeps its row, with every field NULL."""
    return df.withColumn(into, parsed(F.col("value"), schema))


def flatten_city(df: DataFrame) -> DataFrame:
    """Smart-city messages as flat rows: the log key, the identity, the metrics."""
    return parse(df, schemas.SMART_CITY).select(
        F.col("key").alias("sensor_key"),
        "offset",
        "data.sensor_id",
        "data.sensor_type",
        "data.city",
        message.event_time(F.col("data.timestamp")).alias("event_ts"),
        "data.location.latitude",
        "data.location.longitude",
        "data.metrics.*",
        "broker_ts",
    )


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row, whatever is made of it later.

    A generator of one row: neither filters nor projections above it are moved below, so the
    optimiser has nothing to copy the computation into.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def opened(df: DataFrame) -> DataFrame:
    """Adds ``_payload``, the JSON text as the first element of a VARIANT array, and ``readable``: whether it is one object.

    As in ``parsed`` a mark behind the text makes the parser see where the text ends. Names that
    occur twice in an object and numbers that JSON lacks (NaN) make it unreadable as well.
    """
    text = F.concat(F.lit("["), "value", F.lit(',{"_mark":true}]'))
    rows = once(df, F.try_parse_json(text), "_payload")
    marked = F.try_variant_get("_payload", "$[1]._mark", "boolean") & F.try_variant_get("_payload", "$[2]", "variant").isNull()
    return once(rows, F.coalesce(marked & F.col("value").rlike(r"^\s*\{"), F.lit(False)), "readable")


def read(path: str, kind: str) -> Column:
    """A typed field of an opened payload; NULL if it is absent or of another kind. Whole numbers are not cut from others."""
    asked = "string" if kind in ("int", "bigint") else kind
    found = F.try_variant_get("_payload", f"$[0].{path}", asked)
    return F.when(F.col("readable"), found if asked == kind else found.try_cast(kind))


def probe(df: DataFrame, blocks: bool = False, **reads: tuple[str, str]) -> DataFrame:
    """Adds ``readable`` and ``m``: the identity that any message kind may carry, NULL fields if the payload is unreadable.

    Each payload is parsed once. ``reads`` are further fields of ``m``, each a path in the payload and its type. With
    ``blocks`` the metric blocks are read too, as maps in message order.
    """
    if blocks:
        return once(df, parsed(F.col("value"), schemas.ANY_MESSAGE), "m").withColumn("readable", F.col("m").isNotNull())
    fields = {name: (name, kind) for name, kind in (f.split() for f in schemas.IDENTITY.split(","))} | reads
    own = F.struct(*[read(path, kind).alias(name) for name, (path, kind) in fields.items()])
    return opened(df).withColumn("m", own).drop("_payload")


def identified(probed: DataFrame) -> DataFrame:
    return probed.withColumns(
        {
            "device_ref": F.coalesce(message.device_ref("m."), F.lit("unknown")),
            "device_kind": F.coalesce(message.device_kind("m."), F.lit("unknown")),
        }
    )


def fault() -> Column:
    """Why a probed payload can't be read; NULL if it can."""
    blank = F.col("value").isNull() | (F.trim("value") == "")
    return F.when(blank, "empty payload").when(~F.col("readable"), "malformed JSON")


def invalid() -> Column:
    """Why a readable payload is not valid; NULL if it is: it must name its device and have a readable time, if any."""
    at = F.col("m.timestamp")
    return F.when(message.device_ref("m.").isNull(), "no device identity").when(
        at.isNotNull() & message.event_time(at).isNull(), "unreadable time"
    )


def split_faulty(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable rows, unreadable rows); every row is in exactly one of them."""
    return probed.filter(fault().isNull()), probed.filter(fault().isNotNull())


def dead_letters(probed: DataFrame, error: Column | None = None) -> DataFrame:
    """The rows that have an error, each with its cause; unreadable ones unless told otherwise."""
    return probed.withColumn("error", fault() if error is None else error).filter("error IS NOT NULL").select(
        F.col("topic").alias("original_topic"),
        F.col("key").alias("original_key"),
        F.col("value").alias("original_data"),
        "error",
        F.col("broker_ts").alias("failed_at"),
    )


# Per domain: its topic, its schema, the field that names its device, and its leading measures.
DOMAINS = {
    "smartcity": (
        "iot/smartcity/sensors",
        schemas.SMART_CITY,
        "sensor_id",
        {"vehicle_count": "metrics.vehicle_count", "speed_kmh": "metrics.average_speed_kmh"},
    ),
    "healthcare": (
        "iot/healthcare/vitals",
        schemas.VITAL_SIGNS,
        "device_id",
        {"heart_rate_bpm": "vitals.heart_rate_bpm", "oxygen_percent": "vitals.oxygen_saturation_percent"},
    ),
    "industrial": (
        "iot/industrial/machines",
        schemas.MACHINE,
        "machine_id",
        {"machine_celsius": "sensors.temperature_celsius", "vibration_mms": "sensors.vibration_mms"},
    ),
}


def merged_domains(df: DataFrame) -> DataFrame:
    """The messages of all domains as one table of typed rows, each parsed once.

    The topic chooses the schema a payload is read with; a measure that a domain lacks is NULL.
    Other topics are left out.
    """
    domain = F.lit(None).cast("string")
    for name, (topic, *_) in DOMAINS.items():
        domain = F.when(F.col("topic") == topic, name).otherwise(domain)
    rows = opened(df.withColumn("domain", domain).filter("domain IS NOT NULL"))
    at = read("timestamp", "string")
    device = F.lit(None).cast("string")
    for name, (_, _, field, _) in DOMAINS.items():
        device = F.when(F.col("domain") == name, read(field, "string")).otherwise(device)
    return rows.select(
        "offset",
        "domain",
        device.alias("device_ref"),
        message.event_time(at).alias("event_ts"),
        *[
            F.when(F.col("domain") == name, read(path, _type_of(schema, path))).alias(measure)
            for name, (_, schema, _, measures) in DOMAINS.items()
            for measure, path in measures.items()
        ],
    )


def _type_of(schema: str, path: str) -> str:
    kind = StructType.fromDDL(schema)
    for name in path.split("."):
        kind = kind[name].dataType
    return kind.simpleString()


def as_records(df: DataFrame, topic: Column, key: Column, *payload: str) -> DataFrame:
    """Rows for a keyed log: topic, key, and the payload columns as JSON text."""
    return df.select(
        topic.alias("topic"), key.alias("key"), F.to_json(F.struct(*payload)).alias("value")
    )


def as_alert(df: DataFrame, priority: Column, at: Column) -> DataFrame:
    """Adds the alert fields. Every priority goes to the same topic."""
    return df.withColumns(
        {
            "alert_priority": priority,
            "alert_time": at,
            "target_topic": F.lit(dimensions.ALERT_TOPIC),
        }
    )
