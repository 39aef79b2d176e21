"""One micro-batch, several sinks: routed records, dead letters, alerts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions
from ..functions import message
from ..operators import lookups, messages
from ..sinks.files import write_batch
from ..sinks.topics import SinkConfig, write_records


def routed_records(good: DataFrame) -> DataFrame:
    return lookups.route(good).select(
        F.col("target_topic").alias("topic"), message.device_ref("m.").alias("key"), "value"
    )


def dead_records(probed: DataFrame) -> DataFrame:
    """Unreadable messages and messages that fail validation, each with its cause."""
    letters = messages.dead_letters(probed, F.coalesce(messages.fault(), messages.invalid()))
    return messages.as_records(
        letters, F.lit(dimensions.DEAD_LETTER_TOPIC), F.col("original_key"), *letters.columns
    )


def alert_records(good: DataFrame, limit_celsius: float = 80.0) -> DataFrame:
    """Machines above the heat limit, as alert messages."""
    hot = good.withColumn("celsius", F.col("m.celsius")).filter(F.col("celsius") > limit_celsius)
    named = messages.as_alert(hot, F.lit("critical"), F.col("broker_ts")).withColumn(
        "device", message.device_ref("m.")
    )
    return messages.as_records(
        named, F.col("target_topic"), F.col("device"), "device", "celsius", "alert_priority", "alert_time"
    )


def validated_records(good: DataFrame) -> DataFrame:
    """Readable messages that pass validation."""
    return good.filter(messages.invalid().isNull()).select(
        F.lit(dimensions.VALIDATED_TOPIC).alias("topic"), message.device_ref("m.").alias("key"), "value"
    )


def analytics_records(probed: DataFrame) -> DataFrame:
    """Messages and unreadable messages of the batch per broker topic, as analytics messages."""
    counts = probed.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(messages.fault().isNotNull()).alias("faulty")
    )
    source = F.col("topic")
    named = counts.withColumn("source", source)
    return messages.as_records(named, F.lit(dimensions.ANALYTICS_TOPIC), source, "source", "messages", "faulty")


def all_records(probed: DataFrame) -> DataFrame:
    """The records of every sink: (sink, topic, key, value)."""
    good, _ = messages.split_faulty(probed)
    sinks = {
        "routed": routed_records(good),
        "validated": validated_records(good),
        "alerts": alert_records(good),
        "analytics": analytics_records(probed),
        "dead": dead_records(probed),
    }
    parts = [records.select(F.lit(name).alias("sink"), "topic", "key", "value") for name, records in sinks.items()]
    return reduce(DataFrame.unionAll, parts)


RECORDS = "sink string, topic string, key string, value string"


def fan_out(config: SinkConfig, query_id: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: parse once, then write the records of all sinks in one job.

    Records carry their topic, so a log takes them all at once. To files each (query, batch) has its own
    folder, so a retry replaces what the first try wrote.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        probed = messages.probe(messages.decode(batch), celsius=("sensors.temperature_celsius", "double")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            records = all_records(probed)
            if config.format == "kafka":
                write_records(records, config)
            else:
                write_batch(records, config.path, query_id, batch_id)
        finally:
            probed.unpersist()

    return handle
