"""Writing to a keyed message log, as a batch or as a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

RECORD_COLUMNS = ("topic", "key", "value")


@dataclass(frozen=True)
class SinkConfig:
    """Delivery settings of a log sink; ``parquet`` writes the same records to files."""

    format: str = "kafka"
    brokers: str = "localhost:9092"
    path: str | None = None
    acks: str = "all"
    idempotent: bool = True
    compression: str = "gzip"
    extra: dict[str, str] = field(default_factory=dict)


def sink_options(config: SinkConfig) -> dict[str, str]:
    if config.format != "kafka":
        return dict(config.extra)
    return {
        "kafka.bootstrap.servers": config.brokers,
        "kafka.acks": config.acks,
        "kafka.enable.idempotence": str(config.idempotent).lower(),
        "kafka.compression.type": config.compression,
        **config.extra,
    }


def _records(df: DataFrame) -> DataFrame:
    missing = [c for c in RECORD_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"records need the columns {missing}")
    return df.select(*RECORD_COLUMNS)


def write_records(df: DataFrame, config: SinkConfig) -> None:
    writer = _records(df).write.format(config.format).options(**sink_options(config))
    if config.format == "kafka":
        writer.save()
    else:
        writer.mode("append").partitionBy("topic").save(config.path)


def stream_records(df: DataFrame, config: SinkConfig) -> DataStreamWriter:
    """A writer for a stream of records; name, checkpoint and trigger are set by ``lifecycle.start``."""
    writer = _records(df).writeStream.format(config.format).options(**sink_options(config))
    writer = writer.outputMode("append")
    return writer if config.format == "kafka" else writer.partitionBy("topic").option("path", config.path)
