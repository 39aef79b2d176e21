"""Keyed message logs, as a stream or as a bounded batch.

The format is a parameter. ``kafka`` needs the public connector package on the
cluster; ``parquet`` and ``json`` read files that carry the same envelope columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENVELOPE

ENVELOPE_COLUMNS = ("topic", "partition", "key", "value", "timestamp", "offset")


@dataclass(frozen=True)
class SourceConfig:
    """How to read a log: which topics, from where, how much per micro-batch."""

    topics: Sequence[str] = ()
    topic_pattern: str | None = None
    format: str = "kafka"
    brokers: str = "localhost:9092"
    path: str | None = None
    schema: str = ENVELOPE
    starting_offsets: str = "latest"
    # A bounded read starts and ends here.
    first_offsets: str = "earliest"
    ending_offsets: str = "latest"
    fail_on_data_loss: bool = False
    max_offsets_per_trigger: int | None = None
    max_files_per_trigger: int | None = None
    extra: dict[str, str] = field(default_factory=dict)


def source_options(config: SourceConfig, streaming: bool = True) -> dict[str, str]:
    """Reader options for ``config``; file formats know only the intake cap."""
    options: dict[str, str] = {}
    if config.format == "kafka":
        options["kafka.bootstrap.servers"] = config.brokers
        if config.topic_pattern:
            options["subscribePattern"] = config.topic_pattern
        else:
            options["subscribe"] = ",".join(config.topics)
        options["failOnDataLoss"] = str(config.fail_on_data_loss).lower()
        if streaming:
            options["startingOffsets"] = config.starting_offsets
            if config.max_offsets_per_trigger:
                options["maxOffsetsPerTrigger"] = str(config.max_offsets_per_trigger)
        else:
            if config.first_offsets == "latest":
                raise ValueError("a bounded read can't start at the latest offset")
            options["startingOffsets"] = config.first_offsets
            options["endingOffsets"] = config.ending_offsets
    elif streaming and config.max_files_per_trigger:
        options["maxFilesPerTrigger"] = str(config.max_files_per_trigger)
    options.update(config.extra)
    return options


def _chosen(df: DataFrame, config: SourceConfig) -> DataFrame:
    """Topic choice for file formats; the log connector does its own."""
    if config.format == "kafka":
        return df
    if config.topic_pattern:
        return df.filter(F.col("topic").rlike(f"^(?:{config.topic_pattern})$"))
    return df.filter(F.col("topic").isin(*config.topics)) if config.topics else df


def stream_topics(spark: SparkSession, config: SourceConfig) -> DataFrame:
    reader = spark.readStream.format(config.format).options(**source_options(config))
    if config.format != "kafka":
        return _chosen(reader.schema(config.schema).load(config.path), config)
    return reader.load()


def read_topics(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """Everything between the start and end offsets, once."""
    reader = spark.read.format(config.format).options(**source_options(config, streaming=False))
    if config.format != "kafka":
        return _chosen(reader.schema(config.schema).load(config.path), config)
    return reader.load()


def stream_files(
    spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Replay a folder (or a glob) of files as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
