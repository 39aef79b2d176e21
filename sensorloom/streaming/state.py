"""State of a query read as a table, from its checkpoint, while it runs or after it has ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def running_totals(rows: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Totals per key over all that has arrived, kept as state; rows combine in each task before they are shuffled.

    There is no watermark: a key's totals stay as long as the query's checkpoint does, so a restart goes on
    from them and no log of batches has to be added up.
    """
    return rows.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])


def state_table(spark: SparkSession, checkpoint: str, batch: int | None = None, operator: int = 0, variable: str | None = None) -> DataFrame:
    """Keys and values that a stateful operator holds after a batch, the newest unless told otherwise.

    ``variable`` names a state variable of a processor with several.
    """
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch is not None:
        reader = reader.option("batchId", batch)
    if variable is not None:
        reader = reader.option("stateVarName", variable)
    found = reader.load(checkpoint)
    return found.drop("partition_id") if variable else found.select("key.*", "value.*")


def batches_kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(operator, first and last batch) that the checkpoint still holds state of."""
    found = spark.read.format("state-metadata").load(checkpoint)
    return found.groupBy("operatorId", "operatorName").agg(F.min("minBatchId").alias("first"), F.max("maxBatchId").alias("last"))
