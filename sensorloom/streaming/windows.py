"""Windowed aggregates on a stream, kept as a table of newest results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.aggregates import latest_per_key, windowed_sensors
from ..sinks.files import names_below, read_batches, read_text, remove, write_batch, write_text_once
from .lifecycle import each_batch


def sensor_windows(
    readings: DataFrame, ts: str = "ts", width: str = "30 seconds", watermark: str = "10 seconds", **kw
) -> DataFrame:
    return windowed_sensors(readings, ts=ts, width=width, watermark=watermark, **kw)


def rate_windows(
    events: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "1 hour", watermark: str = "10 minutes"
) -> DataFrame:
    """Messages per key and closed window. Partial counts meet before the shuffle, so a key
    with a third of the traffic sends on one row per window and task."""
    return (
        events.withWatermark(ts, watermark)
        .groupBy(*keys, F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("bucket"), "n")
    )


def without_repeats(df: DataFrame, ids: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """Option for at-least-once input: drop repeats that arrive within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(ids))


def changelog(df: DataFrame, base: str, query_id: str) -> DataStreamWriter:
    """Update-mode sink: each micro-batch's changed rows go to that batch's folder."""
    return each_batch(df, lambda batch, i: write_batch(batch, base, query_id, i), mode="update")


def current(spark: SparkSession, base: str, keys: Sequence[str], query_id: str, schema: str) -> DataFrame:
    """The changelog of one query read as a table: the newest version of every key.

    Batch numbers order the changes of one query only, so other queries below ``base`` are left
    out. ``schema`` is that of the changes, so a stream without rows gives an empty table.
    """
    changes = read_batches(spark, base, schema).filter(F.col("query_id") == query_id)
    return latest_per_key(changes, keys, "batch_id").drop("batch_id", "query_id")


def compact(spark: SparkSession, base: str, keys: Sequence[str], query_id: str, schema: str, to: str) -> None:
    """Write the newest version of every key below ``to``, as one batch numbered like the newest one read.

    Readers switch to ``to``; it takes the query's further batches, and the old folder can go.
    """
    changes = read_batches(spark, base, schema).filter(F.col("query_id") == query_id)
    newest = changes.agg(F.max("batch_id")).first()[0]
    if newest is not None:
        rows = latest_per_key(changes.filter(F.col("batch_id") <= newest), keys, "batch_id")
        write_batch(rows.drop("batch_id", "query_id"), to, query_id, newest)


class CompactedLog:
    """The changelog of one query with snapshots of it, told by a manifest of numbered versions.

    A version names a snapshot folder and the last batch that is in it. Readers take the highest version,
    its snapshot and newer batches only, so what they scan is bounded by the keys and the batches since. A new
    version appears by one rename, and nothing that an older one names is touched before ``expire``: a
    reader that is open meanwhile keeps reading the same rows. One compaction runs at a time.
    """

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str], query_id: str, schema: str):
        self.spark, self.base, self.keys, self.query_id, self.schema = spark, base, list(keys), query_id, schema
        self.versions = f"{base}/_manifest/{query_id}"

    def version(self) -> tuple[int, int, str | None]:
        """(number, last batch, snapshot folder) of the newest version; before the first one (0, -1, None)."""
        found = [n for n in names_below(self.spark, self.versions) if n.isdigit()]
        if not found:
            return 0, -1, None
        told = json.loads(read_text(self.spark, f"{self.versions}/{max(found, key=int)}"))
        return int(max(found, key=int)), told["upto"], told["snapshot"]

    def _rows(self) -> DataFrame:
        """The rows of the snapshot and of newer batches, each with its batch."""
        _, upto, snapshot = self.version()
        changes = read_batches(self.spark, self.base, self.schema)
        newer = changes.filter((F.col("query_id") == self.query_id) & (F.col("batch_id") > upto)).drop("query_id")
        if snapshot is None:
            return newer
        kept = self.spark.read.schema(f"{self.schema}, batch_id bigint").parquet(snapshot)
        return kept.unionByName(newer)

    def current(self) -> DataFrame:
        """The newest version of every key."""
        return latest_per_key(self._rows(), self.keys, "batch_id").drop("batch_id")

    def compact(self) -> int:
        """Write a snapshot of all batches that are complete and make it the next version; its number."""
        number, upto, _ = self.version()
        newest = upto
        folder = f"{self.base}/query_id={self.query_id}"
        for batch in sorted(int(n.split("=")[1]) for n in names_below(self.spark, folder) if n.startswith("batch_id=")):
            if batch > upto and "_SUCCESS" not in names_below(self.spark, f"{folder}/batch_id={batch}"):
                break  # it is still being written
            newest = max(newest, batch)
        if newest == upto:
            return number
        snapshot = f"{self.base}/_snapshots/{self.query_id}-{uuid.uuid4().hex}"
        latest_per_key(self._rows().filter(F.col("batch_id") <= newest), self.keys, "batch_id").write.parquet(snapshot)
        told = json.dumps({"upto": newest, "snapshot": snapshot})
        if not write_text_once(self.spark, f"{self.versions}/{number + 1}", told):
            raise RuntimeError(f"another compaction of {self.query_id} made version {number + 1}")
        return number + 1

    def expire(self, keep: int = 2) -> None:
        """Remove versions older than the newest ``keep``, their snapshots, and the batches that the oldest one kept has in its snapshot."""
        numbers = sorted(int(n) for n in names_below(self.spark, self.versions) if n.isdigit())
        if len(numbers) <= keep:
            return
        oldest = json.loads(read_text(self.spark, f"{self.versions}/{numbers[-keep]}"))
        for number in numbers[:-keep]:
            remove(self.spark, json.loads(read_text(self.spark, f"{self.versions}/{number}"))["snapshot"])
            remove(self.spark, f"{self.versions}/{number}")
        folder = f"{self.base}/query_id={self.query_id}"
        for name in names_below(self.spark, folder):
            if name.startswith("batch_id=") and int(name.split("=")[1]) <= oldest["upto"]:
                remove(self.spark, f"{folder}/{name}")
