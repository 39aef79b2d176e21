"""Measured figures of every micro-batch, kept as a table.

``measured`` writes them inside the batch, so a batch that is committed has its record whatever
fails. ``BatchLog`` listens to the engine's reports, which tell of state and late rows as well, but come
after the commit.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.batches import newest_batches
from ..schemas import BATCH_METRICS
from ..sinks.files import read_batches, write_batch


def progress_row(progress) -> tuple:
    """One log row from a progress report: measured time, not an estimate.

    Throughput is rows per second of batch time; a batch too short to time counts its rows.
    """
    rows, elapsed = int(progress.numInputRows), int(progress.batchDuration)
    rate = rows / (elapsed / 1000.0) if elapsed > 0 else float(rows)
    operators = progress.stateOperators
    return (
        str(progress.id),
        int(progress.batchId),
        rows,
        elapsed,
        rate,
        float(progress.inputRowsPerSecond or 0.0),
        sum(int(o.numRowsTotal) for o in operators),
        sum(int(o.numRowsDroppedByWatermark) for o in operators),
        datetime.strptime(progress.timestamp, "%Y-%m-%dT%H:%M:%S.%fZ") + timedelta(milliseconds=elapsed),
    )


def measured(
    write: Callable[[DataFrame, int], None], base: str, query_id: str, **figures: Column
) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes by ``write`` and keeps the batch's figures below ``base``.

    The rows are counted while they are written, not by another job. The record is written before the batch is
    committed: after a failure or crash in between the batch comes again and replaces both what it wrote and its
    record. ``figures`` are further aggregates of the rows, by name.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        began, seen = time.time(), Observation()
        write(batch.observe(seen, F.count(F.lit(1)).alias("message_count"), *[c.alias(name) for name, c in figures.items()]), batch_id)
        told = seen.get
        elapsed = round(1000 * (time.time() - began))
        rows = told["message_count"]
        row = (rows, elapsed, rows / (elapsed / 1000.0) if elapsed > 0 else float(rows), datetime.now(timezone.utc).replace(tzinfo=None))
        kinds = batch.agg(*[c.alias(name) for name, c in figures.items()]).schema if figures else []
        frame = batch.sparkSession.createDataFrame([row], MEASURED.replace("timestamp", "timestamp_ntz")).withColumns(
            {"finished_at": F.col("finished_at").cast("timestamp")} | {f.name: F.lit(told[f.name]).cast(f.dataType) for f in kinds}
        )
        write_batch(frame.coalesce(1), base, query_id, batch_id)

    return handle


MEASURED = "message_count bigint, elapsed_ms bigint, throughput double, finished_at timestamp"


def measured_table(spark: SparkSession, base: str, query_id: str | None = None, figures: str = "") -> DataFrame:
    """Every record that ``measured`` wrote below ``base``; ``figures`` is the schema of further ones."""
    log = newest_batches(read_batches(spark, base, f"{MEASURED}, {figures}" if figures else MEASURED))
    return log if query_id is None else log.filter(F.col("query_id") == query_id)


def progress_table(spark: SparkSession, base: str, query_id: str | None = None) -> DataFrame:
    """Every batch that a ``BatchLog`` wrote below ``base``, of all queries or of one."""
    kept = ", ".join(c.strip() for c in BATCH_METRICS.split(",") if c.split()[0] not in ("query_id", "batch_id"))
    log = newest_batches(read_batches(spark, base, kept))
    return log if query_id is None else log.filter(F.col("query_id") == query_id)


def as_batches(log: DataFrame, executors: int) -> DataFrame:
    """The log in the columns that ``operators.batches`` rolls up, batches without rows left out.

    Episodes are derived from the log and never counted in memory, so a restart loses none.
    """
    return log.filter(F.col("message_count") > 0).select(
        "query_id",
        "batch_id",
        "message_count",
        F.col("elapsed_ms").cast("double").alias("latency_ms"),
        "throughput",
        F.lit(executors * 0.5).alias("cost"),
    )


class BatchLog(StreamingQueryListener):
    """Writes each batch's figures to its own folder under ``base``; a retry replaces them."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.started, self.ended = set(), set()

    def onQueryStarted(self, event) -> None:
        self.started.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        row = progress_row(event.progress)
        frame = self.spark.createDataFrame([row], BATCH_METRICS).drop("query_id", "batch_id")
        write_batch(frame.coalesce(1), self.base, row[0], row[1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def settle(self) -> None:
        """Wait, however long it takes, until the reports of all queries that have stopped are written.

        A run's end is reported behind its batches. Should it be lost, there is nothing left to wait for once no
        report is under way.
        """
        bus = self.spark.sparkContext._jsc.sc().listenerBus()
        while self.started - self.ended - {str(q.runId) for q in self.spark.streams.active}:
            try:
                bus.waitUntilEmpty(1000)
                return
            except Py4JJavaError as err:
                if err.java_exception.getClass().getSimpleName() != "TimeoutException":
                    raise


@contextmanager
def logged(spark: SparkSession, base: str) -> Iterator[None]:
    """Log the batches of all queries that run inside; on leaving, their last records are written."""
    listener = BatchLog(spark, base)
    spark.streams.addListener(listener)
    try:
        yield
        # Reports reach listeners after the query has ended.
        listener.settle()
    finally:
        spark.streams.removeListener(listener)
