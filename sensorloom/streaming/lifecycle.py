"""Starting, awaiting and stopping queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession, counted: bool = True) -> Iterator[None]:
    """Queries started inside keep state on executor disk with changelog checkpoints, so that it may
    outgrow the heap. A join of streams keeps one store a partition, not four. Not ``counted``, reports tell no
    number of state rows, which saves a look-up for each row written. A query keeps its provider; the session's own
    settings return on leaving."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "true" if counted else "false",
        "spark.sql.streaming.join.stateFormatVersion": "3",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start(
    writer: DataStreamWriter, name: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start a named query on its own checkpoint, so that a restart resumes it.

    ``every`` is a processing-time interval; without it the query reads what there is and ends.
    """
    writer = writer.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run(writer: DataStreamWriter, name: str, checkpoint: str, timeout_s: float | None = None) -> StreamingQuery:
    """Read what there is, wait for the end however long it takes, raise what failed."""
    query = start(writer, name, checkpoint)
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"query {name} still runs after {timeout_s} s")
    return query


def await_all(queries: list[StreamingQuery], timeout_s: float | None = None) -> bool:
    """Wait until every query ended or the time (in seconds) is up. True when all ended."""
    end = None if timeout_s is None else time.monotonic() + timeout_s
    for query in queries:
        if end is None:
            query.awaitTermination()
        elif not query.awaitTermination(max(0.1, end - time.monotonic())):
            return False
    return True


def stop_all(spark: SparkSession) -> None:
    for query in spark.streams.active:
        query.stop()


def console(df: DataFrame, mode: str, rows: int) -> DataStreamWriter:
    return df.writeStream.outputMode(mode).format("console").option("truncate", "false").option(
        "numRows", str(rows)
    )


def show_appended(df: DataFrame, name: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    return start(console(df, "append", 10), name, checkpoint, every)


def show_updated(df: DataFrame, name: str, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    """Only the windows that changed since the last trigger."""
    return start(console(df, "update", 20), name, checkpoint, every)


def each_batch(
    df: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> DataStreamWriter:
    """Hands every non-empty micro-batch to ``handle``. Failures are not swallowed."""

    def call(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            handle(batch, batch_id)

    return df.writeStream.outputMode(mode).foreachBatch(call)
