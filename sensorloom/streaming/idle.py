"""Idle timeouts of unbounded series that fire while nothing arrives."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


class IdleTimer(StatefulProcessor):
    """Per key: since when it has been idle and how often that has fired, and the rows that the watermark has not passed.

    A timer is set for the next firing, so that it comes though no row does; a busy row that the
    watermark passes first starts the count anew.
    """

    def __init__(self, step_us: int, timeout: int):
        self.span_us, self.step_us = step_us * timeout, step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start bigint, fired bigint")
        self.ahead = handle.getListState("ahead", "us bigint, busy boolean")

    def close(self) -> None:
        pass

    def _timer(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = sorted({(row["_us"], bool(row["_busy"])) for row in rows if row["_us"] is not None})
        if seen:
            self.ahead.appendList(seen)
            for us, busy in {seen[0], *[s for s in seen if s[1]]}:
                self._timer(us)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ahead = sorted(map(tuple, self.ahead.get())) if self.ahead.exists() else []
        due = [s for s in ahead if s[0] <= passed]
        start, fired = tuple(self.run.get()) if self.run.exists() else (due[0][0], 0) if due else (None, 0)
        if start is None:
            return
        for us, busy in due:
            if busy and us >= start:
                yield from self._fire(key, start, fired, us)
                start, fired = us + self.step_us, 0
        yield from self._fire(key, start, fired, passed)
        fired = max(fired, (passed - start) // self.span_us)
        self.run.update((start, fired))
        if due:
            rest = [s for s in ahead if s[0] > passed]
            self.ahead.put(rest) if rest else self.ahead.clear()
        self._timer(start + (fired + 1) * self.span_us)

    def _fire(self, key, start: int, fired: int, upto: int) -> Iterator[Row]:
        for k in range(fired + 1, (upto - start) // self.span_us + 1):
            yield Row("_key", "start", "nth", "at")(key[0], start, k, start + k * self.span_us)


def idle_timeouts(
    samples: DataFrame,
    key: str,
    ts: str,
    x: str,
    step: str = "1 minute",
    timeout: int = 60,
    below: float = 20.0,
    delay: str = "10 seconds",
) -> DataFrame:
    """(key, run_start, nth, fired_at): every ``timeout`` steps that a key stays idle, also while none of its rows come.

    A step is idle if its sample is below the level or if there is none; the first sample of a key starts its
    count, and a busy one (NULL and NaN are not below) starts it anew with the step behind it. What fires is due by
    the watermark. The same as ``series.idle_timeouts`` up to the watermark. Needs RocksDB state.
    """
    step_us = samples.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {step})").first()[0]
    busy = ~F.coalesce(F.col(x) < below, F.lit(False))
    rows = samples.withWatermark(ts, delay).select(F.col(key).alias("_key"), ts, F.unix_micros(ts).alias("_us"), busy.alias("_busy"))
    fields = [StructField("_key", samples.schema[key].dataType), *[StructField(n, LongType()) for n in ("start", "nth", "at")]]
    fired = rows.groupBy("_key").transformWithState(
        statefulProcessor=IdleTimer(step_us, timeout), outputStructType=StructType(fields), outputMode="Append", timeMode="EventTime"
    )
    return fired.select(
        F.col("_key").alias(key), F.timestamp_micros("start").alias("run_start"), "nth", F.timestamp_micros("at").alias("fired_at")
    )
