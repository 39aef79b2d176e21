"""Readings met with the edge signals sent shortly before them."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def edge_interval_join(
    readings: DataFrame,
    signals: DataFrame,
    key: str,
    ts: str = "ts",
    lookback: str = "10 minutes",
    delay: str = "10 seconds",
    salts: int = 8,
) -> DataFrame:
    """Each reading once, with the newest signal of its key in the ``lookback`` before it, or NULLs.

    Both sides carry a watermark and the time condition is an interval, so state is dropped
    once the interval has passed. Matches of a reading meet in a second state that keeps the newest
    one only; the row comes out when the watermark has passed the reading. Readings of one key
    are spread over ``salts`` state partitions and the few signals are copied to each, so a hot key
    is shared between tasks. Readings that are equal in all columns come out once; ``timed_edge_join``
    keeps them apart and needs no pair of a reading and each of its signals.
    """
    salt = F.pmod(F.xxhash64(*readings.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    left = readings.withColumn("_salt", salt).withWatermark(ts, delay).alias("r")
    right = (
        signals.withColumnRenamed(ts, "signal_ts")
        .withColumn("_salt", copies)
        .withWatermark("signal_ts", delay)
        .alias("s")
    )
    match = F.expr(
        f"r.{key} = s.{key} AND r._salt = s._salt "
        f"AND s.signal_ts <= r.{ts} AND s.signal_ts >= r.{ts} - INTERVAL {lookback}"
    )
    columns = ["signal_ts", *[c for c in right.columns if c not in (key, "_salt", "signal_ts")]]
    matched = left.join(right, match, "leftOuter").select(
        *[F.col(f"r.{c}") for c in readings.columns], F.struct(*[F.col(f"s.{c}").alias(c) for c in columns]).alias("_signal")
    )
    # Structs compare by their first field, so the greatest is the newest signal.
    newest = matched.groupBy(*readings.columns).agg(F.max("_signal").alias("_signal"))
    return newest.select(*readings.columns, *[F.col(f"_signal.{c}").alias(c) for c in columns])


class NewestSignal(StatefulProcessor):
    """Holds the readings of a group of keys until the watermark has passed them, and the signals they may meet.

    Equal readings are one entry with their count. One timer a group is enough: it is set for what is due first,
    emits all that is due by then and clears what no later reading can meet, so keys that fall silent leave no
    state behind.
    """

    BLOCK = 10_000

    def __init__(self, key: StructField, reading: StructType, signal: StructType, lookback_us: int):
        self.key, self.reading, self.signal, self.lookback_us = key, reading, signal, lookback_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, at = StructField("_key", self.key.dataType), StructField("_us", LongType())
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([key, at, StructField("_n", LongType()), *self.reading.fields]))
        self.signals = handle.getListState("signals", StructType([key, at, *self.signal.fields]))
        self.row = Row("_key", "_us", *self.reading.names, "_signal_us", *(f"_s_{name}" for name in self.signal.names))
        self.unmet = (None,) * (1 + len(self.signal.fields))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        readings, signals, due = Counter(), [], []
        for row in rows:
            if row["_signal"] is not None:
                signals.append((row["_key"], row["_us"], *row["_signal"].values()))
            elif row["_key"] is None or row["_us"] is None:
                yield self.row(row["_key"], row["_us"], *row["_reading"].values(), *self.unmet)
            else:
                readings[(row["_key"], row["_us"], *row["_reading"].values())] += 1
            if len(readings) + len(signals) >= self.BLOCK:
                due.append(self._hold(readings, signals))
                readings, signals = Counter(), []
        if readings or signals:
            due.append(self._hold(readings, signals))
        if due:
            self._wake(min(due))

    def _hold(self, readings: Counter, signals: list[tuple]) -> int:
        """Add to the state; when the first of these is due."""
        if readings:
            self.waiting.appendList([(*r[:2], n, *r[2:]) for r, n in readings.items()])
        if signals:
            self.signals.appendList(signals)
        return min([r[1] for r in readings] + [s[1] + self.lookback_us for s in signals])

    def _wake(self, us: int) -> None:
        self.handle.registerTimer((us // 1_000_000 + 1) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # rows from here on may still come
        signals = list(map(tuple, self.signals.get())) if self.signals.exists() else []
        told = defaultdict(list)
        for s in signals:
            told[s[0]].append(s[1:])
        for of_key in told.values():
            # Of signals at one time the greatest counts, as structs compare.
            of_key.sort(key=_comparable)
        times = {k: [s[0] for s in of_key] for k, of_key in told.items()}
        rest, due = [], []
        if self.waiting.exists():
            for k, us, n, *values in self.waiting.get():
                if us >= passed:
                    rest.append((k, us, n, *values))
                    continue
                last = bisect_right(times.get(k, ()), us) - 1
                near = last >= 0 and times[k][last] >= us - self.lookback_us
                row = self.row(k, us, *values, *(told[k][last] if near else self.unmet))
                for _ in range(n):
                    yield row
            self._keep(self.waiting, rest)
            due += [r[1] for r in rest]
        kept = [s for s in signals if s[1] >= passed - self.lookback_us]
        if len(kept) < len(signals):
            self._keep(self.signals, kept)
        due += [s[1] + self.lookback_us for s in kept]
        if due:
            self._wake(min(due))

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()


def _comparable(values: tuple) -> tuple:
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


def timed_edge_join(
    readings: DataFrame,
    signals: DataFrame,
    key: str,
    ts: str = "ts",
    lookback: str = "10 minutes",
    delay: str = "10 seconds",
    salts: int = 8,
    groups: int = 1024,
) -> DataFrame:
    """Each reading as often as it came, with the newest signal of its key in the ``lookback`` before it, or NULLs.

    Keys share ``groups`` states by their hash, so that what a state costs does not grow with the number of keys, and
    each is dealt to ``salts`` of them. No reading is paired with more than one signal, and a reading comes out once
    the watermark has passed it; then nothing of it is left in the state. Columns hold plain values. A reading without a key or time leaves at once and unmatched, a signal without one is left
    out, and so are rows behind the watermark. Rows without a key do move the watermark. Needs RocksDB state.
    """
    spark = readings.sparkSession
    lookback_us = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {lookback})").first()[0]
    own = [c for c in readings.columns if c not in (key, ts)]
    told = [c for c in signals.columns if c not in (key, ts)]
    salt = F.pmod(F.xxhash64(*readings.columns), F.lit(salts)).cast("int")
    group = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_group")
    left = readings.withWatermark(ts, delay).select(
        group, salt.alias("_salt"), F.col(key).alias("_key"), ts, F.unix_micros(ts).alias("_us"), F.struct(*own).alias("_reading")
    )
    # The condition names the time, so it is not moved below the watermark.
    keyed = F.when(F.col(key).isNotNull(), F.col(ts)).isNotNull()
    right = signals.withWatermark(ts, delay).where(keyed).select(
        group, F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt"), F.col(key).alias("_key"), ts, F.unix_micros(ts).alias("_us"), F.struct(*told).alias("_signal")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    reading = StructType([readings.schema[c] for c in own])
    signal = StructType([signals.schema[c] for c in told])
    at, met = StructField("_us", LongType()), StructField("_signal_us", LongType())
    found = both.groupBy("_group", "_salt").transformWithState(
        statefulProcessor=NewestSignal(readings.schema[key], reading, signal, lookback_us),
        outputStructType=StructType([StructField("_key", readings.schema[key].dataType), at, *reading.fields, met, *(StructField(f"_s_{f.name}", f.dataType) for f in signal.fields)]),
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.withColumns({key: F.col("_key"), ts: F.timestamp_micros("_us")}).select(
        *readings.columns, F.timestamp_micros("_signal_us").alias("signal_ts"), *[F.col(f"_s_{c}").alias(c) for c in told]
    )
