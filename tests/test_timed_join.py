"""The join by timers against a loop written from its definition, and the state it leaves."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.streaming import joins, lifecycle

READING = "id long, k string, ts timestamp, hr double"
SIGNAL = "k string, ts timestamp, load double, alarm boolean"
START = datetime(2024, 1, 1)


def plain(readings, signals, minutes):
    out = []
    for i, k, ts, hr in readings:
        met = [s for s in signals if k is not None and ts is not None and s[0] == k and ts - timedelta(minutes=minutes) <= s[1] <= ts]
        newest = max(met, key=lambda s: s[1], default=(None,) * 4)
        out.append((i, k, ts, hr, *newest[1:]))
    return sorted(out, key=str)


def frame(spark, rows, schema):
    text = [tuple(str(v) if isinstance(v, datetime) else v for v in r) for r in rows]
    return spark.createDataFrame(text, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, base, deliveries, **options):
    """Deliver (readings, signals) one batch after the other; the rows that came out, and the last report."""
    name, done = f"timed-{uuid.uuid4().hex[:8]}", None
    for readings, signals in deliveries:
        frame(spark, readings, READING).coalesce(1).write.mode("append").parquet(f"{base}/r")
        frame(spark, signals, SIGNAL).coalesce(1).write.mode("append").parquet(f"{base}/s")
        r, s = (spark.readStream.schema(schema).parquet(f"{base}/{side}") for side, schema in (("r", READING), ("s", SIGNAL)))
        joined = joins.timed_edge_join(r, s, "k", **options)
        with lifecycle.rocksdb(spark):
            writer = joined.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
            done = lifecycle.run(writer, name, f"{base}/checkpoint")
    rows = spark.read.schema(joined.schema).parquet(f"{base}/out").collect()
    return sorted((tuple(r) for r in rows), key=str), done.lastProgress


def after(seconds):
    return START + timedelta(seconds=seconds)


def beyond(days):
    """Rows without a key that move both watermarks."""
    far = START + timedelta(days=days)
    return [(-days, None, far, None)], [(None, far, 0.0, False)]


@pytest.mark.parametrize("seed, salts", [(1, 1), (2, 3)])
def test_every_reading_comes_out_as_often_as_it_came(spark, tmp_path, seed, salts):
    r = random.Random(seed)
    deliveries, readings, signals = [], [], []
    for part in range(3):
        low = part * 1800
        own = [(r.randrange(40), r.choice("abb"), after(low + r.random() * 1800), r.choice([None, 1.0, 2.0])) for _ in range(40)]
        own += r.choices(own, k=30)  # repeats, some more than twice
        own += [(part, "a", None, 9.0), (part, "a", None, 9.0)]
        told = [(r.choice("ab"), after(low + r.random() * 1800), r.random(), r.random() < 0.5) for _ in range(25)] + [(None, after(low), 1.0, True)]
        deliveries.append((own, told))
        readings += own
        signals += told
    end = beyond(2)
    got, report = run(spark, str(tmp_path), [*deliveries, end], lookback="10 minutes", delay="10 seconds", salts=salts)
    assert got == plain(readings + end[0], signals, 10)
    # The timers have cleared all that the watermark has passed.
    assert sum(o.numRowsTotal for o in report.stateOperators) == 0


def test_a_reading_waits_for_the_watermark_and_no_longer(spark, tmp_path):
    first = [(1, "a", after(60), 1.0)], [("a", after(30), 0.5, True)]
    later = [(2, "a", after(100), 1.0)], [("a", after(100), 0.25, False)]
    got, report = run(spark, str(tmp_path), [first, later], lookback="10 minutes", delay="10 seconds", salts=1)
    assert [g[0] for g in got] == [1] and got[0][4:] == (after(30), 0.5, True)
    assert sum(o.numRowsTotal for o in report.stateOperators) > 0


def test_a_signal_of_the_next_batch_is_met(spark, tmp_path):
    first = [(1, "a", after(60), 1.0), (1, "a", after(60), 1.0)], [("a", after(20), 0.5, True)]
    second = [(3, "b", after(61), 1.0)], [("a", after(59), 0.75, False)]
    got, _ = run(spark, str(tmp_path), [first, second, beyond(1)], lookback="10 minutes", delay="2 minutes", salts=2)
    assert [g for g in got if g[0] == 1] == [(1, "a", after(60), 1.0, after(59), 0.75, False)] * 2
