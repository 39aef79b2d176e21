"""Idle timeouts by timers against a loop over steps."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import series
from sensorloom.streaming import idle, lifecycle

SAMPLE = "k string, ts timestamp, x double"
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def plain(rows, until, timeout):
    """Step by step, as a counter would see it."""
    out = []
    for k in {r[0] for r in rows if r[0] is not None}:
        busy = {r[1]: r[2] is None or not r[2] < 20 for r in rows if r[0] == k}
        t = run = min(busy)
        count = 0
        while t < until:
            if busy.get(t, False):
                run, count = t + timedelta(minutes=1), 0
            else:
                count += 1
                if count % timeout == 0:
                    out.append((k, run, count // timeout, t + timedelta(minutes=1)))
            t += timedelta(minutes=1)
    return sorted(out)


def frame(spark, rows):
    text = [(k, str(t), x) for k, t, x in rows]
    return spark.createDataFrame(text, "k string, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))


def fired(spark, base, deliveries, timeout):
    """What has fired after each delivery."""
    name, out = f"idle-{uuid.uuid4().hex[:8]}", []
    for rows in deliveries:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(SAMPLE).parquet(f"{base}/in")
        found = idle.idle_timeouts(stream, "k", "ts", "x", "1 minute", timeout, delay="2 minutes")
        with lifecycle.rocksdb(spark):
            lifecycle.run(found.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append"), name, f"{base}/checkpoint")
        out.append(sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{base}/out").collect())))
    return out


def samples(seed, first, last):
    r = random.Random(seed)
    return [(k, at(m), r.choice([5.0, 5.0, 5.0, 50.0, None])) for k in "ab" for m in range(first, last) if r.random() < 0.4]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_form_equals_the_loop(spark, seed):
    rows = samples(seed, 0, 120)
    until = at(150)
    got = series.idle_timeouts(frame(spark, rows), ["k"], "ts", "x", F.lit(str(until)).cast("timestamp"), timeout=5)
    assert sorted(map(tuple, got.collect())) == plain(rows, until, 5)


def test_timers_fire_in_silence_and_never_early(spark, tmp_path):
    rows = [("a", at(0), 50.0), ("a", at(1), 5.0), ("b", at(0), 5.0)]
    # Only b goes on; its rows move the watermark to 2 minutes before them.
    states = fired(spark, str(tmp_path), [rows, [("b", at(8), 50.0)], [("b", at(9), 50.0), ("a", at(14), 50.0), ("b", at(16), 50.0)]], 5)
    assert states[0] == []
    assert states[1] == [("a", at(1), 1, at(6)), ("b", at(0), 1, at(5))]
    assert states[2] == [("a", at(1), 1, at(6)), ("a", at(1), 2, at(11)), ("b", at(0), 1, at(5))]


@pytest.mark.parametrize("seed", [4, 5])
def test_stream_equals_batch_and_loop(spark, tmp_path, seed):
    parts = [samples(seed + k, 40 * k, 40 * k + 40) for k in range(3)]
    end = [(None, at(202), 0.0)]  # the watermark ends at minute 200
    got = [r for r in fired(spark, str(tmp_path), [*parts, end], 6)[-1] if r[0] is not None]
    rows = [r for part in parts for r in part]
    assert got == plain(rows, at(200), 6)
    batch = series.idle_timeouts(frame(spark, rows), ["k"], "ts", "x", F.lit(str(at(200))).cast("timestamp"), timeout=6)
    assert sorted(map(tuple, batch.collect())) == got
