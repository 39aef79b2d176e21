"""Series operators against plain loops written from their definitions."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import batches, lookups, quantiles, series

START = datetime(2024, 1, 1)


def make(spark, series_by_key):
    rows = [(k, t, float(x)) for k, samples in series_by_key.items() for t, x in samples]
    return spark.createDataFrame(rows, "k string, ts timestamp, x double")


def walk(seed, n, step=lambda r: timedelta(seconds=r.choice([1, 2, 7]))):
    r, t, out = random.Random(seed), START, []
    for _ in range(n):
        out.append((t, r.randint(0, 40) * 10.0))
        t += step(r)
    return out


def expected_features(samples, history=300):
    """One pass over the samples, as the definition reads."""
    out, xs, vs, level, last = [], [], [], None, None
    for n, (t, x) in enumerate(samples, 1):
        if last is not None and t > last[0]:
            vs.append((x - last[1]) / (t - last[0]).total_seconds())
        last, xs = (t, x), [*xs, x]
        if n % 50 == 0 and len(vs) >= 5:
            level = np.percentile(vs[-history:], 90)
        if n < 5:
            out.append((0.0,) * 5)
            continue
        if level is None and len(vs) >= 5:
            level = np.percentile(vs[-history:], 90)
        p = 0.0
        if len(vs) >= 5 and level > 0:
            tail = vs[-10:]
            share = sum(b > a for a, b in zip(tail, tail[1:])) / (len(tail) - 1)
            power = -5 * (vs[-1] / level - 1)
            p = 0.6 * (0.0 if power > 700 else 1 / (1 + math.exp(power))) + 0.4 * share
        out.append(
            (
                vs[-1] if vs else 0.0,
                vs[-1] - vs[-2] if len(vs) > 1 else 0.0,
                float(np.mean(xs[-history:])),
                float(np.std(xs[-history:])),
                min(1.0, max(0.0, p)),
            )
        )
    return out


NAMES = ["velocity", "acceleration", "rolling_mean", "rolling_std", "burst_probability"]


@pytest.mark.parametrize("history", [300, 60])
def test_features_equal_the_loop(spark, history):
    data = {"a": walk(1, 420), "b": walk(2, 55), "c": walk(3, 4), "d": walk(4, 6)}
    got = series.traffic_features(make(spark, data), ["k"], "ts", "x", history)
    rows = {}
    for r in got.orderBy("k", "ts").collect():
        rows.setdefault(r["k"], []).append([r[n] for n in NAMES])
    for key, samples in data.items():
        assert np.allclose(rows[key], expected_features(samples, history), atol=1e-9), key


def test_falling_series_has_no_positive_threshold(spark):
    data = {"a": [(START + timedelta(seconds=i), 1000.0 - 10 * i) for i in range(60)]}
    got = series.traffic_features(make(spark, data), ["k"], "ts", "x")
    assert got.agg(F.max("burst_probability")).first()[0] == 0.0


def test_thresholds_look_past_long_ties(spark):
    a = [(t, x) for i, (t, x) in enumerate(walk(8, 400)) for _ in range(500 if i == 330 else 3 if i % 9 == 0 else 1)]
    data = {"a": a, "b": [(START, 5.0)] * 120, None: walk(9, 130)}
    rows = {}
    for r in series.traffic_features(make(spark, data), ["k"], "ts", "x").orderBy("k", "ts", "sample_no").collect():
        rows.setdefault(r["k"], []).append([r[n] for n in NAMES])
    for key, samples in data.items():
        assert np.allclose(rows[key], expected_features(samples), atol=1e-9), key


def test_equal_times_keep_the_velocity(spark):
    data = {"a": [(START, 0.0), (START + timedelta(seconds=2), 10.0), (START + timedelta(seconds=2), 10.0)]}
    got = series.velocity(make(spark, data), ["k"], "ts", "x").orderBy("sample_no").collect()
    assert [r["velocity"] for r in got] == [0.0, 5.0, 5.0]
    assert got[2]["step"] is None and got[2]["step_no"] == 1


def test_warm_up_rows_are_zero(spark):
    got = series.traffic_features(make(spark, {"a": walk(5, 5)}), ["k"], "ts", "x").orderBy("ts").collect()
    assert all(r["hour_cos"] == 0.0 and r["rolling_mean"] == 0.0 for r in got[:4])
    assert got[4]["hour_cos"] == pytest.approx(1.0)


def test_backlog_equals_the_loop(spark):
    rates = [random.Random(7).randint(0, 220) for _ in range(200)]
    rows = [("a", START + timedelta(hours=i), r) for i, r in enumerate(rates)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, arrivals bigint")
    got = series.backlog(df, ["k"], "ts", "arrivals", 100).orderBy("ts").collect()
    queue = 0
    for r, rate in zip(got, rates):
        queue += max(0, rate - 100)
        assert r["latency_estimate_ms"] == 100 + 2 * queue
        queue -= min(queue, max(0, 100 - rate))
        assert r["backlog"] == queue


def test_idle_runs(spark):
    levels = [5, 5, 50, 5, 5, 5, 50, 50, 5]
    data = {"a": [(START + timedelta(minutes=i), x) for i, x in enumerate(levels)]}
    got = series.idle_runs(make(spark, data), ["k"], "ts", "x", below=20, timeout=2).orderBy("run_start")
    assert [(r["steps"], r["timeouts"]) for r in got.collect()] == [(2, 1), (3, 1), (1, 0)]


def test_crossover_uses_time_not_rows(spark):
    data = {"a": [(START, 10.0), (START + timedelta(seconds=30), 10.0), (START + timedelta(seconds=58), 100.0)]}
    got = series.ma_crossover(make(spark, data), ["k"], "ts", "x").orderBy("ts").collect()
    assert got[2]["short_avg"] == 100.0 and got[2]["long_avg"] == 40.0
    assert [r["burst_signal"] for r in got] == [0, 0, 1]


def test_small_windows(spark):
    data = {"a": [(START + timedelta(hours=i), float(i)) for i in range(12)]}
    df = make(spark, data)
    smooth = series.moving_smooth(df, ["k"], "ts", "x").orderBy("ts").collect()
    assert [r["smoothed"] for r in smooth] == [4.5, 5.5, 6.5]
    ahead = series.lookahead(df, ["k"], "ts", "x").orderBy("ts").collect()
    assert [r["future"] for r in ahead] == [10.0, 11.0] + [None] * 10
    tail = series.tail_stats(df, ["k"], "ts", "x", rows=4).first()
    assert (tail["tail_mean"], tail["tail_rows"]) == (9.5, 4)


def test_unfinished_episode_is_left_out(spark):
    rows = [("a", START + timedelta(hours=i), 1, 100.0 + 50 * i, 2.0, 90.0) for i in range(12)]
    df = spark.createDataFrame(
        rows, "k string, ts timestamp, message_count int, latency_ms double, cost double, throughput double"
    )
    eps = batches.episodes(df, ["k"], "ts")
    got = eps.orderBy("episode").collect()
    assert [(r["episode"], r["avg_latency_ms"], r["violations"]) for r in got] == [(1, 200.0, 2), (2, 450.0, 5)]
    scored = batches.episode_scores(eps, ["k"]).orderBy("episode").collect()
    assert scored[0]["score"] == pytest.approx(1.0 + 0.5 - 1.0)
    assert scored[1]["score"] == pytest.approx(-1.25 + 0.5 - 2.5)
    # Context at midnight asks for (.5, .3, .2); the first shift is against (.33, .33, .34).
    assert scored[0]["weight_shift"] == pytest.approx(0.17 + 0.03 + 0.14)


@pytest.mark.parametrize("salts, slice_seconds", [(1, 3600), (4, 3600), (3, 10**9)])
def test_asof_join_equals_search(spark, salts, slice_seconds):
    r = random.Random(11)
    # One patient holds most rows on both sides, and many hours have no signal.
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(i, r.choice(keys), START + timedelta(seconds=r.randint(0, 200_000))) for i in range(800)]
    right = [
        (r.choice(keys), START + timedelta(seconds=r.randint(0, 100) * 2000), float(i), i % 2 == 0)
        for i in range(60)
    ]
    ldf = spark.createDataFrame(left, "id int, k string, ts timestamp")
    rdf = spark.createDataFrame(right, "k string, ts timestamp, load double, alarm boolean")
    joined = lookups.asof_join(ldf, rdf, ["k"], "ts", ["load", "alarm"], slice_seconds, salts).collect()
    got = {row["id"]: row["load"] for row in joined}
    assert len(got) == len(joined) == len(left)
    for i, k, t in left:
        past = [(s, load) for key, s, load, _ in right if k is not None and key == k and s <= t]
        assert got[i] == (max(past)[1] if past else None)


def test_percentiles_are_exact(spark):
    r = random.Random(3)
    data = {
        "hot": [r.lognormvariate(0, 3) for _ in range(30_000)],
        "same": [1.5] * 9000,
        "two": [7.0] * 6000 + [8.0] * 3000,
        "steps": [float(r.randint(0, 3)) for _ in range(9000)],
        "wide": [r.uniform(-1, 1) * 10 ** r.randint(-12, 12) for _ in range(3000)] + [0.0] * 50,
        "close": [1e6 + i * 1e-9 for i in range(2000)],
        "few": [3.0, 1.0, 2.0],
        None: [7.0],
    }
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k string, x double")
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {row["k"]: row for row in quantiles.percentiles(df, ["k"], "x", probs).collect()}
    near = {row["k"]: row for row in quantiles.nearest_ranks(df, ["k"], "x", probs).collect()}
    for k, xs in data.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.percentile(xs, 100 * p), rel=1e-12), (k, name)
            assert near[k][name] == sorted(xs)[min(int(p * len(xs)), len(xs) - 1)], (k, name)
        assert got[k]["rows"] == len(xs)


def test_percentiles_sort_infinite_and_missing_numbers_last(spark):
    xs = [1.0, float("inf"), float("-inf"), float("nan"), 2.0]
    df = spark.createDataFrame([("a", x) for x in xs] + [("a", None)], "k string, x double")
    row = quantiles.nearest_ranks(df, ["k"], "x", {"q0": 0.0, "q2": 0.4, "q3": 0.6, "q4": 0.9}).first()
    assert (row["rows"], row["q0"], row["q2"], row["q3"]) == (5, float("-inf"), 2.0, float("inf"))
    assert math.isnan(row["q4"])


def test_percentiles_start_no_job_while_the_plan_is_built(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    quantiles.percentiles(spark.range(10).selectExpr("id % 2 AS k", "id AS x"), ["k"], "x", {"p": 0.5})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
