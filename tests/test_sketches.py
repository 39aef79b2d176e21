"""Sketches and the exact percentiles that they steer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import quantiles, sketches
from sensorloom.plans import rollups
from sensorloom.plans.catalog import QUERIES
from sensorloom.sources import views

PROBS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def narrow():
    r = random.Random(8)
    day = 1_700_000_000_000_000
    return {
        "latency": [1000 + r.random() * 0.06 for _ in range(20_000)],
        "micros": [float(day + r.randrange(86_400_000_000)) for _ in range(20_000)],
        "skewed": [r.lognormvariate(0, 3) for _ in range(10_000)],
        "same": [1000.03] * 3000,
        "few": [1000.01, 1000.02],
        "signed": [r.uniform(-1, 1) * 1e-9 for _ in range(2000)],
        None: [7.0],
    }


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, i % 5, x) for k, xs in narrow().items() for i, x in enumerate(xs)], "k string, part int, x double").cache()


@pytest.mark.parametrize("size", [64, 1024])
def test_percentiles_of_narrow_ranges_are_exact(frame, size):
    fine = sketches.quantile_sketches(frame, ["k", "part"], "x", size)
    merged = sketches.merged_quantiles(fine, ["k"], size)
    got = {r["k"]: r for r in quantiles.percentiles(frame, ["k"], "x", PROBS, merged, size).collect()}
    near = {r["k"]: r for r in quantiles.nearest_ranks(frame, ["k"], "x", PROBS, merged, size).collect()}
    for k, xs in narrow().items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.percentile(xs, 100 * p), rel=1e-12), (k, name)
            assert near[k][name] == sorted(xs)[min(int(p * len(xs)), len(xs) - 1)], (k, name)
        assert got[k]["rows"] == len(xs)


def test_wrong_or_missing_sketches_change_nothing(frame):
    other = sketches.quantile_sketches(frame.filter("k = 'skewed'").withColumn("k", F.lit("latency")), ["k"], "x")
    got = {r["k"]: r for r in quantiles.percentiles(frame, ["k"], "x", PROBS, other).collect()}
    for k, xs in narrow().items():
        assert [got[k][n] for n in PROBS] == pytest.approx([np.percentile(xs, 100 * p) for p in PROBS.values()], rel=1e-12)


def test_missing_infinite_and_no_numbers(spark):
    xs = [1.0, float("inf"), float("-inf"), float("nan"), 2.0]
    df = spark.createDataFrame([("a", x) for x in xs] + [("a", None), ("n", float("nan")), ("z", None)], "k string, x double")
    rows = {r["k"]: r for r in quantiles.nearest_ranks(df, ["k"], "x", {"q0": 0.0, "q2": 0.4, "q3": 0.6, "q4": 0.9}, sketches.quantile_sketches(df, ["k"], "x")).collect()}
    assert set(rows) == {"a", "n"}
    assert (rows["a"]["rows"], rows["a"]["q0"], rows["a"]["q2"], rows["a"]["q3"]) == (5, float("-inf"), 2.0, float("inf"))
    assert np.isnan(rows["a"]["q4"]) and np.isnan(rows["n"]["q0"])


def test_no_task_sorts_all_values_of_a_key(frame):
    """The cells that are looked into hold a small share of a key's values, and are ordered one by one."""
    merged = sketches.quantile_sketches(frame, ["k"], "x")
    edges = quantiles._edges(merged, ["k"], [0.5, 0.95], sketches.QUANTILE_SIZE)
    cells = frame.join(edges, F.expr("k <=> _of_k")).withColumn("cell", quantiles._cell_between("x", 4))
    held = cells.groupBy("k", "cell").agg(F.count_distinct("x").alias("n"))
    for k in ("latency", "micros"):
        sizes = {r["cell"]: r["n"] for r in held.filter(F.col("k") == k).collect()}
        inside = [n for cell, n in sizes.items() if cell // quantiles.PIECES in (1, 3)]
        assert max(inside) <= 20_000 / 256 and len(inside) > 100
    plan = quantiles.percentiles(frame, ["k"], "x", {"p": 0.5}, merged)._jdf.queryExecution().executedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Window [sum(_c" in line and "_x#" in line]
    assert by_value and all("_cell#" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in by_value)


def test_merged_estimates_stay_within_the_rank_error(spark):
    df = spark.range(60_000).select((F.col("id") % 24).alias("hour"), (F.col("id") * 7919 % 60_000).cast("double").alias("x"))
    merged = sketches.merged_quantiles(sketches.quantile_sketches(df, ["hour"], "x"), [])
    row = merged.select("rows", *[sketches.quantile("sketch", p).alias(f"p{int(100 * p)}") for p in (0.05, 0.5, 0.95)]).first()
    assert row["rows"] == 60_000
    for p in (0.05, 0.5, 0.95):
        assert abs(row[f"p{int(100 * p)}"] / 60_000 - p) <= 2 * sketches.rank_error()


def test_distincts_merge_over_levels(spark):
    df = spark.range(40_000).select((F.col("id") % 10).alias("hour"), (F.col("id") % 9_000).alias("user"))
    hourly = sketches.distinct_sketches(df, ["hour"], "user")
    whole = sketches.merged_distincts(hourly, []).select("rows", sketches.distincts("sketch").alias("n")).first()
    assert whole["rows"] == 40_000 and abs(whole["n"] - 9_000) <= 3 * sketches.distinct_error() * 9_000
    few = sketches.distinct_sketches(spark.range(30).selectExpr("id % 7 AS user"), [], "user").select(sketches.distincts("sketch")).first()[0]
    assert few == 7


def test_levels_read_the_raw_rows_once(spark, folder):
    ev = views.events(spark, folder).filter("ts IS NOT NULL")
    levels = rollups.user_levels(ev.select("event_type", "user_id", F.date_trunc("hour", "ts").alias("hour")))
    text = levels._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in text and "user_sketches" in text


def test_refined_percentiles_scan_twice_beside_the_sketches(spark, folder):
    text = QUERIES["latency_percentiles_refined"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 2
