"""Hand-written rows for every formula, edge cases included."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom import dimensions
from sensorloom.functions import capacity, condition, message, score, timeparts
from sensorloom.operators import aggregates, lookups, messages


def one(spark, **columns):
    """The single row that the given expressions make."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_identity_skips_empty_text(spark):
    rows = spark.createDataFrame(
        [("", "d1", "m1"), (None, "", "m2"), (None, None, None), ("s", "d", "m")],
        "sensor_id string, device_id string, machine_id string",
    )
    found = [r[0] for r in rows.select(message.device_ref()).collect()]
    assert found == ["d1", "m2", None, "s"]


@pytest.mark.parametrize(
    "pattern, topic, hit",
    [
        ("iot/#", "iot/a/b/c", True),
        ("iot/#", "iot", True),
        ("iot/#", "iotx/a", False),
        ("iot/+/data", "iot/x/data", True),
        ("iot/+/data", "iot/x/y/data", False),
        ("hospital/+/vitals", "hospital/ICU/vitals", True),
        ("hospital/+/vitals", "hospital//vitals", False),
        ("a.b/c", "axb/c", False),
        ("#", "anything/at/all", True),
        ("a.b/+", "a.b/c", True),
        ("a.b/+", "axb/c", False),
    ],
)
def test_topic_patterns(spark, pattern, topic, hit):
    assert one(spark, m=message.topic_matches(F.lit(topic), pattern))["m"] is hit


def test_topic_level_is_null_when_absent(spark):
    got = one(
        spark, a=message.topic_level(F.lit("hospital/ICU/vitals"), 1), b=message.topic_level(F.lit("x"), 1)
    )
    assert got == {"a": "ICU", "b": None}


def test_unreadable_times_are_null(spark):
    texts = ["2024-01-01T05:00:00", "not a time", None, "2024-02-30T00:00:00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(message.event_time(F.col("t")))
    assert [r[0] is None for r in rows.collect()] == [False, True, True, True]


def test_bad_field_leaves_its_siblings(spark):
    row = spark.createDataFrame([('{"metrics":{"vehicle_count":1.5,"aqi":7}}',)], "value string")
    got = messages.parse(row, "metrics struct<vehicle_count: int, aqi: int>").select("data.metrics.*").first()
    assert got.asDict() == {"vehicle_count": None, "aqi": 7}


def test_split_keeps_every_row_once(spark):
    texts = ['{"sensor_id":"a"}', "{bad", "", "[1,2", '{"metrics":{"x":1}}']
    rows = spark.createDataFrame(
        [("t", None, t, None, i) for i, t in enumerate(texts)],
        "topic string, key string, value string, broker_ts timestamp, offset bigint",
    )
    good, bad = messages.split_faulty(messages.probe(rows))
    assert sorted(r["offset"] for r in bad.collect()) == [1, 2, 3]
    assert sorted(r["offset"] for r in good.collect()) == [0, 4]


def test_payload_kind_takes_the_first_block(spark):
    rows = spark.createDataFrame(
        [('{"vitals":{"a":1},"metrics":{"z":9,"y":8,"x":7,"w":6}}',), ('{"sensors":{"a":1}}',), ("{}",)],
        "value string",
    )
    got = messages.probe(rows, blocks=True).select(
        message.payload_kind("m.").alias("k"), message.first_entries(F.col("m.metrics")).alias("f")
    )
    assert [tuple(r) for r in got.collect()] == [("metrics", "z=9,y=8,x=7"), ("sensors", None), ("none", None)]


@pytest.mark.parametrize(
    "vehicles, speed, level",
    [(81, 24.9, "HIGH"), (80, 10.0, "MEDIUM"), (51, 39.9, "MEDIUM"), (50, 1.0, "LOW"), (81, 40.0, "LOW")],
)
def test_congestion(spark, vehicles, speed, level):
    assert one(spark, c=condition.congestion(F.lit(vehicles), F.lit(speed)))["c"] == level


def test_occupancy_of_no_spots(spark):
    assert one(spark, r=condition.occupancy_rate(F.lit(0), F.lit(0)))["r"] is None
    assert one(spark, r=condition.occupancy_rate(F.lit(1), F.lit(3)))["r"] == 33.33


def vitals(spark, *rows):
    return spark.createDataFrame(
        list(rows), "heart_rate double, spo2 double, temperature double, systolic_bp double, resp_rate double"
    )


def labels(df, rules, **kw):
    return [r[0] for r in df.select(condition.alert_labels(dimensions.RULES[rules], **kw)).collect()]


def test_rule_edges(spark):
    edge = vitals(spark, (40.0, 92.0, 39.5, 90.0, 22.0), (120.0, 92.0, 39.5, 90.0, 22.0))
    assert labels(edge, "base") == [[], []]
    beyond = vitals(spark, (39.9, 91.9, 39.6, 89.9, 22.1))
    assert labels(beyond, "base")[0] == [
        "Cardiac Risk",
        "Hypoxia",
        "Hyperthermia",
        "Haemodynamic Shock",
        "Respiratory Distress",
    ]
    assert labels(vitals(spark, (None, None, None, None, None)), "base") == [[]]


def test_sepsis_needs_all_four_signs(spark):
    rows = vitals(spark, (107.0, 91.0, 38.9, 100.0, 23.0), (107.0, 91.0, 38.8, 100.0, 23.0))
    found = labels(rows, "strict", with_sepsis=True)
    assert "Sepsis Risk" in found[0] and "Sepsis Risk" not in found[1]


def test_leading_alert_order(spark):
    def lead(*names):
        array = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        return one(spark, a=condition.leading_alert(array))["a"]

    assert lead("Hypoxia", "Cardiac Risk") == "Cardiac Risk"
    assert lead("Hypoxia", "Sepsis Risk") == "Sepsis Risk"
    assert lead("Haemodynamic Shock", "Hypoxia") == "Hypoxia"
    assert lead("Respiratory Distress") is None
    assert lead() is None


def test_clamp_keeps_null(spark):
    got = one(
        spark,
        low=condition.clamp(F.lit(1.0), 40.0, 180.0),
        high=condition.clamp(F.lit(500.0), 40.0, 180.0),
        none=condition.clamp(F.lit(None).cast("double"), 40.0, 180.0),
    )
    assert got == {"low": 40.0, "high": 180.0, "none": None}


def test_machine_status(spark):
    def status(wear, odd):
        return one(spark, **condition.machine_status(F.lit(wear), F.lit(odd)))

    assert status(0.96, True) == {
        "operational": False,
        "alert_level": "CRITICAL",
        "remaining_life_hours": 40,
        "efficiency_percent": pytest.approx(71.2),
    }
    assert status(0.5, True)["alert_level"] == "WARNING"
    assert status(0.9, False)["alert_level"] == "NORMAL"


def test_time_flags(spark):
    def flags(text):
        ts = F.lit(text).cast("timestamp_ntz")
        got = one(
            spark, r=timeparts.is_rush_hour(ts), d=timeparts.is_daytime(ts), b=timeparts.is_business_hour(ts)
        )
        return got["r"], got["d"], got["b"]

    assert flags("2024-01-01 07:00:00") == (True, True, False)
    assert flags("2024-01-01 10:00:00") == (False, True, True)
    assert flags("2024-01-06 10:00:00") == (False, True, False)
    assert flags("2024-01-01 19:59:59") == (True, True, False)
    assert flags("2024-01-01 23:00:00") == (False, False, False)


def test_weights(spark):
    a, b, c = score.normalised(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert one(spark, a=a, b=b, c=c)["a"] == pytest.approx(1 / 3)
    a, b, c = score.normalised(F.lit(-1.0), F.lit(2.0), F.lit(1.0))
    assert one(spark, a=a, b=b, c=c) == {"a": 0.25, "b": 0.5, "c": 0.25}
    a, b, c = score.softmax(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))
    got = one(spark, a=a, b=b, c=c)
    assert got["a"] == pytest.approx(0.5) and got["c"] == pytest.approx(0.0)


def test_dominant_ties(spark):
    def who(*w):
        return one(spark, d=score.dominant(*[F.lit(x) for x in w]))["d"]

    assert who(0.2, 0.6, 0.2) == "LATENCY"
    assert who(0.6, 0.2, 0.2) == "COST"
    assert who(0.4, 0.4, 0.2) == "THROUGHPUT"


def test_scores_at_their_limits(spark):
    got = one(
        spark,
        ok=score.latency_score(F.lit(200.0)),
        late=score.latency_score(F.lit(300.0)),
        cheap=score.cost_score(F.lit(10.0)),
        dear=score.cost_score(F.lit(15.0)),
        flat=score.cost_score(F.lit(15.0), flat_overrun=True),
    )
    assert got == {"ok": 1.0, "late": -0.5, "cheap": 0.5, "dear": -0.5, "flat": -1.0}


def test_context_weights_order(spark):
    def weights(latency, cost, business):
        return tuple(one(spark, w=score.context_weights(F.lit(latency), F.lit(cost), F.lit(business)))["w"])

    assert weights(1.3, 2.0, True) == (0.2, 0.6, 0.2)
    assert weights(1.2, 1.1, True) == (0.6, 0.2, 0.2)
    assert weights(1.0, 1.0, True) == (0.3, 0.5, 0.2)
    assert weights(1.0, 1.0, False) == (0.5, 0.3, 0.2)


@pytest.mark.parametrize(
    "base, value, lower, want",
    [
        (0.0, 0.0, True, 0.0),
        (0.0, 5.0, True, -100.0),
        (200.0, 150.0, True, 25.0),
        (0.0, 5.0, False, 100.0),
        (0.0, 0.0, False, 0.0),
        (50.0, 75.0, False, 50.0),
    ],
)
def test_improvement(spark, base, value, lower, want):
    assert one(spark, i=score.improvement(F.lit(base), F.lit(value), lower))["i"] == want


def test_floored_improvement(spark):
    assert one(spark, i=score.improvement_floored(F.lit(0.5), F.lit(0.0)))["i"] == 50.0


@pytest.mark.parametrize(
    "rate, cpu, regime",
    [
        (19.0, 14.0, "NIGHT_IDLE"),
        (19.0, 15.0, "NORMAL"),
        (100.0, 50.0, "BUSINESS_HOURS"),
        (300.0, 50.0, "BUSINESS_HOURS"),
        (350.0, 99.0, "NORMAL"),
        (401.0, 81.0, "TRAFFIC_BURST"),
    ],
)
def test_load_regime(spark, rate, cpu, regime):
    assert one(spark, r=capacity.load_regime(F.lit(rate), F.lit(cpu)))["r"] == regime


@pytest.mark.parametrize(
    "args, want",
    [
        (dict(rate=10.0, cpu=10.0), ("scale_down", 0, 0.95)),
        (dict(rate=10.0, cpu=50.0, current=5), ("scale_down", 2, 0.85)),
        (dict(rate=30.0, current=1), ("scale_down", 1, 0.85)),
        (dict(rate=100.0, burst=0.7, velocity=6.0, current=48), ("pre_warm", 50, 0.92)),
        (dict(rate=100.0, edge=1.0, current=3), ("pre_warm", 7, 0.90)),
        (dict(rate=450.0, current=2), ("scale_up", 9, 0.88)),
        (dict(rate=100.0, cpu=90.0, current=2), ("scale_up", 4, 0.88)),
        (dict(rate=100.0, beta=0.8, latency=1001.0, current=2), ("scale_up", 5, 0.85)),
        (dict(rate=100.0, alpha=0.9, current=4), ("scale_down", 3, 0.75)),
        (dict(rate=100.0, alpha=0.9, current=1), ("maintain", 1, 0.0)),
        (dict(rate=100.0, current=4), ("maintain", 4, 0.80)),
    ],
)
def test_recommendation_cases(spark, args, want):
    base = dict(
        rate=0.0, cpu=50.0, latency=100.0, current=2, burst=0.0, velocity=0.0, edge=0.0, alpha=0.3, beta=0.3
    )
    columns = [F.lit(v) for v in {**base, **args}.values()]
    assert tuple(one(spark, d=capacity.recommendation(*columns))["d"]) == want


def test_fixed_capacity(spark):
    got = one(spark, **capacity.fixed_capacity(F.lit(300.0), executors=5))
    assert got == {"utilisation": 1.2, "pool_latency_ms": 1060, "processed": 250.0, "overloaded": True}


def test_tiers(spark):
    got = one(
        spark,
        hot=capacity.tier_label(F.lit(250.1)),
        warm=capacity.tier_label(F.lit(250.0)),
        cold=capacity.tier_label(F.lit(100.0)),
        burst=capacity.temperature_route(F.lit(0.0), F.lit(True)),
        edge=capacity.temperature_route(F.lit(0.8), F.lit(False)),
        low=capacity.temperature_route(F.lit(0.3), F.lit(False)),
        wrong=capacity.misplaced(F.lit(0.71), F.lit(2)),
        fine=capacity.misplaced(F.lit(0.7), F.lit(2)),
    )
    assert got == {
        "hot": "HOT",
        "warm": "WARM",
        "cold": "COLD",
        "burst": "HOT",
        "edge": "WARM",
        "low": "COLD",
        "wrong": True,
        "fine": False,
    }


def test_unknown_scenario_and_topic_take_defaults(spark):
    names = spark.createDataFrame([("nowhere",), (None,), ("smart_city_budget",)], "n string")
    got = lookups.with_scenario(names, F.col("n")).select("scenario", "alpha").collect()
    assert [tuple(r) for r in got] == [("balanced", 0.33), ("balanced", 0.33), ("smart_city_budget", 0.9)]
    topics = spark.createDataFrame([("iot/nowhere",), (None,)], "topic string")
    assert [r["target_topic"] for r in lookups.route(topics).collect()] == ["iot-unknown-raw"] * 2


def test_scenarios_from_a_settings_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "scenarios.yaml"
    path.write_text("night:\n  alpha: 0.8\n  beta: 0.1\n  gamma: 0.1\nbalanced:\n  alpha: 0.3\n  beta: 0.3\n  gamma: 0.4\n")
    settings = dimensions.scenarios_from_yaml(str(path))
    names = spark.createDataFrame([("night",), ("smart_city_budget",)], "n string")
    got = lookups.with_scenario(names, F.col("n"), settings).select("n", "scenario", "gamma").collect()
    assert [tuple(r) for r in got] == [("night", "night", 0.1), ("smart_city_budget", "balanced", 0.4)]


def test_retention_with_a_default(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES ('iot-healthcare-raw', TIMESTAMP_NTZ '2024-01-17 00:00:00'), ('x', TIMESTAMP_NTZ '2024-01-17 00:00:00'),
           ('iot-healthcare-raw', TIMESTAMP_NTZ '2024-01-16 23:59:59'), ('x', TIMESTAMP_NTZ '2023-01-01 00:00:00') AS t(target_topic, ts)"""
    )
    kept = lookups.retained(rows, "ts", "2024-01-31 00:00:00")
    assert sorted(r[0] for r in kept.collect()) == ["iot-healthcare-raw", "x", "x"]
    capped = lookups.retained(rows, "ts", "2024-01-31 00:00:00", default_days=14)
    assert sorted(r[0] for r in capped.collect()) == ["iot-healthcare-raw", "x"]


def test_no_predictions_is_zero_accuracy(spark):
    rows = spark.createDataFrame(
        [("k", "maintain", 150.0, 0.0, 1), ("k", "maintain", 50.0, 0.0, 1)],
        "k string, action string, workload_rate double, burst_probability double, current_executors int",
    )
    got = aggregates.prediction_outcome(rows, ["k"]).first().asDict()
    assert got == {"k": "k", "prewarms": 0, "avoided": 0, "wasted": 0, "missed": 1, "accuracy": 0.0}


def test_histogram_of_one_value_and_closed_end(spark):
    rows = spark.createDataFrame([("a", 5.0)] * 3 + [("b", float(i)) for i in range(11)], "k string, x double")
    got = {(r["k"], r["bin"]): r["rows"] for r in aggregates.histogram(rows, ["k"], "x").collect()}
    assert got[("a", 5)] == 3 and got[("b", 9)] == 2 and sum(got.values()) == 14
    assert len(got) == 20


def test_latest_per_key_breaks_ties(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 0, 9, None)], "k string, t int, id int, v string")
    got = sorted(tuple(r) for r in aggregates.latest_per_key(rows, ["k"], "t", "id").collect())
    assert got == [("a", 1, 2, "y"), ("b", 0, 9, None)]


def test_peak_takes_the_first_position(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01', 5.0), ('a', TIMESTAMP '2024-01-02', 5.0) AS t(k, ts, x)"
    )
    assert str(aggregates.peak(rows, ["k"], "x", "ts").first()["peak_at"]) == "2024-01-01 00:00:00"


@settings(max_examples=25, deadline=None)
@given(st.floats(-50, 50), st.floats(-50, 50), st.floats(-50, 50))
def test_softmax_adds_up(spark, a, b, c):
    shares = score.softmax(F.lit(a), F.lit(b), F.lit(c))
    got = one(spark, x=shares[0], y=shares[1], z=shares[2])
    assert math.isclose(sum(got.values()), 1.0, rel_tol=1e-9)
