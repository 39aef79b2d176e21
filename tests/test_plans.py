"""Physical plans: what reaches the scan, what shuffles, what must never appear."""

import pytest

from sensorloom.plans.catalog import QUERIES

BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan(spark, folder, name):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_query_pairs_everything_or_gathers_everything(spark, folder, name):
    text = plan(spark, folder, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "Python"):
        assert bad not in text, bad


@pytest.mark.parametrize(
    "name", ["raw_view", "json_flatten", "vitals_alerts", "alerts_long", "route_topics", "waveform_prefix"]
)
def test_row_work_never_shuffles(spark, folder, name):
    assert "Exchange hashpartitioning" not in plan(spark, folder, name)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("rolling_stats", "ts:timestamp_ntz,event_type:string"),
        ("latency_nearest_rank", "l_extendedprice:double,l_returnflag:string"),
        ("alert_rate_by_ward", "event_id:bigint,user_id:bigint"),
    ],
)
def test_scan_reads_only_what_is_used(spark, folder, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, folder, name)


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("congestion_level", "In(event_type, [click,signup])"),
        ("temperature_midway", "LessThanOrEqual(ts,2024-01-15T12:00)"),
        ("bounded_read_ranges", "GreaterThanOrEqual(event_id,0), LessThan(event_id,1330)"),
    ],
)
def test_filters_reach_the_scan(spark, folder, name, pushed):
    assert pushed in plan(spark, folder, name)


@pytest.mark.parametrize(
    "name", ["traffic_features", "burst_probability", "capacity_recommendation", "series_diagnostics"]
)
def test_features_read_the_table_once(spark, folder, name):
    text = plan(spark, folder, name)
    assert text.count("FileScan") == 1 and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["traffic_features", "burst_probability"])
def test_thresholds_are_taken_per_block(spark, folder, name):
    lines = plan(spark, folder, name).splitlines()
    windows = [line for line in lines if "- Window [" in line]
    gathering = [line for line in windows if "collect_list" in line]
    assert len(windows) <= 4 and len(gathering) == 1
    grouped = [i for i, line in enumerate(lines) if "collect_list(struct(" in line]
    assert lines.index(gathering[0]) < min(grouped)  # above the grouping: on blocks, not rows


@pytest.mark.parametrize("name", ["windowed_sensor_agg", "rolling_stats", "sla_report", "batch_volume"])
def test_raw_rows_are_counted_before_the_shuffle(spark, folder, name):
    text = plan(spark, folder, name)
    below = text[text.rindex("Exchange hashpartitioning") :]
    assert "partial_" in below


def test_asof_join_shuffles_left_rows_once(spark, folder):
    text = plan(spark, folder, "edge_asof_join")
    assert "Join" not in text
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_salt" in line]
    assert len(wide) == 2  # the rows themselves, and the distinct parts


@pytest.mark.parametrize("name, scans", [("domain_union", 1), ("latency_percentiles", 2), ("latency_percentiles_tied", 2), ("value_histogram", 2)])
def test_scans(spark, folder, name, scans):
    assert plan(spark, folder, name).count("FileScan") == scans


@pytest.mark.parametrize("name", ["dead_letter", "invalid_letter", "route_topics", "heat_alerts", "domain_union", "canonical_identity", "payload_kind"])
def test_payloads_are_parsed_once(spark, folder, name):
    text = plan(spark, folder, name)
    assert text.count("parseJson(") + text.count("from_json(") == 1

