"""Streams against their batch twins: replay, lateness, restart, several sinks."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_series import NAMES, expected_features, walk

from sensorloom import schemas, session
from sensorloom.operators import aggregates, batches, messages, series
from sensorloom.sinks import files
from sensorloom.sinks.files import read_batches
from sensorloom.sinks.topics import SinkConfig, stream_records
from sensorloom.sources import tables, views
from sensorloom.sources.topics import SourceConfig, stream_files, stream_topics
from sensorloom.streaming import batch_log, joins, lifecycle, routing, stateful, windows

KEYS = ["window_start", "window_end", "sensor_type", "city"]


def write_file(df, base, number):
    """One more file for a replayed folder; files are read in the order they were written."""
    df.coalesce(1).write.mode("append").parquet(str(base))
    time.sleep(0.05)


@pytest.fixture(scope="module")
def four_files(spark, folder, tmp_path_factory):
    base = tmp_path_factory.mktemp("replay") / "events"
    ev = tables.table(spark, folder, "events")
    for part in range(4):
        write_file(ev.filter(F.col("event_id").between(part * 250, part * 250 + 249)), base, part)
    return str(base)


def events(spark, path, per_trigger=1):
    rows = stream_files(spark, path, schemas.EVENTS, files_per_trigger=per_trigger)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def city_rows(ev):
    return aggregates.with_occupancy(views.as_readings(ev))


def test_update_stream_equals_batch(spark, folder, four_files, tmp_path):
    changes = windows.sensor_windows(city_rows(events(spark, four_files)), width="1 hour")
    query = lifecycle.run(windows.changelog(changes, f"{tmp_path}/out", "w"), "update", f"{tmp_path}/cp")
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    got = windows.current(spark, f"{tmp_path}/out", KEYS, "w", changes.schema.toDDL())
    batch = aggregates.windowed_sensors(
        city_rows(tables.table(spark, folder, "events")).withColumn("ts", F.col("ts").cast("timestamp")),
        width="1 hour",
    )
    assert rows_of(got.select(*batch.columns), *KEYS) == rows_of(batch, *KEYS)


def test_append_stream_holds_back_only_open_windows(spark, folder, four_files, tmp_path):
    out = windows.sensor_windows(city_rows(events(spark, four_files)), width="1 hour")
    writer = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
    lifecycle.run(writer, "append", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    ev = tables.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = ev.agg(F.max("ts")).first()[0]
    batch = aggregates.windowed_sensors(city_rows(ev), width="1 hour").filter(
        F.col("window_end") <= F.lit(last - timedelta(seconds=10))
    )
    assert rows_of(got, *KEYS) == rows_of(batch, *KEYS)


def city_event(i, ts):
    return (i, ts, 1, "click", 1.0, "{}")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    batches = [
        [city_event(1, t), city_event(2, t + timedelta(minutes=10))],
        [city_event(3, t + timedelta(minutes=11))],
        # Ten minutes behind the watermark of 12:10:50.
        [city_event(4, t + timedelta(seconds=1)), city_event(5, t + timedelta(minutes=12))],
    ]
    for i, rows in enumerate(batches):
        write_file(spark.createDataFrame(rows, schemas.EVENTS), tmp_path / "in", i)
    out = windows.sensor_windows(city_rows(events(spark, f"{tmp_path}/in")))
    with batch_log.logged(spark, f"{tmp_path}/log"):
        query = lifecycle.run(windows.changelog(out, f"{tmp_path}/out", "w"), "late", f"{tmp_path}/cp")
    got = windows.current(spark, f"{tmp_path}/out", KEYS, "w", out.schema.toDDL())
    assert got.agg(F.sum("message_count")).first()[0] == 4
    log = batch_log.progress_table(spark, f"{tmp_path}/log", str(query.id))
    # The engine may count a dropped row at more than one step of the operator.
    assert log.agg(F.sum("late_rows")).first()[0] >= 1
    assert log.agg(F.sum("message_count")).first()[0] == 5


def test_restart_resumes_from_the_checkpoint(spark, folder, tmp_path):
    ev = tables.table(spark, folder, "events")
    source, out, cp = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"

    def go():
        changes = windows.sensor_windows(city_rows(events(spark, str(source))), width="1 hour")
        return lifecycle.run(windows.changelog(changes, out, "w"), "restart", cp)

    write_file(ev.filter("event_id < 500"), source, 0)
    first = go()
    write_file(ev.filter("event_id >= 500"), source, 1)
    second = go()
    assert str(first.id) == str(second.id)
    assert sum(p.numInputRows for p in second.recentProgress) == 500
    schema = windows.sensor_windows(city_rows(events(spark, str(source))), width="1 hour").schema.toDDL()
    table = windows.current(spark, out, KEYS, "w", schema)
    assert table.agg(F.sum("message_count")).first()[0] == ev.count()
    windows.compact(spark, out, KEYS, "w", schema, f"{tmp_path}/compacted")
    again = windows.current(spark, f"{tmp_path}/compacted", KEYS, "w", schema)
    assert rows_of(again, *KEYS) == rows_of(table, *KEYS)


def write_samples(spark, base, data, parts):
    """Each key's samples in time order, cut into files."""
    for part in range(parts):
        rows = [
            (k, t, x)
            for k, samples in data.items()
            for t, x in samples[len(samples) * part // parts : len(samples) * (part + 1) // parts]
        ]
        write_file(spark.createDataFrame(rows, "k string, ts timestamp, x double"), base, part)


def feature_rows(spark, tmp_path, history=300):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with lifecycle.rocksdb(spark):
        stream = stream_files(
            spark, f"{tmp_path}/in", "k string, ts timestamp, x double", files_per_trigger=1
        )
        out = stateful.feature_stream(stream, ["k"], "ts", "x", history)
        writer = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
        lifecycle.run(writer, "features", f"{tmp_path}/cp")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    rows = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("k", "sample_no").collect():
        rows.setdefault(r["k"], []).append([r[n] for n in NAMES])
    return rows


def test_stateful_features_equal_loop_and_batch(spark, tmp_path):
    data = {"a": walk(21, 160), "b": walk(22, 30), "c": walk(23, 4)}
    write_samples(spark, tmp_path / "in", data, 4)
    got = feature_rows(spark, tmp_path, history=60)
    batch = series.traffic_features(spark.read.parquet(f"{tmp_path}/in"), ["k"], "ts", "x", 60)
    twin = {}
    for r in batch.orderBy("k", "ts").collect():
        twin.setdefault(r["k"], []).append([r[n] for n in NAMES])
    for key, samples in data.items():
        want = expected_features(samples, 60)
        assert np.allclose(got[key], want, atol=1e-9) and np.allclose(twin[key], want, atol=1e-9)


def test_sample_from_the_past_gives_no_velocity(spark, tmp_path):
    t = datetime(2024, 1, 1)
    early = [(t + timedelta(seconds=i), 10.0 * i) for i in range(6)]
    late = [(t + timedelta(seconds=1), 500.0), (t + timedelta(seconds=9), 60.0)]
    write_samples(spark, tmp_path / "in", {"a": early + late}, 4)
    got = feature_rows(spark, tmp_path)["a"]
    assert np.allclose(got, expected_features(early + late), atol=1e-9)
    assert got[6][0] == got[5][0]


def test_stable_ramp_spike_and_settling(spark, tmp_path):
    """The features of a series that rests, climbs, jumps and rests again."""
    t = datetime(2024, 1, 1)
    levels = [50.0] * 20 + [50.0 + 5 * i for i in range(20)] + [600.0, 900.0] + [60.0] * 20
    data = {"a": [(t + timedelta(seconds=i), x) for i, x in enumerate(levels)]}
    write_samples(spark, tmp_path / "in", data, 3)
    got = feature_rows(spark, tmp_path)["a"]
    assert np.allclose(got, expected_features(data["a"]), atol=1e-9)
    by_name = [dict(zip(NAMES, row)) for row in got]
    assert by_name[19]["velocity"] == 0 and by_name[30]["velocity"] == 5
    assert by_name[41]["velocity"] == 300 and by_name[61]["velocity"] == 0


def test_newest_change_of_one_query_only(spark, tmp_path):
    schema = "k string, x string"
    for query, batch, x in (("run-1", 7, "old"), ("run-2", 0, "new")):
        files.write_batch(spark.createDataFrame([("a", x)], schema), f"{tmp_path}/log", query, batch)
    for query, x in (("run-1", "old"), ("run-2", "new")):
        assert windows.current(spark, f"{tmp_path}/log", ["k"], query, schema).first()["x"] == x
    assert windows.current(spark, f"{tmp_path}/none", ["k"], "q", schema).count() == 0


def test_log_outlives_the_engines_short_history(spark, folder, tmp_path):
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, "5")
    try:
        ev = tables.table(spark, folder, "events")
        for part in range(12):
            write_file(ev.filter(F.col("event_id") % 12 == part), tmp_path / "in", part)
        rows = events(spark, f"{tmp_path}/in").select("event_id")
        with batch_log.logged(spark, f"{tmp_path}/log"):
            query = lifecycle.run(rows.writeStream.format("noop").outputMode("append"), "short", f"{tmp_path}/cp")
        assert len(query.recentProgress) <= 5
    finally:
        spark.conf.set(name, before)
    log = batch_log.progress_table(spark, f"{tmp_path}/log", str(query.id)).filter("message_count > 0")
    assert log.agg(F.sum("message_count"), F.count(F.lit(1))).first()[:] == (1000, 12)


@pytest.mark.parametrize("salts", [1, 8])
def test_left_outer_join_reports_unmatched_readings(spark, tmp_path, salts):
    t = datetime(2024, 1, 1)
    readings = [(i, "p", t + timedelta(minutes=10 * i)) for i in range(8)]
    signals = [("p", t + timedelta(minutes=m), float(m), False) for m in (0, 9, 15, 65)]
    write_file(spark.createDataFrame(readings, "id int, patient_id string, ts timestamp"), tmp_path / "r", 0)
    write_file(spark.createDataFrame(signals, schemas.EDGE_SIGNAL), tmp_path / "s", 0)
    # A later row on each side moves the watermark past the readings.
    write_file(
        spark.createDataFrame([(99, "q", t + timedelta(days=1))], "id int, patient_id string, ts timestamp"),
        tmp_path / "r",
        1,
    )
    write_file(
        spark.createDataFrame([("q", t + timedelta(days=1, hours=1), 0.0, False)], schemas.EDGE_SIGNAL),
        tmp_path / "s",
        1,
    )
    left = stream_files(spark, f"{tmp_path}/r", "id int, patient_id string, ts timestamp", files_per_trigger=1)
    right = stream_files(spark, f"{tmp_path}/s", schemas.EDGE_SIGNAL, files_per_trigger=1)
    joined = joins.edge_interval_join(left, right, "patient_id", lookback="10 minutes", salts=salts)
    writer = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
    lifecycle.run(writer, "outer", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").filter("id <> 99").collect()
    found = {r["id"]: r["predicted_load"] for r in got}
    assert len(got) == len(found)
    assert found == {0: 0.0, 1: 9.0, 2: 15.0, 3: None, 4: None, 5: None, 6: None, 7: 65.0}


def test_fan_out_is_idempotent(spark, folder, tmp_path):
    envelope = views.envelope(spark, folder)
    handle = routing.fan_out(SinkConfig(format="parquet", path=f"{tmp_path}/out"), "q")

    def counts():
        rows = read_batches(spark, f"{tmp_path}/out", routing.RECORDS).groupBy("sink").count().collect()
        return {r["sink"]: r["count"] for r in rows}

    handle(envelope, 0)
    once = counts()
    handle(envelope, 0)
    assert counts() == once and set(once) == {"routed", "validated", "alerts", "analytics", "dead"}
    good, bad = messages.split_faulty(messages.probe(messages.decode(envelope)))
    assert once["routed"] == good.count() and once["routed"] + bad.count() == envelope.count()
    assert once["validated"] + once["dead"] == envelope.count()


def test_empty_batches_never_reach_the_handler(spark, tmp_path):
    write_file(spark.createDataFrame([city_event(1, datetime(2024, 1, 1))], schemas.EVENTS), tmp_path / "in", 0)
    seen = []
    rows = events(spark, f"{tmp_path}/in").filter("event_id < 0")
    lifecycle.run(lifecycle.each_batch(rows, lambda df, i: seen.append(i)), "empty", f"{tmp_path}/cp")
    assert seen == []


def test_failing_handler_stops_the_query(spark, four_files, tmp_path):
    def fail(batch, batch_id):
        raise RuntimeError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        lifecycle.run(lifecycle.each_batch(events(spark, four_files), fail), "fails", f"{tmp_path}/cp")


def test_repeats_within_the_watermark(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [city_event(1, t), city_event(1, t), city_event(2, t)]
    write_file(spark.createDataFrame(rows, schemas.EVENTS), tmp_path / "in", 0)
    write_file(spark.createDataFrame([city_event(1, t + timedelta(seconds=1))], schemas.EVENTS), tmp_path / "in", 1)
    once = windows.without_repeats(events(spark, f"{tmp_path}/in"), ["event_id"], "ts", "1 minute")
    writer = once.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
    lifecycle.run(writer, "repeats", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_two_queries_from_one_parse(spark, folder, tmp_path, capfd):
    """Raw view and aggregate side by side on the console, from envelopes in files."""
    views.envelope(spark, folder).write.parquet(f"{tmp_path}/in")
    source = SourceConfig(
        topics=["iot/smartcity/sensors"],
        format="parquet",
        path=f"{tmp_path}/in",
        schema="topic string, partition int, key string, value string, timestamp timestamp_ntz, offset bigint",
        max_files_per_trigger=1,
    )
    flat = messages.flatten_city(messages.decode(stream_topics(spark, source)))
    raw = lifecycle.show_appended(
        flat.select("sensor_id", "vehicle_count"), "raw_view", f"{tmp_path}/cp-raw", every=None
    )
    agg = lifecycle.show_updated(
        windows.sensor_windows(flat, ts="event_ts"), "window_view", f"{tmp_path}/cp-agg", every=None
    )
    assert lifecycle.await_all([raw, agg], timeout_s=120)
    assert raw.exception() is None and agg.exception() is None
    assert raw.name == "raw_view" and agg.name == "window_view"
    lifecycle.stop_all(spark)


def test_await_counts_seconds(spark, tmp_path):
    rate = spark.readStream.format("rate").load()
    query = lifecycle.start(
        rate.writeStream.format("noop").outputMode("append"), "rate", f"{tmp_path}/cp", every="1 second"
    )
    began = time.monotonic()
    assert lifecycle.await_all([query], timeout_s=2) is False
    assert time.monotonic() - began < 20
    lifecycle.stop_all(spark)
    assert not spark.streams.active


def test_listener_writes_one_record_per_batch(spark, four_files, tmp_path):
    with batch_log.logged(spark, f"{tmp_path}/log"):
        rows = events(spark, four_files).select("event_id")
        writer = rows.writeStream.format("noop").outputMode("append")
        query = lifecycle.run(writer, "logged", f"{tmp_path}/cp")
    log = batch_log.progress_table(spark, f"{tmp_path}/log", str(query.id)).filter("message_count > 0")
    assert log.agg(F.sum("message_count"), F.countDistinct("batch_id")).first()[:] == (1000, 4)


def test_episodes_survive_a_restart(spark, folder, tmp_path):
    """Six batches in two runs of one query make three episodes of two batches."""
    ev = tables.table(spark, folder, "events")
    for part in range(6):
        write_file(ev.filter(F.col("event_id") % 6 == part), tmp_path / "in", part)
        if part in (2, 5):
            rows = events(spark, f"{tmp_path}/in").select("event_id")
            writer = rows.writeStream.format("noop").outputMode("append")
            with batch_log.logged(spark, f"{tmp_path}/log"):
                query = lifecycle.run(writer, "eps", f"{tmp_path}/cp")
    log = batch_log.progress_table(spark, f"{tmp_path}/log", str(query.id))
    eps = batches.episodes(batch_log.as_batches(log, executors=2), ["query_id"], "batch_id", length=2)
    got = eps.orderBy("episode").collect()
    assert [(r["episode"], r["steps"], r["total_cost"]) for r in got] == [(1, 2, 2.0), (2, 2, 2.0), (3, 2, 2.0)]
    totals = batches.cumulative(batch_log.as_batches(log, 2), ["query_id"], "batch_id")
    assert totals.agg(F.max("total_messages"), F.max("total_batches")).first()[:] == (1000, 6)


def test_records_stream_to_a_keyed_log(spark, four_files, tmp_path):
    rows = views.as_vitals(events(spark, four_files))
    records = messages.as_records(rows, F.lit("iot-validated-data"), F.col("patient_id"), "event_id", "ward")
    config = SinkConfig(format="parquet", path=f"{tmp_path}/log")
    lifecycle.run(stream_records(records, config), "records", f"{tmp_path}/cp")
    back = spark.read.parquet(f"{tmp_path}/log")
    assert back.count() == 1000 and back.select("topic").distinct().first()[0] == "iot-validated-data"


def test_shared_folder_is_stable(spark):
    folder = session.shared_dir(spark)
    assert folder == session.shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    first, second = session.run_dir(spark, "x"), session.run_dir(spark, "x")
    assert first != second and first.startswith(folder)
