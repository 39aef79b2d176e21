"""The same questions asked of replayed streams. Each must agree with its batch twin.

Each call leaves its log, checkpoint and output in a new folder below ``spark.checkpoint.dir``; the
returned rows are read from there, so the caller removes the folder when it is done with them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions, schemas
from ..functions import condition
from ..operators import aggregates, batches, messages, series
from ..session import prepare, run_dir
from ..sinks.files import read_batches, stored, write_batch
from ..sinks.topics import SinkConfig, stream_records
from ..sources import views
from ..sources.topics import SourceConfig, stream_files, stream_topics
from ..streaming import batch_log, idle, joins, lifecycle, routing, state, stateful, windows
from .messages import _IDENTITY, _TARGET
from .readings import _WINDOW_SQL, _labels_sql, raw_columns
from .registry import ORACLE, query
from .shape import neutral

PARTS = 4
WINDOW_KEYS = ["window_start", "window_end", "sensor_type", "city"]


def zoned(rows):
    """Event time with a zone, as watermarks need it."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def slices(spark, folder, parts=PARTS):
    """The whole events table cut into equal spans of time, in order; rows without a time come first."""
    ev = views.events(prepare(spark), folder)
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [ev]
    step = (last - first) / parts
    span = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) / (step.total_seconds() * 1e6))
    span = F.coalesce(F.least(span, F.lit(parts - 1)), F.lit(0)) if step else F.lit(0)
    return [ev.filter(span == k) for k in range(parts)]


def files_of(parts):
    """In how many files every delivery can be written: as many as there are cores, if all have the rows."""
    counted = reduce(DataFrame.unionAll, [part.agg(F.count(F.lit(1)).alias("n")) for part in parts])
    counts = [r.n for r in counted.collect() if r.n]
    return min([parts[0].sparkSession.sparkContext.defaultParallelism, *counts])


def append(rows, path, files):
    """One more delivery, in so many files; a stream takes deliveries in the order they were written."""
    rows.repartition(files).write.mode("append").parquet(path)


def deliver(spark, folder, base, parts=PARTS, to="in", like=lambda rows: rows):
    """(path, files of a delivery): the events table as a folder of deliveries in the order of time."""
    cut = slices(spark, folder, parts)
    files = files_of(cut)
    for part in cut:
        append(like(part), f"{base}/{to}", files)
    return f"{base}/{to}", files


def replay(spark, delivered):
    """A stream of deliveries, one in each micro-batch."""
    path, files = delivered
    return zoned(stream_files(spark, path, schemas.EVENTS, files_per_trigger=files))


def _run(writer, name, base):
    """Read all there is; on a further call with the same folder the query goes on where it ended."""
    return lifecycle.run(writer, f"{name}-{uuid.uuid4().hex[:8]}", f"{base}/checkpoint")


def _windowed(rows, width):
    return windows.sensor_windows(aggregates.with_occupancy(views.as_readings(rows)), width=width)


def _window_table(spark, base, changes, name):
    return windows.current(spark, f"{base}/out", WINDOW_KEYS, name, changes.schema.toDDL())


_STREAM_WINDOW_SQL = (
    _WINDOW_SQL.format(width="1 hour").replace("count(DISTINCT sensor_id) AS unique_sensors,", "").strip()
)


@query(
    "stream_windowed_agg",
    _WINDOW_SQL.format(width="1 hour").replace("count(DISTINCT sensor_id) AS unique_sensors", "TRUE AS sensors_within"),
    views=("readings",),
)
def stream_windowed_agg(spark, folder):
    """Update-mode windows, read back as the newest version of each window; the estimate is checked."""
    base = run_dir(spark, "windowed")
    changes = _windowed(replay(spark, deliver(spark, folder, base)), "1 hour")
    _run(windows.changelog(changes, f"{base}/out", "windowed"), "windowed", base)
    table = _window_table(spark, base, changes, "windowed")
    counted = zoned(views.readings(spark, folder)).groupBy(F.window("ts", "1 hour").alias("w"), "sensor_type", "city")
    exact = counted.agg(F.count_distinct("sensor_id").alias("_exact")).select(
        F.col("w.start").alias("window_start"), "sensor_type", "city", "_exact"
    )
    off = F.abs(F.col("unique_sensors") - F.col("_exact"))
    checked = table.join(exact, ["window_start", "sensor_type", "city"], "left").withColumn(
        "sensors_within", off <= F.greatest(F.lit(1.0), 0.15 * F.col("_exact"))
    )
    return neutral(checked.drop("unique_sensors", "_exact"))


@query("stream_raw_view", ORACLE["raw_view"])
def stream_raw_view(spark, folder):
    """Append-mode raw view."""
    base = run_dir(spark, "raw")
    rows = replay(spark, deliver(spark, folder, base))
    view = raw_columns(aggregates.with_occupancy(views.as_readings(rows)))
    writer = view.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    _run(writer, "raw", base)
    return neutral(spark.read.schema(view.schema).parquet(f"{base}/out"))


@query("stream_interval_trigger", ORACLE["raw_view"])
def stream_interval_trigger(spark, folder):
    """The raw view by a query that runs every second until it is stopped, having read all there is."""
    base = run_dir(spark, "interval")
    rows = replay(spark, deliver(spark, folder, base))
    view = raw_columns(aggregates.with_occupancy(views.as_readings(rows)))
    writer = view.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    running = lifecycle.start(writer, f"interval-{uuid.uuid4().hex[:8]}", f"{base}/checkpoint", every="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return neutral(spark.read.schema(view.schema).parquet(f"{base}/out"))


@query(
    "stream_append_windows",
    f"""SELECT * FROM ({_WINDOW_SQL.format(width="30 seconds").replace("count(DISTINCT sensor_id) AS unique_sensors,", "")}) w
        WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND""",
    views=("readings",),
)
def stream_append_windows(spark, folder):
    """Append mode: 30-second windows that the watermark of 10 seconds has closed."""
    base = run_dir(spark, "append")
    out = _windowed(replay(spark, deliver(spark, folder, base)), "30 seconds")
    writer = out.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    _run(writer, "append", base)
    return neutral(spark.read.schema(out.schema).parquet(f"{base}/out").drop("unique_sensors"))


@query("stream_late_rows", _STREAM_WINDOW_SQL, views=("readings",))
def stream_late_rows(spark, folder):
    """The first delivery comes once more at the end, behind the watermark: nothing is counted twice."""
    base = run_dir(spark, "late")
    path, files = deliver(spark, folder, base)
    append(slices(spark, folder)[0], path, files)
    changes = _windowed(replay(spark, (path, files)), "1 hour")
    _run(windows.changelog(changes, f"{base}/out", "late"), "late", base)
    return neutral(_window_table(spark, base, changes, "late").drop("unique_sensors"))


@query("stream_restart", _STREAM_WINDOW_SQL, views=("readings",))
def stream_restart(spark, folder):
    """Stopped after half of the deliveries and started again on the same checkpoint."""
    base = run_dir(spark, "restart")
    parts = slices(spark, folder)
    files = files_of(parts)
    for half in (parts[: PARTS // 2], parts[PARTS // 2 :]):
        for part in half:
            append(part, f"{base}/in", files)
        changes = _windowed(replay(spark, (f"{base}/in", files)), "1 hour")
        _run(windows.changelog(changes, f"{base}/out", "restart"), "restart", base)
    return neutral(_window_table(spark, base, changes, "restart").drop("unique_sensors"))


@query(
    "stream_state_totals",
    """SELECT event_type, count(*) AS messages, round(sum(value), 6) AS value_sum, max(event_id) AS last_id FROM events GROUP BY event_type""",
)
def stream_state_totals(spark, folder):
    """Totals per type read from the state of a query that was stopped half-way and started again; it has no other output."""
    base = run_dir(spark, "state")
    parts = slices(spark, folder)
    files = files_of(parts)
    for half in (parts[: PARTS // 2], parts[PARTS // 2 :]):
        for part in half:
            append(part, f"{base}/in", files)
        totals = state.running_totals(
            replay(spark, (f"{base}/in", files)), ["event_type"], messages=F.count(F.lit(1)), value_sum=F.sum("value"), last_id=F.max("event_id")
        )
        _run(totals.writeStream.format("noop").outputMode("update"), "state", base)
    held = state.state_table(spark, f"{base}/checkpoint")
    return neutral(held.toDF("event_type", "messages", "value_sum", "last_id"))


@query("stream_compacted_windows", _STREAM_WINDOW_SQL, views=("readings",))
def stream_compacted_windows(spark, folder):
    """The table of newest windows read through two compactions, between which and after which the stream goes on."""
    base = run_dir(spark, "compacted")
    parts = slices(spark, folder)
    files, log = files_of(parts), None
    for k, part in enumerate(parts):
        append(part, f"{base}/in", files)
        changes = _windowed(replay(spark, (f"{base}/in", files)), "1 hour")
        _run(windows.changelog(changes, f"{base}/out", "compacted"), "compacted", base)
        log = windows.CompactedLog(spark, f"{base}/out", WINDOW_KEYS, "compacted", changes.schema.toDDL())
        if k in (1, 2):
            log.compact()
            log.expire(keep=1)
    return neutral(log.current().drop("unique_sensors"))


@query(
    "stream_two_sinks",
    """SELECT sensor_type, city, count(*) AS raw_rows, CAST(count(*) AS BIGINT) AS counted FROM readings GROUP BY ALL""",
    views=("readings",),
)
def stream_two_sinks(spark, folder):
    """Two queries over one log at the same time: raw rows appended, windows updated."""
    base = run_dir(spark, "two")
    path, tag = deliver(spark, folder, base), uuid.uuid4().hex[:8]
    view = views.as_readings(replay(spark, path)).select("sensor_type", "city", "ts")
    raw = view.writeStream.format("parquet").option("path", f"{base}/raw").outputMode("append")
    changes = _windowed(replay(spark, path), "1 hour")
    both = [
        lifecycle.start(raw, f"raw-{tag}", f"{base}/checkpoint-raw"),
        lifecycle.start(windows.changelog(changes, f"{base}/out", "two"), f"agg-{tag}", f"{base}/checkpoint-agg"),
    ]
    lifecycle.await_all(both)
    keys = ["sensor_type", "city"]
    rows = spark.read.schema(view.schema).parquet(f"{base}/raw").groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_rows"))
    counted = _window_table(spark, base, changes, "two").groupBy(*keys).agg(F.sum("message_count").alias("counted"))
    return rows.join(counted, keys, "full")


_FEATURES_SQL = """SELECT event_type, bucket, sample_no, round(CASE WHEN warm THEN velocity ELSE 0 END, 6) AS velocity,
              round(CASE WHEN warm THEN acceleration ELSE 0 END, 6) AS acceleration,
              round(CASE WHEN warm THEN rolling_mean ELSE 0 END, 6) AS rolling_mean,
              round(CASE WHEN warm THEN rolling_std ELSE 0 END, 6) AS rolling_std,
              round(CASE WHEN warm THEN burst_probability ELSE 0 END, 6) AS burst_probability
       FROM (SELECT *, sample_no >= 5 AS warm FROM features) f"""


def _features(spark, rates, base):
    with lifecycle.rocksdb(spark):
        out = stateful.feature_stream(rates, ["event_type"], "bucket", "workload_rate")
        writer = out.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
        _run(writer, "features", base)
    found = spark.read.schema(out.schema).parquet(f"{base}/out")
    return neutral(found.drop("hour_sin", "hour_cos"))


@query("stream_features", _FEATURES_SQL, views=("features",))
def stream_features(spark, folder):
    """Hourly rates replayed into the per-key state, in several deliveries."""
    base = run_dir(spark, "features")
    hourly = views.rate_hourly(prepare(spark), folder).select(
        "event_type", F.col("bucket").cast("timestamp").alias("bucket"), "workload_rate"
    )
    hourly.write.parquet(f"{base}/hourly")
    rates = spark.read.schema(hourly.schema).parquet(f"{base}/hourly")
    days = rates.agg(F.min("bucket"), F.max("bucket")).first()
    step = (days[1] - days[0]) / PARTS if days[0] else None
    for k in range(PARTS if step is not None else 0):
        low, high = days[0] + step * k, days[0] + step * (k + 1)
        part = rates.filter(F.col("bucket") >= low)
        append(part.filter(F.col("bucket") < high) if k + 1 < PARTS else part, f"{base}/rates", 1)
    stream = stream_files(
        spark, f"{base}/rates", "event_type string, bucket timestamp, workload_rate double", files_per_trigger=1
    )
    return _features(spark, stream, base)


_IDLE_SQL = """
WITH_RATES runs AS (
  SELECT event_type, bucket + INTERVAL 1 HOUR AS run_start, bucket AS bound FROM rate_hourly WHERE NOT workload_rate < 20
  UNION ALL SELECT event_type, min(bucket), NULL FROM rate_hourly GROUP BY event_type
), ended AS (
  SELECT event_type, run_start,
         coalesce(lead(bound) OVER (PARTITION BY event_type ORDER BY run_start, bound NULLS FIRST),
                  (SELECT max(bucket) FROM rate_hourly) + INTERVAL 3 DAY) AS run_end FROM runs
), counted AS (
  SELECT *, CAST(floor((epoch_us(run_end) - epoch_us(run_start)) / 7.2e9) AS BIGINT) AS times FROM ended
)
SELECT event_type, run_start, nth, run_start + INTERVAL 2 HOUR * nth AS fired_at
FROM (SELECT event_type, run_start, unnest(range(1, times + 1)) AS nth FROM counted WHERE times > 0) f"""


@query("stream_idle_timeouts", _IDLE_SQL.replace("WITH_RATES", "+"), views=("rate_hourly",))
def stream_idle_timeouts(spark, folder):
    """Every two idle hours of each type fire, also in the three days behind the last row, by timers alone."""
    base = run_dir(spark, "idle")
    hourly = views.rate_hourly(prepare(spark), folder).filter("bucket IS NOT NULL").select(
        "event_type", F.col("bucket").cast("timestamp").alias("bucket"), "workload_rate"
    )
    rates = stored(hourly, "idle_rates")
    half = rates.agg(F.timestamp_micros(((F.unix_micros(F.min("bucket")) + F.unix_micros(F.max("bucket"))) / 2).cast("bigint"))).first()[0]
    for part in (rates.filter(F.col("bucket") <= half), rates.filter(F.col("bucket") > half)):
        append(part, f"{base}/rates", 1)
    # A row of no type half an hour further on: what is due by then fires.
    ahead = rates.agg(F.max("bucket").alias("last")).filter("last IS NOT NULL")
    append(ahead.selectExpr("CAST(NULL AS STRING) AS event_type", "last + INTERVAL 3 DAYS 90 MINUTES AS bucket", "0D AS workload_rate"), f"{base}/rates", 1)
    stream = stream_files(spark, f"{base}/rates", "event_type string, bucket timestamp, workload_rate double", files_per_trigger=1)
    fired = idle.idle_timeouts(stream, "event_type", "bucket", "workload_rate", "1 hour", timeout=2, delay="1 hour")
    with lifecycle.rocksdb(spark):
        writer = fired.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
        _run(writer, "idle", base)
    return neutral(spark.read.schema(fired.schema).parquet(f"{base}/out").filter("event_type IS NOT NULL"))


@query("idle_timeouts", _IDLE_SQL.replace("WITH_RATES", "+"), views=("rate_hourly",))
def idle_timeouts(spark, folder):
    """The same from the table, up to three days behind its last hour."""
    rates = stored(views.rate_hourly(prepare(spark), folder).filter("bucket IS NOT NULL"), "idle_rates")
    last = rates.agg(F.max("bucket")).first()[0]
    until = F.lit(last).cast("timestamp") + F.expr("INTERVAL 3 DAYS")
    return neutral(series.idle_timeouts(rates, ["event_type"], "bucket", "workload_rate", until, "1 hour", timeout=2))


@query(
    "stream_feature_chain",
    f"""SELECT * FROM ({_FEATURES_SQL}) f WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    views=("features",),
)
def stream_feature_chain(spark, folder):
    """Windowed counts feed the per-key state inside one streaming query; open windows are held back."""
    base = run_dir(spark, "chain")
    rows = replay(spark, deliver(spark, folder, base))
    rates = windows.rate_windows(rows, ["event_type"], watermark="1 hour")
    return _features(spark, rates.withColumn("workload_rate", (F.col("n") - 1) * 45.0), base)


@query(
    "stream_edge_join",
    """SELECT event_id, patient_id, ts, heart_rate, CASE WHEN near THEN signal_ts END AS signal_ts,
              CASE WHEN near THEN predicted_load END AS predicted_load, CASE WHEN near THEN burst_alarm END AS burst_alarm
       FROM (SELECT v.event_id, v.patient_id, v.ts, v.heart_rate, s.ts AS signal_ts, s.predicted_load, s.burst_alarm,
                    s.ts >= v.ts - INTERVAL 24 HOUR AS near
             FROM vitals v ASOF LEFT JOIN signals s ON v.patient_id = s.patient_id AND v.ts >= s.ts) j""",
    views=("vitals", "signals"),
)
def stream_edge_join(spark, folder):
    """Stream-stream join over one day: every reading once, with its newest signal or none."""
    base = run_dir(spark, "edge")
    readings, signals = _beyond(spark, folder, deliver(spark, folder, base), "-1L")
    joined = joins.edge_interval_join(readings, signals, "patient_id", lookback="24 hours")
    return _joined(spark, joined, "edge", base, counted=False)


def _beyond(spark, folder, delivered, user="CAST(NULL AS BIGINT)"):
    """Readings and signals of a replay that ends with a row far ahead, which moves the watermark past all others."""
    last = views.events(spark, folder).agg(F.max("ts").alias("ts"))
    beyond = last.filter("ts IS NOT NULL").selectExpr(
        "-1L AS event_id", "ts + INTERVAL 30 DAYS AS ts", f"{user} AS user_id", "'signup' AS event_type", "0D AS value", "'{}' AS props"
    )
    append(beyond, delivered[0], 1)
    rows = replay(spark, delivered)
    return views.as_vitals(rows).select("event_id", "patient_id", "ts", "heart_rate"), views.as_signals(rows)


def _joined(spark, joined, name, base, counted=True):
    with lifecycle.rocksdb(spark, counted):
        writer = joined.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
        _run(writer, name, base)
    return neutral(spark.read.schema(joined.schema).parquet(f"{base}/out").filter("NOT (event_id = -1 AND coalesce(patient_id, 'PT--1') = 'PT--1')"))


@query(
    "stream_edge_join_repeats",
    """SELECT event_id, patient_id, ts, heart_rate, CASE WHEN near THEN signal_ts END AS signal_ts,
              CASE WHEN near THEN predicted_load END AS predicted_load, CASE WHEN near THEN burst_alarm END AS burst_alarm
       FROM (SELECT v.event_id, v.patient_id, v.ts, v.heart_rate, s.ts AS signal_ts, s.predicted_load, s.burst_alarm,
                    s.ts >= v.ts - INTERVAL 24 HOUR AS near
             FROM vitals v ASOF LEFT JOIN signals s ON v.patient_id = s.patient_id AND v.ts >= s.ts) j, range(2)""",
    views=("vitals", "signals"),
)
def stream_edge_join_repeats(spark, folder):
    """The same with every message delivered twice: every reading comes out as often as it came, by timers."""
    base = run_dir(spark, "edge_twice")
    readings, signals = _beyond(spark, folder, deliver(spark, folder, base, like=lambda rows: rows.unionAll(rows)))
    joined = joins.timed_edge_join(readings, signals, "patient_id", lookback="24 hours", salts=2)
    return _joined(spark, joined, "edge_twice", base)


_VALID = f"""coalesce({_IDENTITY}) IS NOT NULL AND ((j ->> '$.timestamp') IS NULL OR TRY_CAST(j ->> '$.timestamp' AS TIMESTAMP) IS NOT NULL)"""
_ROUTE_SQL = f"""
SELECT 'routed' AS sink, {_TARGET} AS topic, coalesce({_IDENTITY}) AS key, value, NULL AS error FROM probe WHERE j IS NOT NULL
UNION ALL SELECT 'validated', 'iot-validated-data', coalesce({_IDENTITY}), value, NULL FROM probe WHERE j IS NOT NULL AND {_VALID}
UNION ALL SELECT 'alerts', 'iot-alerts-critical', j ->> '$.machine_id', CAST(CAST(j ->> '$.sensors.temperature_celsius' AS DOUBLE) AS VARCHAR), NULL
          FROM probe WHERE CAST(j ->> '$.sensors.temperature_celsius' AS DOUBLE) > 80
UNION ALL SELECT 'dead', 'iot-dead-letter', key, value,
                 CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty payload' WHEN j IS NULL THEN 'malformed JSON'
                      WHEN coalesce({_IDENTITY}) IS NULL THEN 'no device identity' ELSE 'unreadable time' END
          FROM probe WHERE j IS NULL OR NOT ({_VALID})"""


def _routed(spark, folder, base):
    """All records of a replay of envelopes through the fan-out."""
    envelope = views.as_envelope(replay(spark, deliver(spark, folder, base)))
    config = SinkConfig(format="parquet", path=f"{base}/out")
    _run(lifecycle.each_batch(envelope, routing.fan_out(config, "route")), "route", base)
    return read_batches(spark, f"{base}/out", routing.RECORDS)


@query("stream_route", _ROUTE_SQL, views=("probe",))
def stream_route(spark, folder):
    """Envelopes fanned out to their sinks: every record with its topic, key and content."""
    records = _routed(spark, folder, run_dir(spark, "route")).filter("sink <> 'analytics'")
    dead = F.from_json("value", "original_data string, error string")
    alert = F.from_json("value", "celsius double")
    content = (
        F.when(F.col("sink") == "dead", dead["original_data"])
        .when(F.col("sink") == "alerts", alert["celsius"].cast("string"))
        .otherwise(F.col("value"))
    )
    error = F.when(F.col("sink") == "dead", dead["error"])
    return records.select("sink", "topic", "key", content.alias("value"), error.alias("error"))


@query(
    "stream_analytics",
    """SELECT 'iot-analytics-results' AS topic, topic AS source, count(*) AS messages,
              CAST(count(*) FILTER (WHERE j IS NULL) AS BIGINT) AS faulty FROM probe GROUP BY ALL""",
    views=("probe",),
)
def stream_analytics(spark, folder):
    """What the analytics sink was told, summed over the batches."""
    records = _routed(spark, folder, run_dir(spark, "analytics")).filter("sink = 'analytics'")
    told = F.from_json("value", "source string, messages bigint, faulty bigint").alias("v")
    return records.select("topic", told).groupBy("topic", "v.source").agg(
        F.sum("v.messages").alias("messages"), F.sum("v.faulty").alias("faulty")
    )


@query(
    "stream_vitals_alerts",
    f"""SELECT 'iot-alerts-critical' AS topic, patient_id AS key, event_id, ward, alerts
        FROM (SELECT event_id, patient_id, ward, {_labels_sql(45, 130, 88, True)} AS alerts FROM vitals) v WHERE alerts <> ''""",
    views=("vitals",),
)
def stream_vitals_alerts(spark, folder):
    """Vital signs out of their limits, streamed to the alert topic of a keyed log."""
    base = run_dir(spark, "vitals")
    rules = dimensions.RULES["strict"]
    rows = views.as_vitals(replay(spark, deliver(spark, folder, base)))
    labels = F.array_join(condition.alert_labels(rules, with_sepsis=True), "|")
    raised = rows.withColumn("alerts", labels).filter(condition.raised(rules) | condition.sepsis())
    alerts = messages.as_alert(raised, F.lit("critical"), F.col("ts"))
    fields = ("event_id", "patient_id", "ward", "alerts", "alert_priority", "alert_time")
    records = messages.as_records(alerts, F.col("target_topic"), F.col("patient_id"), *fields)
    _run(stream_records(records, SinkConfig(format="parquet", path=f"{base}/log")), "vitals", base)
    back = spark.read.schema("key string, value string, topic string").parquet(f"{base}/log")
    told = F.from_json("value", "event_id bigint, ward string, alerts string")
    return back.select("topic", "key", told.alias("v")).select("topic", "key", "v.*")


@query(
    "stream_log_read",
    """SELECT topic, partition, key, value, "timestamp" AS broker_ts, "offset" FROM envelope
       WHERE topic IN ('iot/smartcity/sensors', 'iot/healthcare/vitals')""",
    views=("envelope",),
)
def stream_log_read(spark, folder):
    """Two topics of a message log, streamed a few files at a time."""
    base = run_dir(spark, "log_read")
    path, files = deliver(spark, folder, base, to="log", like=views.as_envelope)
    source = SourceConfig(
        topic_pattern="iot/(smartcity|healthcare)/.*",
        format="parquet",
        path=path,
        schema=schemas.ENVELOPE.replace("timestamp timestamp", "timestamp timestamp_ntz"),
        max_files_per_trigger=files,
    )
    rows = messages.decode(stream_topics(spark, source))
    writer = rows.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    _run(writer, "log_read", base)
    return neutral(spark.read.schema(rows.schema).parquet(f"{base}/out"))


_SPANS_SQL = """spans AS (
  SELECT span, count(*) AS n FROM (
    SELECT coalesce(least({parts} - 1, CAST(floor((epoch_us(ts) - low) / greatest(1, round((high - low) / {parts}))) AS BIGINT)), 0) AS span
    FROM events, (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events) AS ends)
  GROUP BY span)"""


def _logged(spark, folder, name, parts):
    """The batch log of a replay in ``parts`` deliveries."""
    base = run_dir(spark, name)
    delivered = deliver(spark, folder, base, parts)
    with batch_log.logged(spark, f"{base}/log"):
        rows = replay(spark, delivered).select("event_id", "ts")
        done = _run(rows.writeStream.format("noop").outputMode("append"), name, base)
    return batch_log.progress_table(spark, f"{base}/log", str(done.id))


@query(
    "stream_batch_log",
    f"WITH {_SPANS_SQL.format(parts=12)} SELECT CAST(sum(n) AS BIGINT) AS message_count, count(*) AS batches FROM spans",
)
def stream_batch_log(spark, folder):
    """Rows and batches that the written log accounts for, over a replay of the whole table."""
    log = _logged(spark, folder, "log", 12).filter("message_count > 0")
    return log.agg(F.sum("message_count").alias("message_count"), F.count(F.lit(1)).alias("batches"))


def _measured(spark, folder, name, parts, fail_at=()):
    """The records of a replay that fails behind the write of some batches and is started again each time."""
    base, failing = run_dir(spark, name), list(fail_at)
    delivered = deliver(spark, folder, base, parts)

    def write(batch, batch_id):
        write_batch(batch.select("event_id", "ts"), f"{base}/out", name, batch_id)
        if batch_id in failing:
            failing.remove(batch_id)
            raise RuntimeError("stopped between the rows and their record")

    handle = batch_log.measured(write, f"{base}/log", name, last_ts=F.max("ts"))
    while True:
        try:
            _run(lifecycle.each_batch(replay(spark, delivered), handle), name, base)
            break
        except StreamingQueryException:
            if len(failing) == len(fail_at):
                raise
            fail_at = list(failing)
    return batch_log.measured_table(spark, f"{base}/log", name, "last_ts timestamp"), read_batches(spark, f"{base}/out", "event_id bigint, ts timestamp")


@query(
    "stream_measured_batches",
    f"""WITH {_SPANS_SQL.format(parts=PARTS)}
SELECT row_number() OVER (ORDER BY span) AS batch, n AS message_count, n AS written FROM spans""",
)
def stream_measured_batches(spark, folder):
    """Rows by the record of every batch, and rows written, though the replay broke off twice behind a write."""
    log, rows = _measured(spark, folder, "measured", PARTS, fail_at=(0, 2))
    written = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("written"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("batch_id")).cast("bigint")
    return log.join(written, "batch_id", "full").select(number.alias("batch"), "message_count", "written")


@query(
    "stream_episodes",
    f"""WITH {_SPANS_SQL.format(parts=6)}
SELECT CAST(e AS BIGINT) AS episode, CAST(2 AS BIGINT) AS steps, sum(1.0E0) AS total_cost,
       (SELECT CAST(sum(n) AS BIGINT) FROM spans) AS total_messages
FROM (SELECT (row_number() OVER (ORDER BY span) - 1) // 2 + 1 AS e FROM spans) GROUP BY e HAVING count(*) = 2""",
)
def stream_episodes(spark, folder):
    """Batches as episodes of two, and the messages that they account for, from the records written with them."""
    log = batch_log.as_batches(_measured(spark, folder, "episodes", 6)[0], executors=2)
    found = batches.episodes(log, ["query_id"], "batch_id", length=2)
    total = batches.cumulative(log, ["query_id"], "batch_id").groupBy("query_id").agg(
        F.max("total_messages").alias("total_messages")
    )
    return neutral(found.join(total, "query_id").select("episode", "steps", "total_cost", "total_messages"))
