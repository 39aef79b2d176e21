"""The changelog behind a manifest, and figures written with their batch."""

import pytest
from pyspark.sql import functions as F

from sensorloom.sinks.files import names_below, read_batches, write_batch, write_text_once
from sensorloom.streaming import batch_log, windows

SCHEMA = "k int, v int"


def change(spark, base, batch, rows, query="q"):
    write_batch(spark.createDataFrame(rows, SCHEMA), base, query, batch)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def log(spark, tmp_path):
    return windows.CompactedLog(spark, str(tmp_path / "log"), ["k"], "q", SCHEMA)


def test_readers_see_the_same_rows_through_two_compactions(spark, log):
    assert rows(log.current()) == [] and log.compact() == 0
    change(spark, log.base, 0, [(1, 10), (2, 20)])
    change(spark, log.base, 1, [(2, 21), (3, 30)])
    change(spark, log.base, 1, [(2, 99)], query="other")
    assert log.compact() == 1
    change(spark, log.base, 2, [(1, 12)])
    open_reader = log.current()
    assert log.compact() == 2
    change(spark, log.base, 3, [(4, 40), (2, 23)])
    assert rows(open_reader) == [(1, 12), (2, 21), (3, 30)]
    assert rows(log.current()) == [(1, 12), (2, 23), (3, 30), (4, 40)]
    assert log.compact() == 3 and log.compact() == 3
    assert rows(log.current()) == [(1, 12), (2, 23), (3, 30), (4, 40)]


def test_scans_are_bounded_by_snapshot_and_newer_batches(spark, log):
    for batch in range(12):
        change(spark, log.base, batch, [(batch % 3, batch)])
    before = len(log.current().inputFiles())
    log.compact()
    change(spark, log.base, 12, [(0, 12)])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = log.current()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "batch_id#" in text and "> 11" in text  # older batches are no partitions of the scan
    read = spark.read.schema(f"{SCHEMA}, batch_id bigint").parquet(log.version()[2])
    assert before >= 12 and read.count() == 3
    assert rows(log.current()) == [(0, 12), (1, 10), (2, 11)]


def test_a_failed_compaction_changes_nothing(spark, log, monkeypatch):
    change(spark, log.base, 0, [(1, 10)])
    log.compact()
    change(spark, log.base, 1, [(1, 11)])
    monkeypatch.setattr(windows, "write_text_once", lambda *a: False)
    with pytest.raises(RuntimeError):
        log.compact()
    assert log.version()[0] == 1 and rows(log.current()) == [(1, 11)]


def test_expired_versions_and_batches_go(spark, log):
    for batch in range(4):
        change(spark, log.base, batch, [(batch, batch)])
        log.compact()
    log.expire(keep=2)
    assert names_below(spark, log.versions) == ["3", "4"]
    assert names_below(spark, f"{log.base}/query_id=q") == ["batch_id=3"]
    assert rows(log.current()) == [(b, b) for b in range(4)]
    log.expire(keep=1)
    assert rows(log.current()) == [(b, b) for b in range(4)]


def test_a_file_appears_once(spark, tmp_path):
    path = f"{tmp_path}/m/1"
    assert write_text_once(spark, path, "a") and not write_text_once(spark, path, "b")
    assert names_below(spark, f"{tmp_path}/m") == ["1"]


def test_figures_are_written_with_the_batch(spark, tmp_path):
    out, log = f"{tmp_path}/out", f"{tmp_path}/log"
    write = lambda df, i: write_batch(df, out, "q", i)
    handle = batch_log.measured(write, log, "q", top=F.max("v"), none=F.max(F.lit(None).cast("string")))
    batch = spark.createDataFrame([(1, 5), (2, 7)], SCHEMA)
    for _ in range(2):  # a batch that comes again replaces its record
        handle(batch, 0)
    handle(batch.filter("v > 5"), 1)
    table = batch_log.measured_table(spark, log, "q", "top int, none string").orderBy("batch_id").collect()
    assert [(r.batch_id, r.message_count, r.top, r.none) for r in table] == [(0, 2, 7, None), (1, 1, 7, None)]
    assert all(r.elapsed_ms >= 0 and r.throughput > 0 and r.finished_at for r in table)
    assert read_batches(spark, out, SCHEMA).count() == 3


def test_a_failed_write_leaves_no_record(spark, tmp_path):
    def write(df, i):
        raise RuntimeError("no space")

    with pytest.raises(RuntimeError):
        batch_log.measured(write, f"{tmp_path}/log", "q")(spark.createDataFrame([(1, 5)], SCHEMA), 0)
    assert batch_log.measured_table(spark, f"{tmp_path}/log").count() == 0
