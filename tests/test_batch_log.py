"""The engine's reports are all written, however long that takes."""

import time

from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.sources import tables
from sensorloom.sources.topics import stream_files
from sensorloom.streaming import batch_log, lifecycle


def test_slow_records_are_waited_for(spark, folder, tmp_path, monkeypatch):
    write, parts = batch_log.write_batch, 6

    def slowly(*args):
        time.sleep(3)  # all of them take longer than the ten seconds that the engine's bus is waited for by default
        write(*args)

    monkeypatch.setattr(batch_log, "write_batch", slowly)
    tables.table(spark, folder, "events").repartition(parts).write.parquet(f"{tmp_path}/in")
    rows = stream_files(spark, f"{tmp_path}/in", schemas.EVENTS, files_per_trigger=1).select("event_id")
    with batch_log.logged(spark, f"{tmp_path}/log"):
        query = lifecycle.run(rows.writeStream.format("noop").outputMode("append"), "slow", f"{tmp_path}/cp")
    log = batch_log.progress_table(spark, f"{tmp_path}/log", str(query.id)).filter("message_count > 0")
    assert log.agg(F.sum("message_count"), F.count(F.lit(1))).first()[:] == (1000, parts)


def test_a_query_that_still_runs_is_not_waited_for(spark, folder, tmp_path):
    tables.table(spark, folder, "events").repartition(2).write.parquet(f"{tmp_path}/in")
    rows = stream_files(spark, f"{tmp_path}/in", schemas.EVENTS, files_per_trigger=1).select("event_id")
    writer = rows.writeStream.format("noop").outputMode("append")
    with batch_log.logged(spark, f"{tmp_path}/log"):
        running = lifecycle.start(writer, "on", f"{tmp_path}/cp", every="1 second")
        running.processAllAvailable()
    assert running.isActive
    running.stop()
