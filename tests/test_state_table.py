"""State read as a table equals what arrived, batch by batch and after a restart."""

import uuid

from pyspark.sql import functions as F

from sensorloom.streaming import lifecycle, state


def run(spark, base, name):
    rows = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    totals = state.running_totals(rows, ["k"], n=F.count(F.lit(1)), total=F.sum("v"))
    return lifecycle.run(totals.writeStream.format("noop").outputMode("update"), name, f"{base}/checkpoint")


def add(spark, base, rows):
    spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(f"{base}/in")


def held(spark, base, batch=None):
    return sorted(map(tuple, state.state_table(spark, f"{base}/checkpoint", batch).collect()))


def test_totals_go_on_after_a_restart(spark, tmp_path):
    base, name = str(tmp_path), f"totals-{uuid.uuid4().hex[:8]}"
    add(spark, base, [("a", 1), ("a", 2), ("b", 5)])
    run(spark, base, name)
    assert held(spark, base) == [("a", 2, 3), ("b", 1, 5)]
    add(spark, base, [("a", 10), ("c", 7)])
    run(spark, base, name)
    assert held(spark, base) == [("a", 3, 13), ("b", 1, 5), ("c", 1, 7)]
    assert held(spark, base, batch=0) == [("a", 2, 3), ("b", 1, 5)]
    kept = state.batches_kept(spark, f"{base}/checkpoint").collect()
    assert [(r.operatorName, r.first, r.last) for r in kept] == [("stateStoreSave", 0, 1)]
