"""The join by timers wakes a group of keys once for all that is due."""

from test_timed_join import READING, SIGNAL, after, beyond, frame, plain

from sensorloom.streaming import joins, lifecycle


def test_timers_do_not_grow_with_the_readings(spark, tmp_path):
    readings = [(i, f"k{i % 3}", after(7 * i), float(i)) for i in range(200)]
    signals = [(f"k{i % 3}", after(50 * i), float(i), i % 2 == 0) for i in range(20)]
    for rows in ((readings, signals), beyond(2)):
        for side, part, schema in zip("rs", rows, (READING, SIGNAL)):
            frame(spark, part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}")
    r, s = (spark.readStream.schema(schema).parquet(f"{tmp_path}/{side}") for side, schema in (("r", READING), ("s", SIGNAL)))
    joined = joins.timed_edge_join(r, s, "k", lookback="10 minutes", salts=1)
    with lifecycle.rocksdb(spark):
        writer = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
        done = lifecycle.run(writer, "groups", f"{tmp_path}/checkpoint")
    got = sorted((tuple(r) for r in spark.read.schema(joined.schema).parquet(f"{tmp_path}/out").collect()), key=str)
    far = beyond(2)[0]
    assert got == plain(readings + far, signals, 10)
    timers = sum(o.customMetrics["numRegisteredTimers"] for p in done.recentProgress for o in p.stateOperators)
    assert 3 <= timers <= 20
