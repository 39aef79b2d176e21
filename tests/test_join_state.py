"""The state settings of stream joins, inside and behind the block that sets them."""

from sensorloom.streaming import lifecycle

FORMAT = "spark.sql.streaming.join.stateFormatVersion"
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


def test_a_join_keeps_one_store_a_partition(spark):
    before = {name: spark.conf.get(name, None) for name in (FORMAT, COUNTED)}
    with lifecycle.rocksdb(spark):
        assert (spark.conf.get(FORMAT), spark.conf.get(COUNTED)) == ("3", "true")
    with lifecycle.rocksdb(spark, counted=False):
        assert (spark.conf.get(FORMAT), spark.conf.get(COUNTED)) == ("3", "false")
    assert {name: spark.conf.get(name, None) for name in before} == before
