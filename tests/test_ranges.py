"""Offset ranges: what is read, what is missing, what the log connector is told."""

import json

import pytest

from sensorloom.schemas import ENVELOPE
from sensorloom.sources.ranges import MissingOffsets, OffsetRange, losses, offsets_json, read_ranges, within
from sensorloom.sources.topics import SourceConfig


def log(spark, path, offsets):
    rows = [(topic, part, None, f"{topic}{part}{o}", None, o) for (topic, part), found in offsets.items() for o in found]
    spark.createDataFrame(rows, ENVELOPE).write.parquet(str(path))
    return SourceConfig(format="parquet", path=str(path))


WHOLE = {("a", 0): range(100), ("a", 1): range(40_000, 110_000), ("b", 0): range(10)}


def test_ranges_are_read_and_nothing_else(spark, tmp_path):
    config = log(spark, tmp_path / "log", WHOLE)
    ranges = [OffsetRange("a", 0, 5, 20), OffsetRange("a", 1, 50_000, 100_001), OffsetRange("b", 0, 3, 3)]
    rows = read_ranges(spark, config, ranges)
    got = {(r.topic, r.partition): r.n for r in rows.groupBy("topic", "partition").count().withColumnRenamed("count", "n").collect()}
    assert got == {("a", 0): 15, ("a", 1): 50_001}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(offset,5)" in plan and "LessThan(offset,100001)" in plan and "Or(" in plan


def test_a_missing_offset_raises(spark, tmp_path):
    gone = {key: [o for o in found if (key, o) not in {(("a", 1), 65_536), (("b", 0), 0)}] for key, found in WHOLE.items()}
    config = log(spark, tmp_path / "log", gone)
    good, bad = OffsetRange("a", 1, 65_537, 70_000), OffsetRange("a", 1, 65_000, 70_000)
    assert read_ranges(spark, config, [good, OffsetRange("b", 0, 1, 10)]).count() == 4463 + 9
    with pytest.raises(MissingOffsets, match="a/1: 1 of 5000$"):
        read_ranges(spark, config, [bad, OffsetRange("a", 0, 0, 100)])
    with pytest.raises(MissingOffsets, match="b/0: 1 of 10"):
        read_ranges(spark, config, [OffsetRange("b", 0, 0, 10)])
    assert read_ranges(spark, config, [bad], on_loss="ignore").count() == 4999


def test_losses_name_every_range(spark, tmp_path):
    rows = spark.read.parquet(log(spark, tmp_path / "log", WHOLE | {("c", 3): [7, 7, 7, 9]}).path)
    ranges = [OffsetRange("a", 0, 90, 110), OffsetRange("c", 3, 5, 10), OffsetRange("d", 0, 0, 4), OffsetRange("b", 0, 2, 2)]
    got = sorted(map(tuple, losses(rows, ranges).collect()))
    assert got == [("a", 0, 20, 10, 10), ("b", 0, 0, 0, 0), ("c", 3, 5, 2, 3), ("d", 0, 4, 0, 4)]
    assert rows.filter(within([OffsetRange("a", 0, 4, 4)])).count() == 0


def test_what_the_connector_is_told():
    ranges = [OffsetRange("a", 0, 5, 20), OffsetRange("a", 1, 7, 9), OffsetRange("b", 0, 0, 3)]
    assert json.loads(offsets_json(ranges, end=False)) == {"a": {"0": 5, "1": 7}, "b": {"0": 0}}
    assert json.loads(offsets_json(ranges, end=True)) == {"a": {"0": 20, "1": 9}, "b": {"0": 3}}
    with pytest.raises(ValueError):
        offsets_json([OffsetRange("a", 0, 0, 1), OffsetRange("a", 0, 5, 6)], end=True)
    with pytest.raises(ValueError):
        OffsetRange("a", 0, 5, 4)
