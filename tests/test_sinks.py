"""Sources, sinks and their options."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sensorloom import dimensions, schemas
from sensorloom.operators import messages
from sensorloom.plans.catalog import QUERIES
from sensorloom.sinks import files, topics as out
from sensorloom.sources import topics as source
from sensorloom.sources import views


def test_log_source_options():
    config = source.SourceConfig(topics=["a", "b"], brokers="h:1", max_offsets_per_trigger=10)
    assert source.source_options(config) == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "a,b",
        "failOnDataLoss": "false",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "10",
    }
    bounded = source.source_options(config, streaming=False)
    assert (bounded["startingOffsets"], bounded["endingOffsets"]) == ("earliest", "latest")
    with pytest.raises(ValueError, match="latest"):
        source.source_options(source.SourceConfig(topics=["a"], first_offsets="latest"), streaming=False)
    pattern = source.source_options(source.SourceConfig(topic_pattern="iot-.*-raw"))
    assert pattern["subscribePattern"] == "iot-.*-raw" and "subscribe" not in pattern
    capped = source.SourceConfig(format="parquet", max_files_per_trigger=2)
    assert source.source_options(capped) == {"maxFilesPerTrigger": "2"}


def test_bounded_read_of_file_log(spark, folder, tmp_path):
    views.envelope(spark, folder).write.parquet(f"{tmp_path}/log")
    ntz = schemas.ENVELOPE.replace("timestamp timestamp", "timestamp timestamp_ntz")
    config = source.SourceConfig(
        format="parquet", path=f"{tmp_path}/log", schema=ntz, topic_pattern="iot/(smartcity|healthcare)/.*"
    )
    got = {r[0] for r in source.read_topics(spark, config).select("topic").distinct().collect()}
    assert got == {"iot/smartcity/sensors", "iot/healthcare/vitals"}


def test_log_sink_options():
    got = out.sink_options(out.SinkConfig(brokers="h:1"))
    assert got == {
        "kafka.bootstrap.servers": "h:1",
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        "kafka.compression.type": "gzip",
    }


def test_records_round_trip(spark, folder, tmp_path):
    rows = views.vitals(spark, folder).select("event_id", "patient_id", "heart_rate")
    records = messages.as_records(rows, F.lit("t"), F.col("patient_id"), *rows.columns)
    out.write_records(records, out.SinkConfig(format="parquet", path=f"{tmp_path}/log"))
    back = spark.read.parquet(f"{tmp_path}/log")
    parsed = back.select(F.from_json("value", "event_id bigint, patient_id string, heart_rate double").alias("v"))
    assert sorted(parsed.select("v.*").collect()) == sorted(rows.collect())
    with pytest.raises(ValueError, match="topic"):
        out.write_records(rows, out.SinkConfig(format="parquet", path=f"{tmp_path}/no"))


def test_csv_report(spark, folder, tmp_path):
    report = QUERIES["summary_stats"](spark, folder)
    files.csv_report(report, f"{tmp_path}/csv")
    written = list(Path(tmp_path, "csv").glob("*.csv"))
    lines = written[0].read_text().splitlines()
    assert len(written) == 1 and lines[0] == "policy,metric,mean,std,min,max" and len(lines) == 10


def test_json_report_is_nested(spark, folder, tmp_path):
    files.json_report(QUERIES["scorecard"](spark, folder), f"{tmp_path}/json", "scenario")
    text = "".join(p.read_text() for p in Path(tmp_path, "json").glob("*.json"))
    objects = [json.loads(line) for line in text.splitlines()]
    assert {o["scenario"] for o in objects} == {"O", "F"}
    assert all(len(o["policies"]) == 3 and "efficiency" in o["policies"][0] for o in objects)


def test_tiered_archive(spark, folder, tmp_path):
    rows = QUERIES["tier_label"](spark, folder)
    paths = files.write_tiered(rows, f"{tmp_path}/archive")
    counts = {c: spark.read.parquet(p).count() for c, p in paths.items() if any(Path(p).rglob("*.parquet"))}
    assert sum(counts.values()) == rows.count()
    packed = [p.name for p in Path(paths["zstd"]).rglob("*.parquet")]
    assert packed and all(".zstd." in n for n in packed)
    assert {p.name for p in Path(paths["zstd"]).glob("tier=*")} == {"tier=COLD"}


def test_batch_folder_is_overwritten(spark, tmp_path):
    for rows in (5, 3):
        files.write_batch(spark.range(rows), f"{tmp_path}/b", "q", 7)
    got = files.read_batches(spark, f"{tmp_path}/b", "id bigint")
    assert got.count() == 3 and got.first()["batch_id"] == 7


def test_folder_without_batches_is_an_empty_table(spark, tmp_path):
    got = files.read_batches(spark, f"{tmp_path}/none", "id bigint")
    assert got.count() == 0 and got.columns == ["id", "query_id", "batch_id"]


FAULTY = {
    "": "empty payload",
    "   ": "empty payload",
    None: "empty payload",
    '{"sensor_id":"a"} junk': "malformed JSON",
    '{"sensor_id":"a"}]': "malformed JSON",
    '{"sensor_id":"a"},{"sensor_id":"b"}': "malformed JSON",
    "{'sensor_id':'q'}": "malformed JSON",
    "{bad": "malformed JSON",
    "[1]": "malformed JSON",
    "5": "malformed JSON",
    '{"sensor_id":"a"}': None,
    ' {"sensor_id":"b"} ': None,
    '{"note":"x"}': None,
    '{"sensor_id":"a"},{"_mark":true}': "malformed JSON",
    '{"sensor_id":"a","sensor_id":"b"}': "malformed JSON",
    '{"value":NaN}': "malformed JSON",
    '\t\n{"sensor_id":"c"}\n': None,
}


def test_every_fault_has_its_cause(spark):
    rows = spark.createDataFrame([(v,) for v in FAULTY], "value string")
    probed = messages.probe(rows).withColumn("error", messages.fault())
    assert {r["value"]: r["error"] for r in probed.collect()} == FAULTY
    good, bad = messages.split_faulty(probed)
    assert (good.count(), bad.count()) == (4, 13)


def test_validation_names_what_is_wrong(spark):
    texts = {
        '{"sensor_id":"a"}': None,
        '{"note":"x"}': "no device identity",
        '{"sensor_id":"a","timestamp":"yesterday"}': "unreadable time",
        '{"machine_id":"m","timestamp":"2024-01-01T00:00:00"}': None,
    }
    rows = spark.createDataFrame([(v,) for v in texts], "value string")
    found = messages.probe(rows).withColumn("error", messages.invalid()).collect()
    assert {r["value"]: r["error"] for r in found} == texts


def test_typed_reads_of_a_payload(spark):
    text = '{"n":5,"x":1.5,"s":"7","deep":{"b":true,"n":12},"none":null,"list":[1]}'
    rows = messages.opened(spark.createDataFrame([(text,), (text + text,)], "value string"))
    reads = [("n", "int"), ("x", "int"), ("s", "int"), ("x", "double"), ("n", "string"), ("deep.b", "boolean"), ("deep.n", "bigint"), ("none", "string"), ("gone", "int"), ("list", "int")]
    got = rows.select(*[messages.read(path, kind).alias(f"c{i}") for i, (path, kind) in enumerate(reads)]).collect()
    assert tuple(got[0]) == (5, None, 7, 1.5, "5", True, 12, None, None, None)
    assert tuple(got[1]) == (None,) * len(reads)


def test_every_message_kind_parses(spark):
    samples = {
        schemas.ECG: ('{"ecg_data":{"waveform":[0.1,0.2],"lead":"Lead_II"}}', "ecg_data.waveform"),
        schemas.PRODUCTION: ('{"production":{"quality_score":98.5}}', "production.quality_score"),
        schemas.VITAL_SIGNS: ('{"vitals":{"blood_pressure":{"systolic":120}}}', "vitals.blood_pressure.systolic"),
        schemas.MACHINE: ('{"status":{"operational":true}}', "status.operational"),
        schemas.FLAT_READING: ('{"sensor_id":"s","value":1.5}', "value"),
        schemas.WARD_READING: ('{"ward":"ICU","spo2":97.0}', "spo2"),
        schemas.TRAFFIC_SAMPLE: ('{"timestamp":1.5,"workload_rate":20}', "workload_rate"),
    }
    for schema, (text, path) in samples.items():
        df = spark.createDataFrame([(text,)], "value string")
        assert messages.parse(df, schema).select(f"data.{path}").first()[0] is not None


def test_dimensions_are_tiny(spark):
    for dim in (dimensions.scenarios, dimensions.topic_map, dimensions.topic_policy, dimensions.tiers, dimensions.codecs):
        assert dim(spark).count() <= 10
