"""What the sinks wrote, read back and compared with what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import message
from ..operators import lookups, messages
from ..session import run_dir
from ..sinks import files
from ..sinks.topics import SinkConfig, write_records
from ..sources import views
from ..sources.tables import table
from ..sources.topics import SourceConfig, read_topics
from .messages import _IDENTITY, _TARGET
from .registry import ORACLE, QUERIES, query
from .shape import neutral

LOG = schemas.ENVELOPE.replace("timestamp timestamp", "timestamp timestamp_ntz")


@query(
    "sink_round_trip",
    f"""SELECT {_TARGET} AS topic, coalesce({_IDENTITY}) AS key, value FROM probe WHERE j IS NOT NULL""",
    views=("probe",),
)
def sink_round_trip(spark, folder):
    """Routed records written to a keyed log and read back from it."""
    base = run_dir(spark, "records")
    good, _ = messages.split_faulty(messages.probe(messages.decode(views.envelope(spark, folder))))
    routed = lookups.route(good).select(
        F.col("target_topic").alias("topic"), message.device_ref("m.").alias("key"), "value"
    )
    write_records(routed, SinkConfig(format="parquet", path=base))
    log = read_topics(spark, SourceConfig(format="parquet", path=base, schema="key string, value string, topic string"))
    return log.select("topic", "key", "value")


@query(
    "log_round_trip",
    """SELECT topic, partition, key, value, "timestamp" AS broker_ts, "offset" FROM envelope
       WHERE topic IN ('iot/industrial/machines', 'iot/other/raw')""",
    views=("envelope",),
)
def log_round_trip(spark, folder):
    """A bounded read of two named topics of a message log."""
    base = run_dir(spark, "log")
    views.envelope(spark, folder).write.parquet(base)
    source = SourceConfig(topics=["iot/industrial/machines", "iot/other/raw"], format="parquet", path=base, schema=LOG)
    return neutral(messages.decode(read_topics(spark, source)))


@query(
    "archive_round_trip",
    """SELECT tier, codec, count(*) AS rows FROM (
         SELECT tier, CASE tier WHEN 'HOT' THEN 'uncompressed' WHEN 'WARM' THEN 'lz4' ELSE 'zstd' END AS codec
         FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'HOT' WHEN 1 THEN 'WARM' WHEN 2 THEN 'COLD' ELSE 'ARCHIVE' END AS tier FROM lineitem) t) c
       GROUP BY ALL""",
)
def archive_round_trip(spark, folder):
    """Rows archived by tier, counted per tier and codec after reading back."""
    base = run_dir(spark, "archive")
    slot = F.col("l_linenumber") % 4
    tier = F.when(slot == 0, "HOT").when(slot == 1, "WARM").when(slot == 2, "COLD").otherwise("ARCHIVE")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", tier.alias("tier"))
    files.write_tiered(rows, base)
    back = spark.read.parquet(base)
    return back.groupBy("tier", "codec").agg(F.count(F.lit(1)).alias("rows"))


@query("csv_round_trip", ORACLE["summary_stats"])
def csv_round_trip(spark, folder):
    """A report as CSV with a header, read back."""
    report, base = QUERIES["summary_stats"](spark, folder), run_dir(spark, "csv")
    files.csv_report(report, base)
    return spark.read.schema(report.schema).csv(base, header=True)


@query("json_round_trip", ORACLE["scorecard"])
def json_round_trip(spark, folder):
    """A nested report as JSON, one object per scenario, read back as rows."""
    report, base = QUERIES["scorecard"](spark, folder), run_dir(spark, "json")
    files.json_report(report, base, "scenario")
    rest = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in report.schema.fields if f.name != "scenario")
    nested = spark.read.schema(f"scenario string, policies array<struct<{rest}>>").json(base)
    return nested.select("scenario", F.inline("policies")).select(*report.columns)
