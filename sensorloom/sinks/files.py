"""Batch folders, reports and the tiered archive."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dimensions import CODECS, TIERS
from ..session import run_dir


def write_batch(df: DataFrame, base: str, query_id: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder. A retried batch overwrites itself, so it counts once."""
    df.write.mode("overwrite").parquet(f"{base}/query_id={query_id}/batch_id={batch_id}")


def read_batches(spark: SparkSession, base: str, schema: str | None = None) -> DataFrame:
    """All batches under ``base`` with ``query_id`` and ``batch_id`` as columns.

    With a schema, a folder that no batch was written to is an empty table.
    """
    reader = spark.read.option("basePath", base)
    if not schema:
        return reader.parquet(base)
    full = f"{schema}, query_id string, batch_id bigint"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return reader.schema(full).parquet(base)


def _at(spark: SparkSession, path: str):
    """The path, and the file system that it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_below(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if it is not there."""
    where, system = _at(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole, by a rename; False if the path is taken."""
    where, system = _at(spark, path)
    draft, _ = _at(spark, f"{where.getParent()}/.{where.getName()}-{uuid.uuid4().hex}")
    stream = system.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.exists(where) and system.rename(draft, where):
        return True
    system.delete(draft, False)
    return False


def remove(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read from there, so that it is the same wherever it is used."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_report(report: DataFrame, path: str, files: int = 1) -> None:
    """A report of a few aggregated rows as one CSV with a header. Not for data-sized results."""
    report.coalesce(files).write.mode("overwrite").csv(path, header=True)


def json_report(report: DataFrame, path: str, group: str, name: str = "policies", files: int = 1) -> None:
    """A nested JSON report: one object per ``group`` holding its rows as an array."""
    rest = [c for c in report.columns if c != group]
    nested = report.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    nested.coalesce(files).write.mode("overwrite").json(path)


# Tier label to codec id; colder data is packed harder.
CODEC_OF_TIER = {"HOT": 0, "WARM": 1, "COLD": 2, "ARCHIVE": 2}


def write_tiered(df: DataFrame, base: str, tier: str = "tier") -> dict[str, str]:
    """Archive rows by tier, each codec in its own Parquet folder, partitioned by tier.

    A codec is a setting of a write, so there is one write per codec; the rows are kept on executor
    disk meanwhile, so that the source is read once.
    """
    written = {}
    labels = [t[2] for t in TIERS]
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        for codec_id, codec, *_ in CODECS:
            chosen = [t for t in labels if CODEC_OF_TIER[t] == codec_id]
            path = f"{base}/codec={codec}"
            part = kept.filter(F.col(tier).isin(*chosen))
            part.write.mode("overwrite").option("compression", codec).partitionBy(tier).parquet(path)
            written[codec] = path
    finally:
        kept.unpersist()
    return written
