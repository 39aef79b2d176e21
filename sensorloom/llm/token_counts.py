"""Token counts of whole texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import CHUNK, OVERLAP, count, encoder
from .stores import over_rows


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``.

    The tokens are those that the library of the file at ``path`` gives for the whole text,
    without begin, end or added special tokens; special strings inside a text count as its
    library handles them. Texts longer than ``chunk`` characters are encoded in overlapping chunks.
    Null texts count as empty. Repeated rows and null ids stay; extra columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = encoder(path)
        counts = pa.array([count(tool, t, chunk, overlap) for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
    )
    counted = narrow.mapInArrow(over_rows(work), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
