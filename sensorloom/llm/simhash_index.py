"""SimHash near-duplicates by multi-index hashing of the fingerprints.

Main path: the 64 bits are cut into two segments of 32. Fingerprints at distance two or less
differ by at most one bit in one of the segments, so each looks up its own segment value and
the values with one of its set bits cleared (the other of the pair has the bit set), fetches
the table entries under these values and keeps the pairs whose complete distance fits.

Tables entries that very many fingerprints share are not paired. All fingerprints that touch
one are linked through midpoints instead: two fingerprints are at distance two or less exactly
when one value lies within one bit of both, so each lists its 65 neighbours, and those that
share a neighbour link to the smallest among them. These links are true links, at most 65 rows
each, and none is missed; nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import components, over_rows, store

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
WORDS = 3
BLOCK = 1 << 15
CROWD = 64


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(values, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles of a whole text; zero without words.

    A-Z are lower-cased, words are runs of anything but space and U+0009 to U+000D, repeated
    shingles count again, and fewer words than a shingle holds form one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    width = min(words, len(parts))
    total, counts = len(parts) - width + 1, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, BLOCK):
        high = min(total, low + BLOCK)
        spans = zip(starts[low:high], ends[low + width - 1 : high + width - 1])
        counts += _bit_counts([digest(joined[s:e], SEED) for s, e in spans])
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of features given by their 64-bit hashes; zero without any."""
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), BLOCK):
        counts += _bit_counts(hashes[low : low + BLOCK])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, bits): one row per row of ``docs``, the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(bits.view(np.int64))], ["doc_id", "bits"]
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(over_rows(work), "doc_id long, bits long")


def links(values: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints at distance two or less.

    ``values`` holds distinct fingerprints in the column bits. Every link is true; where a table
    entry holds more than ``crowd`` fingerprints the links form stars instead of all pairs.
    """
    segments = F.explode(
        F.array(
            F.struct(F.lit(0).alias("seg"), F.col("bits").bitwiseAND(0xFFFFFFFF).alias("part")),
            F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("bits", 32).alias("part")),
        )
    ).alias("at")
    entries = values.select("bits", segments).select("bits", "at.*")
    ball = F.concat(
        F.array("part"),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("part").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0),
            lambda i: F.expr("part").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        ),
    )
    probes = entries.select(F.col("bits").alias("probe"), "seg", F.explode(ball).alias("part"))
    crowded = entries.groupBy("seg", "part").count().where(F.col("count") > crowd).select("seg", "part")
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("bits"))) <= 2
    pairs = (
        probes.join(entries.join(crowded, ["seg", "part"], "left_anti"), ["seg", "part"])
        .where(near & (F.col("probe") != F.col("bits")))
        .select(F.col("probe").alias("a"), F.col("bits").alias("b"))
    )
    # What a crowded entry may link: its members, and those that would have looked it up.
    touching = probes.join(crowded, ["seg", "part"], "left_semi").select(F.col("probe").alias("bits")).distinct()
    one = F.lit(1).cast("long")
    neighbours = F.explode(
        F.concat(
            F.array("bits"),
            F.transform(
                F.sequence(F.lit(0), F.lit(63)),
                lambda i: F.expr("bits").bitwiseXOR(F.call_function("shiftleft", one, i)),
            ),
        )
    ).alias("middle")
    middles = touching.select("bits", neighbours)
    hubs = middles.groupBy("middle").agg(F.min("bits").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = middles.join(hubs, "middle").where("bits <> hub").select(F.col("bits").alias("a"), F.col("hub").alias("b"))
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Documents link when their fingerprints differ in at most two bits; component_id is the
    smallest doc_id reachable over links, itself included. Null and empty texts have
    fingerprint zero and link like any other. Rows with equal doc_id stay separate rows. A null
    doc_id is never the smallest; a component of such rows only has a null component_id. An
    empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    marked = store(fingerprints(docs, id_col, text_col, words), "fingerprints")
    values = store(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "values")
    joined = components(spark, links(values.select("bits")))
    rooted = values.join(joined.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = store(rooted.join(smallest, "root").select("bits", "component_id"), "classes")
    return marked.join(classes, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the smallest doc_id stays.

    Rows that repeat a doc_id count as copies, of which one stays. Rows without doc_id can't be
    told apart by name and all stay.
    """
    return smallest_stay(docs, near_duplicates(docs, id_col, text_col, words), id_col)


def smallest_stay(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, given (doc_id, component_id).

    Of rows that share the id the one whose columns hash lowest stays, in every run the same. Rows
    without an id all stay; an empty table stays empty.
    """
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.join(stay, docs[id_col] == F.col("_stay"), "left_semi").groupBy(F.col(id_col).alias("_stay"))
    named = named.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return named.union(docs.where(F.col(id_col).isNull()))
