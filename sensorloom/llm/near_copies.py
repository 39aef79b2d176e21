"""Near-copies by SimHash, checked by exact Jaccard similarity of five-word shingles, completed by prefix filtering.

Sets whose SimHash fingerprints lie within two bits are paired by the index of ``simhash_index``, and each pair is
verified on the complete sets. Two bits reach only part of the similar sets; prefix filtering finds all others.

Order all shingles in any fixed way. Of two sets with similarity t or more, each has one of the
other's among its first n - ceil(t n) + 1, so the documents are paired over these alone and no
link is lost. Shingles that are common in a share of the texts come last in the order, so that a passage many
documents quote pairs none of them. If the first shingle that two sets share stands at places i and j of theirs,
they share at most min(m - i, n - j): pairs that this, their sizes or their parities rule out go, the others
are verified on their complete sets.

The sets that meet over a shingle are verified against the most typical of them first, the one whose
shingles are the most common: copies with edits of their own are far from each other but near the text they
come from. Only sets that this leaves outside that one's component are verified against every
other set of the shingle. Nothing is capped, and pairs grow with the square only where many sets share a
rare shingle early without being near-copies.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_index, text_hash
from .stores import components, over_rows, store

WORDS = 5
# Similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
# The order of shingles is taken from one text in so many, at least from a sample of this size; of what is common there
# the most frequent ones are told to every task. A fixed sample would miss ever larger groups as the corpus grows.
SHARE = 8
SAMPLE = 4_000
MOST = 1_000_000
FILTER_BITS = 1 << 25


def plain(text: str | None) -> bytes:
    """Words are what white space parts; case does not count."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; fewer words than a shingle holds form one."""
    hashes, first = text_hash.words(texts, plain)
    runs, owner = text_hash.shingles(hashes, first, words)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        n = first[k + 1] - first[k]
        if 0 < n < words:
            short, _ = text_hash.shingles(hashes[first[k] : first[k + 1]], np.array([0, n]), int(n))
            out.append(text_hash.mixed(short + np.uint64(n)))
        else:
            out.append(np.unique(runs[bounds[k] : bounds[k + 1]]))
    return out


def node(found: np.ndarray) -> int:
    """What names a set."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The shingles over which a set must be paired: rare ones first, then by hash."""
    n = len(found)
    keep = n - -(-least[0] * n // least[1]) + 1
    if not n or not len(common):
        return found[:keep]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.lexsort((found, np.where(common[at] == found, counts[at], 0)))[:keep]]


def typical(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> int:
    """How common the shingles of a set are on average, in thousandths."""
    if not len(found) or not len(common):
        return 0
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return int(np.where(common[at] == found, counts[at], 0).sum() * 1000 // len(found))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def common_shingles(texts: DataFrame, words: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sets of a hash-chosen share of the texts hold, sorted, and in how many; only the order depends on it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(batch.column(0).to_pylist(), words)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["hash"])

    rows = texts.count()
    share = min(1, max(1 / SHARE, sample / max(1, rows)))
    chosen = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(10**6)) < int(10**6 * share)).distinct()
    several = chosen.mapInArrow(over_rows(work), "hash long").groupBy("hash").count().where("count > 2")
    got = several.orderBy(F.desc("count"), "hash").limit(MOST).toArrow()
    hashes, counts = (got.column(i).to_numpy() for i in range(2))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order]


def parity(found: np.ndarray) -> bytes:
    """Whether the number of shingles that fall on each place is odd, over at least two places a shingle."""
    places = 1 << max(9, (2 * len(found)).bit_length())
    at = (found >> np.uint64(16) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places) & 1).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """In how many places two parities differ, the longer one folded: their sets differ in no fewer shingles."""
    a, b = sorted((np.frombuffer(v, dtype=np.uint64) for v in (x, y)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _filter(values: DataFrame) -> np.ndarray:
    """Bits of fixed size that are set for all ``values`` (one long column) and few others; it only keeps rows off the network."""
    place = F.col(values.columns[0]).bitwiseAND(FILTER_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    rows = values.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return bits


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & np.uint64(FILTER_BITS - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def _wanted(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, packed): a packed text of each of the wanted nodes."""
    bits = _filter(wanted)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(0).to_pylist()
        names = np.array([node(s) for s in shingle_sets(rows, words)], dtype=np.int64)
        found = {int(names[k]): rows[k] or "" for k in np.flatnonzero(_passes(bits, names.view(np.uint64)))}
        packed = [zlib.compress(t.encode("utf-8", "surrogatepass")) for t in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(packed, pa.binary())], ["node", "packed"])

    rows = texts.select("text").mapInArrow(over_rows(work), "node long, packed binary")
    return rows.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _shared(marked: DataFrame) -> DataFrame:
    """(hash, place, node, n, hub): the entries of the shingles over which sets meet, hub the most typical of them."""
    meeting = marked.select(F.explode("prefix").alias("hash"), "node").groupBy("hash").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    meeting = store(meeting.where("low <> high").select("hash"), "meeting")
    bits = _filter(meeting)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        hashes = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        places = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = _passes(bits, hashes.view(np.uint64))
        owner = pa.array(owner[keep])
        columns = [pa.array(hashes[keep]), pa.array(places[keep]), *(batch.column(k).take(owner) for k in range(3))]
        return pa.RecordBatch.from_arrays(columns, ["hash", "place", "node", "n", "typical"])

    entries = marked.select("node", "n", "typical", "prefix").mapInArrow(over_rows(work), "hash long, place long, node long, n long, typical long").distinct()
    entries = store(entries.join(meeting, "hash", "left_semi"), "prefix_entries")
    hubs = entries.groupBy("hash").agg(F.max(F.struct("typical", "node", "n", "place")).alias("hub"))
    return store(entries.join(hubs, "hash").select("hash", "place", "node", "n", "hub"), "shared_entries")


def _alike(marked: DataFrame) -> DataFrame:
    """(x, y): sets whose fingerprints lie within two bits; of sets that share one the smallest stands for it."""
    named = store(marked.select("node", "bits").distinct(), "fingerprints")
    firsts = store(named.groupBy("bits").agg(F.min("node").alias("first")), "values")
    same = named.join(firsts, "bits").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = simhash_index.links(firsts.select("bits"))
    near = near.join(firsts.select(F.col("bits").alias("a"), F.col("first").alias("x")), "a").join(
        firsts.select(F.col("bits").alias("b"), F.col("first").alias("y")), "b"
    )
    return same.union(near.select("x", "y"))


def _maybe(pairs: DataFrame, marked: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose parities don't rule out that they are similar."""
    most = least[1] - least[0], least[1] + least[0]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart = [least_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(4))]
        keep = np.array(apart, dtype=np.int64) * most[1] <= batch.column(2).to_numpy() * most[0]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    known = store(marked.join(ends, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity")), "parities")
    wide = pairs.join(known.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("parity").alias("x")), "a").join(
        known.select(F.col("node").alias("b"), "n", F.col("parity").alias("y")), "b"
    )
    return wide.select("a", "b", F.expr("m + n"), "x", "y").mapInArrow(over_rows(work), "a long, b long")


def _verified(pairs: DataFrame, marked: DataFrame, texts: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose similarity is large enough."""
    pairs = store(_maybe(pairs, marked, least), "candidates")
    ends = store(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
    kept = store(_wanted(texts, ends, words), "packed_texts")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = dict.fromkeys(batch.column(2).to_pylist() + batch.column(3).to_pylist())
        found = dict(zip(packed, shingle_sets([zlib.decompress(p).decode("utf-8", "surrogatepass") for p in packed], words)))
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = found[x.as_py()], found[y.as_py()]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * least[1] >= (len(x) + len(y) - both) * least[0])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(kept.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a").join(
        kept.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b"
    )
    return store(wide.select("a", "b", "x", "y").mapInArrow(over_rows(work, 64), "a long, b long"), "links")


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: tuple[int, int] = LEAST,
    sample: int = SAMPLE,
) -> DataFrame:
    """(doc_id, component_id): one row per row of ``docs``.

    Documents link when the Jaccard similarity of their shingles is ``least`` or more; component_id
    is the smallest doc_id reachable over links, itself included. Texts without words link to each
    other, and null and empty ones are such texts. Rows with equal doc_id stay separate rows; a null doc_id
    is never the smallest. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    common, counts = common_shingles(texts, words, sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(batch.column(1).to_pylist(), words)
        firsts = [prefix(s, common, counts, least).view(np.int64) for s in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array([node(s) for s in found], pa.int64()),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([typical(s, common, counts) for s in found], pa.int64()),
                pa.array(np.array([simhash_index.of_hashes(s) for s in found], dtype=np.uint64).view(np.int64)),
                pa.array([parity(s) for s in found], pa.binary()),
                pa.array(firsts, pa.list_(pa.int64())),
            ],
            ["doc_id", "node", "n", "typical", "bits", "parity", "prefix"],
        )

    marked = store(texts.mapInArrow(over_rows(work), "doc_id long, node long, n long, typical long, bits long, parity binary, prefix array<long>"), "shingle_prefixes")
    shared = _shared(marked)

    def may(m: str, i: str, n: str, j: str):
        """Whether sets of m and n shingles, the first common one at places i and j, can be similar."""
        return F.least(F.col(m) - F.col(i), F.col(n) - F.col(j)) * (least[0] + least[1]) >= (F.col(m) + F.col(n)) * least[0]

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    stars = shared.where("node <> hub.node").where(may("n", "place", "hub.n", "hub.place")).select(F.col("hub.node").alias("x"), F.col("node").alias("y"))
    links = _verified(store(ordered(_alike(marked).union(stars)), "pairs"), marked, texts, words, least)
    joined = components(spark, links)

    # What its fingerprint and its hub do not reach may still be near another one of the shingle's sets.
    roots = joined.select(F.col("node").alias("of"), F.col("root").alias("its"))
    placed = shared.select("hash", "place", "node", "n", F.col("hub.node").alias("hub"))
    placed = placed.join(roots, F.col("node") == F.col("of"), "left").select("hash", "place", "node", "n", "hub", F.coalesce("its", "node").alias("root"))
    placed = placed.join(roots, F.col("hub") == F.col("of"), "left")
    placed = store(placed.select("hash", "place", "node", "n", "hub", "root", F.coalesce("its", "hub").alias("main")), "placed")
    outside = placed.where("root <> main").select("hash", F.col("place").alias("i"), F.col("node").alias("x"), F.col("n").alias("m"), F.col("root").alias("r"))
    others = placed.where("node <> hub").select("hash", "place", F.col("node").alias("y"), "n", "root")
    more = store(ordered(outside.join(others, "hash").where("r <> root").where(may("m", "i", "n", "place"))), "pairs")
    if not more.isEmpty():
        joined = components(spark, links.union(_verified(more, marked, texts, words, least)))

    named = marked.groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = named.join(joined, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = store(rooted.join(smallest, "root").select("node", "component_id"), "classes")
    return marked.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")
