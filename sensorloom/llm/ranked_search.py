"""Ranked lexical search: the best documents of each item, term lists read in a hybrid of two orders.

Documents are indexed in segments of bounded size: the sorted lists of places and counts of the
terms that any item asks for. In a segment an item's short lists are read term by term and summed
into accumulators. The accumulators are then one more iterator with a bound, beside the long lists,
and all of them are read document by document: the segment is cut into ranges of places, every
iterator knows its highest score in a range, and a range whose bounds together miss the item's
worst kept score is skipped. In the others only iterators that can lift a document over that score
propose documents; the rest are looked up for documents that can still get there, highest bound first.

The worst kept scores start from a search of one segment in ``SEEDS``: what k documents of a part reach,
the best k of all reach too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stores import over_rows, slices, store

K = 20
SEGMENT_ROWS = 4096
SEGMENT_POSTINGS = 1 << 21
RANGE = 512
# Of a segment's places, the share that the lists summed into accumulators may hold together.
SHORT = 8
SEEDS = 64
# (item, term) rows that one search holds; more items take further searches.
BLOCK_ROWS = 500_000
CHUNK = 1 << 20

# Letters and digits of ASCII and all bytes beyond it make terms; A-Z turn small.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """How often each term (as UTF-8) occurs in a whole text."""
    data, counts, low = (text or "").encode("utf-8", "surrogatepass").translate(_TERM), Counter(), 0
    while low < len(data):
        high = data.find(b" ", low + CHUNK)
        high = len(data) if high < 0 else high
        counts.update(data[low:high].split())
        low = high
    return counts


@dataclass
class Query:
    """An item's terms, as numbers in the vocabulary, and how often it holds each."""

    item: int
    terms: np.ndarray
    repeats: np.ndarray


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, repeats): rows that share an id are one item."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, t, n) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for t, n in term_counts(text).items()]
        kinds = (pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["item_id", "term", "repeats"])

    narrow = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = narrow.mapInArrow(over_rows(work), "item_id long, term binary, repeats long")
    return found.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def item_blocks(items: DataFrame, rows: int) -> Iterator[tuple[list[Query], dict[bytes, int]]]:
    """Queries with their vocabulary, whole items of at most about ``rows`` (item, term) rows at a time."""
    queries, vocabulary, held = [], {}, 0
    item, mine = None, {}

    def closed() -> Query:
        terms = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in mine], dtype=np.int64)
        return Query(item, terms, np.array(list(mine.values()), dtype=np.int64))

    for row in items.orderBy("item_id", "term").toLocalIterator():
        if row[0] != item and mine:
            queries.append(closed())
            held, mine = held + len(mine), {}
            if held >= rows:
                yield queries, vocabulary
                queries, vocabulary, held = [], {}, 0
        item = row[0]
        mine[bytes(row[1])] = row[2]
    if mine:
        queries.append(closed())
    if queries:
        yield queries, vocabulary


SEGMENTS = "documents long, length long, docs binary, sizes binary, terms array<int>, counts array<int>, places binary, tfs binary"


def segments(docs: DataFrame, vocabulary: dict[bytes, int], segment_rows: int) -> DataFrame:
    """The index: documents with a term in order of id, their sizes in terms, and the lists of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def closed(rows: list[tuple], hits: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(2))
        order = np.lexsort((sizes, ids))
        place = np.empty(len(rows), dtype=np.int32)
        place[order] = np.arange(len(rows), dtype=np.int32)
        terms, tfs = (np.concatenate([h[k] for h in hits]) for k in range(2))
        places = np.repeat(place, [len(h[0]) for h in hits])
        by = np.lexsort((places, terms))
        distinct, counts = np.unique(terms, return_counts=True)
        columns = [
            pa.array([len(ids)]), pa.array([int(sizes.sum())]),
            pa.array([ids[order].tobytes()], pa.binary()), pa.array([sizes[order].tobytes()], pa.binary()),
            pa.array([distinct.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([places[by].tobytes()], pa.binary()), pa.array([tfs[by].tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["documents", "length", "docs", "sizes", "terms", "counts", "places", "tfs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, hits, held = shared.value, [], [], 0
        for batch in slices(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = term_counts(text)
                if not counts:
                    continue
                mine = [(known[t], n) for t, n in counts.items() if t in known]
                pairs = np.array(mine, dtype=np.int64).reshape(-1, 2)
                rows.append((doc, counts.total()))
                hits.append((pairs[:, 0], pairs[:, 1]))
                held += len(mine)
                if len(rows) >= segment_rows or held >= SEGMENT_POSTINGS:
                    yield closed(rows, hits)
                    rows, hits, held = [], [], 0
        if rows:
            yield closed(rows, hits)

    return docs.mapInArrow(work, SEGMENTS)


class Segment:
    """The lists of one segment with their scores and the highest of each range."""

    def __init__(self, row: dict, total: int, length: int, weights: np.ndarray, width: int):
        self.docs = np.frombuffer(row["docs"], dtype=np.int64)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64).tolist()
        m = np.array([75 + 25 * n * total // length for n in sizes], dtype=np.int64)
        places, tfs = np.frombuffer(row["places"], dtype=np.int32), np.frombuffer(row["tfs"], dtype=np.int64)
        self.ends = np.cumsum(row["counts"])
        self.starts = self.ends - row["counts"]
        self.at = {t: k for k, t in enumerate(row["terms"])}
        weight = np.repeat(weights[row["terms"]], row["counts"])
        self.places = places
        self.scores = weight * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[places]))
        self.edges = np.arange(0, len(self.docs) + width, width)
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def highest(self, places: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each range starts in a list, and the list's highest score in each."""
        cuts = np.searchsorted(places, self.edges)
        top = np.zeros(len(self.edges) - 1, dtype=np.int64)
        full = np.flatnonzero(np.diff(cuts))
        if len(full):
            top[full] = np.maximum.reduceat(scores, cuts[full])
        return cuts, top

    def listed(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, scores, range starts and range maxima of the k-th list."""
        places, scores = self.places[self.starts[k] : self.ends[k]], self.scores[self.starts[k] : self.ends[k]]
        if k not in self.cuts:
            self.cuts[k] = self.highest(places, scores)
        return places, scores, *self.cuts[k]


class Best:
    """The k best of an item so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.docs, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate((self.docs, docs)), np.concatenate((self.scores, scores))
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search(segment: Segment, query: Query, best: Best, seen: dict[str, int] | None = None) -> None:
    """Offer every document of a segment that scores at least ``best.least``; ``seen`` counts ranges and skipped ones."""
    held = [(segment.at[t], n) for t, n in zip(query.terms.tolist(), query.repeats.tolist()) if t in segment.at]
    held.sort(key=lambda x: segment.ends[x[0]] - segment.starts[x[0]])
    sums, room, long = np.zeros(len(segment.docs), dtype=np.int64), len(segment.docs) // SHORT, 0
    for k, n in held:
        low, high = segment.starts[k], segment.ends[k]
        if high - low > room:
            break
        sums[segment.places[low:high]] += n * segment.scores[low:high]
        room, long = room - (high - low), long + 1
    summed = np.flatnonzero(sums)
    iterators = [(summed, sums[summed], *segment.highest(summed, sums[summed]), 1)] if len(summed) else []
    iterators += [(*segment.listed(k), n) for k, n in held[long:]]
    if not iterators:
        return
    bounds = np.array([top * n for *_, top, n in iterators])
    together = bounds.sum(axis=0)
    for r in range(len(together)):
        if seen is not None:
            seen["ranges"] = seen.get("ranges", 0) + 1
            seen["skipped"] = seen.get("skipped", 0) + int(together[r] < best.least)
        if together[r] < best.least:
            continue
        start = segment.edges[r]
        order = np.argsort(bounds[:, r], kind="stable")
        reach = np.cumsum(bounds[order, r])
        optional = int(np.searchsorted(reach, best.least))  # these together stay below what is kept
        found = np.zeros(min(len(segment.docs), segment.edges[r + 1]) - start, dtype=np.int64)
        for i in order[optional:]:
            places, scores, cuts, _, n = iterators[i]
            part = slice(cuts[r], cuts[r + 1])
            found[places[part] - start] += n * scores[part]
        at = np.flatnonzero(found)
        for j in range(optional - 1, -1, -1):
            at = at[found[at] + reach[j] >= best.least]
            places, scores, cuts, _, n = iterators[order[j]]
            mine = places[cuts[r] : cuts[r + 1]] - start
            if not len(at) or not len(mine):
                continue
            where = np.minimum(np.searchsorted(mine, at), len(mine) - 1)
            hit = mine[where] == at
            found[at[hit]] += n * scores[cuts[r] : cuts[r + 1]][where[hit]]
        at = at[found[at] >= best.least]
        if len(at):
            best.offer(segment.docs[start + at], found[at])


def _found(index: DataFrame, queries: list[Query], least: list[int], total: int, length: int, weights: np.ndarray, k: int, width: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((queries, least, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, start, w = shared.value
        best = [Best(k, s) for s in start]
        for batch in slices(batches, 1):
            segment = Segment({c: batch.column(i)[0].as_py() for i, c in enumerate(batch.schema.names)}, total, length, w, width)
            for q, b in zip(asked, best):
                search(segment, q, b)
        for low in range(0, len(asked), 1024):
            part = list(zip(asked, best))[low : low + 1024]
            items = np.repeat(np.array([q.item for q, _ in part], dtype=np.int64), [len(b.docs) for _, b in part])
            columns = [items, np.concatenate([b.docs for _, b in part]), np.concatenate([b.scores for _, b in part])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "doc_id", "score"])

    found = index.mapInArrow(work, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", segment_rows: int = SEGMENT_ROWS,
           block_rows: int = BLOCK_ROWS, width: int = RANGE) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 of each item.

    Equal scores go by ascending doc_id; documents that repeat an id are ranked each. Rows without a
    doc_id or item_id take no part; rows that share an item_id are one item. Null and empty texts
    have no terms: such documents count nowhere and such items get no rows. Empty tables give an
    empty result, further columns are ignored. Items are taken in blocks of whole items with about
    ``block_rows`` terms; a block is one pass over the documents and its terms are what is broadcast.
    """
    spark = docs.sparkSession
    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for queries, vocabulary in item_blocks(item_terms(items, item_col, item_text_col), block_rows):
        index = store(segments(narrow, vocabulary, segment_rows), "segments")
        total, length = index.agg(F.sum("documents"), F.sum("length")).first()
        if not total:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts"))
        for term, n in held.collect():  # at most the block's terms
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
        few = _found(index.where(F.pmod(F.xxhash64("docs"), F.lit(SEEDS)) == 0), queries, [1] * len(queries), total, length, weights, k, width)
        reached = {r.item_id: r.score for r in few.where(F.col("rank") == k).collect()}
        least = [max(1, reached.get(q.item, 1)) for q in queries]
        out = out.union(_found(index, queries, least, total, length, weights, k, width).select("item_id", "rank", "doc_id", "score"))
    return out

