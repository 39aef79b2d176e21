"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is contained when at least ``threshold`` of its distinct word shingles occur in the
document. Items are partitioned by the size of their shingle set into classes of powers of two.
Each class has its own MinHash sketches: of n shingles the n - need + 1 with the smallest
hashes, need being the count that containment asks for. A document that holds need of n shingles
must hold one of any n - need + 1 of them, so a look-up of the document's shingle hashes among
the sketches of a class finds every contained item; banded signatures of whole documents would
lose items in long documents, where the Jaccard similarity is close to nothing. Only hashes below
the largest sketch value of a class are looked up, and documents smaller than the class's least
need are not. Candidates are verified by exact shingle containment on the texts.

The items are the stated query set: they are prepared in blocks of bounded size, and each block
goes to the documents, which never move.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import over_rows
from .text_hash import plain, shingles, words

WIDTH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20


class Sketches:
    """The sketches of one size class, looked up by hash."""

    def __init__(self, width: int, entries: list[tuple[int, int]], need: int):
        keys = np.array([k for k, _ in entries], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.width, self.need = width, need
        self.keys, self.items = keys[order], np.array([i for _, i in entries], dtype=np.int64)[order]
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[(self.keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        low = hashes <= self.keys[-1]
        low &= self.seen[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
        hashes, owner = hashes[low], owner[low]
        enough = sizes[owner] >= self.need
        hashes, owner = hashes[enough], owner[enough]
        left = np.searchsorted(self.keys, hashes, "left")
        right = np.searchsorted(self.keys, hashes, "right")
        found = set()
        for d, a, b in zip(owner[right > left], left[right > left], right[right > left]):
            found.update((int(d), int(i)) for i in self.items[a:b])
        return found


class Items:
    """One block of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int | None, str | None]], width: int = WIDTH, threshold: float = THRESHOLD):
        self.ids, self.sets, self.widths, self.needs = [], [], [], []
        classes = defaultdict(list)
        for item, text in rows:
            tokens = plain(text).split()
            if not tokens:
                continue
            w = min(width, len(tokens))
            hashes, first = words([text])
            by_hash, _ = shingles(hashes, first, w)
            texts = [b" ".join(tokens[i : i + w]) for i in range(len(tokens) - w + 1)]
            distinct = dict(zip(texts, by_hash.tolist()))
            need = max(1, math.ceil(threshold * len(distinct) - 1e-9))
            n = len(self.ids)
            self.ids.append(item)
            self.sets.append(frozenset(distinct))
            self.widths.append(w)
            self.needs.append(need)
            sketch = sorted(distinct.values())[: len(distinct) - need + 1]
            classes[w, len(distinct).bit_length()].extend((h, n) for h in sketch)
        self.classes = [
            Sketches(w, entries, min(self.needs[i] for _, i in entries)) for (w, _), entries in sorted(classes.items())
        ]

    def found(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text's index, item's index, shingles held, shingles of the item) of every contained item."""
        if not self.classes:
            return []
        hashes, first = words(texts)
        candidates, by_width = set(), {}
        for c in self.classes:
            if c.width not in by_width:
                h, owner = shingles(hashes, first, c.width)
                by_width[c.width] = h, owner, np.bincount(owner, minlength=len(texts))
            candidates |= c.candidates(*by_width[c.width])
        out, held = [], {}
        for d, i in sorted(candidates):
            w = self.widths[i]
            if (d, w) not in held:
                tokens = plain(texts[d]).split()
                held = {(d, w): {b" ".join(tokens[j : j + w]) for j in range(len(tokens) - w + 1)}}
            n = len(self.sets[i] & held[d, w])
            if n >= self.needs[i]:
                out.append((d, i, n, len(self.sets[i])))
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH,
                threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about ``block_bytes`` of text, each as a broadcast variable."""
    spark = items.sparkSession
    narrow = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        part = narrow.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(Items([tuple(r) for r in part.collect()], width, threshold))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, held, shingles, containment): a row for each contained item of each row of ``docs``.

    Words are runs of letters, digits and _, lower-cased. An item of fewer words than ``width``
    is one shingle of its own length; null and empty items are contained nowhere, null and empty
    documents hold nothing. Repeated rows give repeated rows; null ids stay null. Extra columns
    are ignored.
    """
    out = None
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for block in item_blocks(items, width=width, threshold=threshold):

        def work(batch: pa.RecordBatch, block=block) -> pa.RecordBatch:
            known, ids = block.value, batch.column(0).to_pylist()
            rows = [
                (ids[d], known.ids[i], n, total, n / total)
                for d, i, n, total in known.found(batch.column(1).to_pylist())
            ]
            kinds = [pa.int64()] * 4 + [pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                ["doc_id", "item_id", "held", "shingles", "containment"],
            )

        part = narrow.mapInArrow(
            over_rows(work), "doc_id long, item_id long, held long, shingles long, containment double"
        )
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH,
                  threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns stay and no row moves.

    Null and empty texts hold nothing and stay; repeated rows share their fate. Without items
    every row stays, and an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    for block in item_blocks(items, width=width, threshold=threshold):

        def work(batch: pa.RecordBatch, block=block) -> pa.RecordBatch:
            clean = np.ones(batch.num_rows, dtype=bool)
            for d, *_ in block.value.found(batch.column(at).to_pylist()):
                clean[d] = False
            return batch.filter(pa.array(clean))

        docs = docs.mapInArrow(over_rows(work), docs.schema)
    return docs
