"""Packing of documents into sequences by minimum bin slack.

A sequence is filled by a bitset subset-sum over the lengths still available: with the longest
piece set, the search adds lengths from long to short, with as many copies as there are, until
the remaining room is met exactly or all lengths are in, and the fullest combination is removed.
While all its lengths are still there the search would find the same combination again, so it is
removed as often as the counts allow at once. The search therefore works on the counts of lengths,
at most ``capacity`` numbers whatever the number of documents; pieces meet their places by
rank within their length, counted in buckets so that a length that very many pieces share is
spread over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoders import all_ids, encoder
from .stores import over_rows, store

CAPACITY = 2048
ROWS_PER_BUCKET = 20_000
END = 0


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The copies of each length that fill ``room`` best; long lengths come first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        steps.append((length, reach))
        left, copies = min(counts[length], room // length), 1
        while left:
            take = min(copies, left)
            reach |= (reach << (take * length)) & mask
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    goal, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> goal & 1:
            goal, n = goal - length, n + 1
        if n:
            chosen[length] = n
    return chosen


@dataclass
class Plan:
    """Runs of ranks of each length: the rank a run starts at, its copies per sequence, first sequence and offset."""

    keys: np.ndarray
    copies: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    total: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (lengths << 40) + ranks
        at = np.searchsorted(self.keys, keys, "right") - 1
        within = keys - self.keys[at]
        return self.sequences[at] + within // self.copies[at], self.offsets[at] + within % self.copies[at] * lengths


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Fill sequences until no length is left."""
    left, used, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts, reverse=True)
    at = 0
    while at < len(lengths):
        seed = lengths[at]
        if not left[seed]:
            at += 1
            continue
        left[seed] -= 1
        chosen = fullest(capacity - seed, {n: left[n] for n in lengths[at:]})
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times, offset = min(left[n] // c for n, c in chosen.items()), 0
        for n, c in sorted(chosen.items(), reverse=True):
            rows.append(((n << 40) + used[n], c, sequence, offset))
            used[n] += c * times
            left[n] -= c * times
            offset += n * c
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequence)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of each document, longer ones in pieces.

    ``ids`` holds little-endian unsigned 32-bit numbers. A document's ids end with id 0, so a null
    or empty text is one piece of one id. The first piece of a cut document may be shorter.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, rows = encoder(path), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(all_ids(tool, text), END).astype("<u4")
            head = len(ids) % capacity or capacity
            starts = [0, *range(head, len(ids), capacity)]
            rows += [(doc, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            ["doc_id", "piece", "start", "length", "ids"],
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(over_rows(work), "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: each piece's sequence, and its place there, gapless from 0.

    Lengths lie between 1 and ``capacity``. ``keys`` order the pieces of one length; rows that are
    equal in them get different places. All columns are carried; the names sequence_id and offset
    are taken over. An empty table stays empty.
    """
    spark = pieces.sparkSession
    pieces = store(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    buckets = math.ceil(max(1, sum(counts.values())) / ROWS_PER_BUCKET)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(length_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(length_col, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    within = F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*keys)).cast("long") - 1
    ranked = (
        dealt.withColumn("_within", within).join(before, [length_col, "_bucket"])
        .select(*pieces.columns, (F.col("_within") + F.col("_before")).alias("_rank"))
    )
    names = ranked.columns
    at, rank = names.index(length_col), names.index("_rank")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, rank))
        sequences, offsets = shared.value.place(lengths, ranks)
        columns = [c for i, c in enumerate(batch.columns) if i != rank]
        kept = [n for i, n in enumerate(names) if i != rank]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sequences), pa.array(offsets)], [*kept, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(over_rows(work, 65536), schema)
