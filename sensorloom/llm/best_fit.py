"""Packing of documents into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows and a rest. Then pieces go, longest first,
into the open window with the least room that still holds them; a segment tree over the possible
rooms, a leaf for each, finds it in a few steps. Pieces of one length are alike, and so are windows with the same
content: the plan works on their counts, at most ``capacity`` lengths however many documents there are. As the window
just filled is the tightest for the next piece of the same length, each takes as many as its room holds.

What windows are left with ``SLACK`` or more tokens of room is closed up: their pieces are laid end to end and cut at
the windows' ends, and the last of them is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bin_packing import END
from .encoders import all_ids, encoder
from .stores import over_rows, store

CAPACITY = 1024
SLACK = 8
ROWS_PER_BUCKET = 1_000


class Rooms:
    """A segment tree with a leaf for each room from 0 to ``capacity``: where are open windows?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, count: int) -> None:
        """Windows ``first`` to ``first + count - 1`` have this room."""
        self.groups.setdefault(room, []).append((first, count))
        at = room + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, room: int) -> tuple[int, int]:
        first, count = self.groups[room].pop()
        if not self.groups[room]:
            at = room + self.size
            self.any[at] = 0
            while at > 1 and not self.any[at ^ 1]:
                at >>= 1
                self.any[at] = 0
        return first, count

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open window has."""
        at = least + self.size
        if not self.any[at]:
            while at & 1 or not self.any[at + 1]:  # up to a right-hand neighbour that has one
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


@dataclass
class Plan:
    """Where the pieces of each length go, by their rank within it.

    Runs of ranks: the first rank of the run, copies per window, first window, offset of the first copy.
    Windows from ``line`` on are closed up: they hold ``fills`` tokens from ``tops`` of the line of all these;
    ``line_ends`` are the ends of the sequences cut from it, the first of which has the number ``first_line``.
    """

    capacity: int
    keys: np.ndarray
    copies: np.ndarray
    windows: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray
    tops: np.ndarray
    fills: np.ndarray
    line_ends: np.ndarray
    first_line: int

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """[(start in the piece, length, sequence, offset)] of one piece; several only where it is closed up."""
        key = (length << 40) + rank
        at = int(np.searchsorted(self.keys, key, "right")) - 1
        within, copies = key - int(self.keys[at]), int(self.copies[at])
        window = int(self.windows[at]) + within // copies
        offset = int(self.offsets[at]) + within % copies * length
        g = int(np.searchsorted(self.starts, window, "right")) - 1
        if self.tops[g] < 0:
            return [(0, length, int(self.numbers[g]) + window - int(self.starts[g]), offset)]
        low = int(self.tops[g]) + (window - int(self.starts[g])) * int(self.fills[g]) + offset
        out, start = [], 0
        while start < length:
            sequence, begin, end = self._line(low + start)
            n = min(length - start, end - low - start)
            out.append((start, n, self.first_line + sequence, low + start - begin))
            start += n
        return out

    def _line(self, place: int) -> tuple[int, int, int]:
        """The sequence of a place of the line, counted from 0, and where it begins and ends."""
        whole = int(self.line_ends[0])
        if place < whole:
            k = place // self.capacity
            return k, k * self.capacity, (k + 1) * self.capacity
        k = int(np.searchsorted(self.line_ends, place, "right"))
        return whole // self.capacity + k - 1, int(self.line_ends[k - 1]), int(self.line_ends[k])


def plan(counts: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK) -> Plan:
    """Best-fit decreasing of ``counts`` pieces of each length."""
    rooms, rows, opened = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:  # as many new windows as this length fills
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = rooms.take(room)
            each = min(room // length, left)
            full = min(count, left // each)
            rows.append(((length << 40) + rank, each, first, capacity - room))
            if room > each * length:
                rooms.put(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < count:
                rooms.put(room, first + full, count - full)
    groups = sorted((first, count, room) for room, found in rooms.groups.items() for first, count in found)
    starts, numbers, tops, fills = [], [], [], []
    number = line = done = 0

    def add(first: int, count: int, room: int) -> None:
        nonlocal number, line
        starts.append(first)
        numbers.append(number)
        fills.append(capacity - room)
        tops.append(line if room >= slack else -1)
        if room >= slack:
            line += count * (capacity - room)
        else:
            number += count

    for first, count, room in groups:  # what lies between are full windows
        if first > done:
            add(done, first - done, 0)
        add(first, count, room)
        done = first + count
    if opened > done:
        add(done, opened - done, 0)
    ends = [line // capacity * capacity]
    for bit in reversed(range(capacity.bit_length())):
        if (line - ends[0]) >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(
        capacity, *(table[:, k] for k in range(4)),
        *(np.array(x, dtype=np.int64) for x in (starts, numbers, tops, fills, ends)), number,
    )


def narrow(ids: np.ndarray) -> bytes:
    """Little-endian ids of two bytes where they fit, else of four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def wide(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * length else "<u4").astype("<u4")


def windows(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document's ids, ending with id 0, in full windows and a last rest.

    A null or empty text is one piece of one id. ``ids`` are packed as by ``narrow``.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, rows = encoder(path), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(all_ids(tool, text), np.uint32(END))
            rows += [(doc, a, len(part := ids[a : a + capacity]), narrow(part), len(ids)) for a in range(0, len(ids), capacity)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "start", "length", "ids", "doc_tokens"]
        )

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(over_rows(work, 64), "doc_id long, start long, length long, ids binary, doc_tokens long")


def ranks(pieces: DataFrame, counts: dict[int, int], capacity: int, keys: list[str], rows_per_bucket: int) -> DataFrame:
    """``pieces`` with _rank: 0, 1, ... within the pieces of one length, in buckets that no length fills alone."""
    sizes = [max(1, math.ceil(counts.get(n, 0) / rows_per_bucket)) for n in range(1, capacity + 1)]
    bucket = F.pmod(F.xxhash64(*keys), F.element_at(F.lit(sizes), F.col("length").cast("int"))).cast("int")
    dealt = pieces.withColumn("_bucket", bucket)
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)).cast("long") - 1
    return dealt.withColumn("_within", within).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_within") + F.col("_before"))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = SLACK, id_col: str = "doc_id",
           text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): each piece of each document and its place.

    ``ids`` are little-endian unsigned 32-bit numbers; offsets are gapless from 0. A sequence holds at
    most ``capacity`` ids and lacks less than ``slack`` of that, unless its length is a power of two. Null and empty texts are one
    piece of one id; rows that repeat an id, or have none, are documents of their own; an empty table
    stays empty and further columns are ignored.
    """
    spark = docs.sparkSession
    pieces = store(windows(docs, path, capacity, id_col, text_col), "windows")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(plan(counts, capacity, slack))
    # Pieces that are equal in these keys are equal in all they hold.
    ranked = ranks(pieces.withColumn("_hash", F.xxhash64("ids", "doc_tokens")), counts, capacity, ["doc_id", "start", "_hash"], rows_per_bucket)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, start, length, data, tokens, rank in zip(*(c.to_pylist() for c in batch.columns)):
            ids = wide(data, length)
            for low, n, sequence, offset in shared.value.place(length, rank):
                rows.append((doc, start + low, n, ids[low : low + n].tobytes(), tokens, sequence, offset))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    chosen = ranked.select("doc_id", "start", "length", "ids", "doc_tokens", "_rank")
    return chosen.mapInArrow(over_rows(work, 1024), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
