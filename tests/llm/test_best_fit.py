"""Best-fit decreasing against a plain version, and whole documents through it."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import best_fit
from sensorloom.llm.encoders import encoder
from sensorloom.llm.queries import TOKENIZER, best_fit_packing


def plain_rooms(counts, capacity):
    """What room the windows are left with when pieces go one by one."""
    rooms = []
    for length in sorted(counts.elements(), reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return Counter(rooms)


def test_the_tree_finds_the_tightest_room():
    r, tree, held = random.Random(3), best_fit.Rooms(100), Counter()
    for step in range(3000):
        if r.random() < 0.6:
            room = r.randint(0, 100)
            tree.put(room, step, 1)
            held[room] += 1
        least = r.randint(0, 100)
        want = min((x for x, n in held.items() if n and x >= least), default=None)
        assert tree.tightest(least) == want
        if want is not None and r.random() < 0.7:
            tree.take(want)
            held[want] -= 1


def placed(counts, capacity, slack):
    plan = best_fit.plan(counts, capacity, slack)
    return [(n, rank, *part) for n, c in counts.items() for rank in range(c) for part in plan.place(n, rank)]


def padding(used, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in used)


def lengths_of(rows, capacity):
    """Lengths of the sequences; every one gapless from 0."""
    by = {}
    for _, _, _, n, sequence, offset in rows:
        by.setdefault(sequence, []).append((offset, n))
    for found in by.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    return [sum(n for _, n in found) for found in by.values()]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("capacity", [16, 64, 100])
def test_plan_is_best_fit_decreasing(seed, capacity):
    r = np.random.default_rng(seed)
    counts = Counter(np.clip(r.lognormal(2 + seed % 3, 1, 400).astype(int), 1, capacity).tolist())
    rows = placed(counts, capacity, capacity + 1)  # nothing is closed up
    assert Counter(capacity - n for n in lengths_of(rows, capacity)) == plain_rooms(counts, capacity)
    assert all(start == 0 and n == length for length, _, start, n, *_ in rows)


@pytest.mark.parametrize("seed", range(8))
def test_closing_up_leaves_little_padding(seed):
    r, capacity, slack = np.random.default_rng(seed), 64, 4
    low = (1, 30, 40, 33)[seed % 4]
    counts = Counter(r.integers(low, capacity + 1, 1 + 300 * (seed % 3)).tolist())
    rows = placed(counts, capacity, slack)
    for n, c in counts.items():
        for rank in range(c):
            parts = sorted(x[2:4] for x in rows if x[:2] == (n, rank))
            assert [a for a, _ in parts] == np.cumsum([0, *(b for _, b in parts[:-1])]).tolist() and sum(b for _, b in parts) == n
    used = lengths_of(rows, capacity)
    assert all(n & (n - 1) == 0 or capacity - n < slack for n in used)


def test_documents_come_back_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by, used = {}, {}
    for r in best_fit.packed(docs, TOKENIZER).collect():
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length
        by.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    tool = encoder(TOKENIZER)
    for row in docs.collect():
        parts = sorted(by.pop(row.doc_id), key=lambda p: p[0])
        want = np.append(tool.slow.encode(row.text or "", add_special_tokens=False).ids, 0)
        assert [p[0] for p in parts] == np.cumsum([0, *(len(p[1]) for p in parts[:-1])]).tolist()
        assert np.concatenate([p[1] for p in parts]).tolist() == want.tolist() and {p[2] for p in parts} == {len(want)}
    assert not by
    lengths = lengths_of([(0, 0, 0, n, s, o) for s, found in used.items() for o, n in found], 1024)
    assert padding(lengths, 1024) <= 0.01 * sum(lengths)


def test_digests_are_of_the_pieces(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in best_fit.packed(docs, TOKENIZER).collect()}
    got = best_fit_packing(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {(r.doc_id, r.start): r.ids_crc32 for r in got.collect()} == pieces


def test_ids_are_packed_in_two_or_four_bytes():
    for ids in ([], [0, 65535], [1, 65536], [2**32 - 1]):
        data = best_fit.narrow(np.array(ids, dtype=np.uint32))
        assert best_fit.wide(data, len(ids)).tolist() == ids


def test_trouble_and_nothing(spark, trouble, nothing):
    rows = best_fit.packed(trouble.union(trouble), TOKENIZER, rows_per_bucket=2).collect()
    tool = encoder(TOKENIZER)
    want = sum(len(tool.slow.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in trouble.collect())
    assert sum(r.length for r in rows) == 2 * want
    lengths = lengths_of([(0, 0, 0, r.length, r.sequence_id, r.offset) for r in rows], 1024)
    assert all(n & (n - 1) == 0 or n > 1024 - best_fit.SLACK for n in lengths)
    assert best_fit.packed(nothing, TOKENIZER).count() == 0
