import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import bin_packing as packing
from sensorloom.llm.encoders import encoder
from sensorloom.llm.queries import TOKENIZER, packed_documents


def best_sum(room, lengths):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_a_sequence_is_filled_as_well_as_it_can_be(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(1, 60) for _ in range(r.randint(1, 14)))
    room = r.randint(1, 120)
    chosen = packing.fullest(room, counts)
    assert all(c <= counts[n] for n, c in chosen.items())
    assert sum(n * c for n, c in chosen.items()) == best_sum(room, list(counts.elements()))


def check_plan(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity."""
    by_sequence = {}
    for sequence, offset, length in rows:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = Counter(np.clip(r.lognormal(3, 1, 3000).astype(int), 1, 200).tolist())
    plan = packing.plan(counts, 200)
    rows = []
    for n, c in counts.items():
        sequences, offsets = plan.place(np.full(c, n), np.arange(c))
        rows += list(zip(sequences.tolist(), offsets.tolist(), [n] * c))
    used = check_plan(rows, 200)
    lower = -(-sum(n * c for n, c in counts.items()) // 200)
    assert used == plan.total and lower <= used <= lower * 1.01 + 1


def test_documents_are_cut_and_packed_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = packed_documents(docs).collect()
    check_plan([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    lower = -(-sum(r["length"] for r in rows) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= lower * 1.02 + 1
    tool = encoder(TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tool.slow.encode(texts[doc], add_special_tokens=False).ids, 0], dtype="<u4")
        pieces.sort(key=lambda p: p["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            assert p["start"] == at and (k == 0 or p["length"] == 2048)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids) and (len(pieces) == 1) == (len(ids) <= 2048)


def test_trouble(spark, trouble, nothing):
    rows = packed_documents(trouble).collect()
    check_plan([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    assert sum(r["piece"] == 0 for r in rows) == trouble.count()
    assert sorted(r["length"] for r in rows if r["length"] == 1) == [1, 1]
    assert packed_documents(nothing).count() == 0


def test_repeated_rows_of_one_length_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 50)
    pieces = spark.range(1000).select((F.col("id") % 100).alias("doc_id"), F.lit(3).cast("long").alias("length"), F.lit("x").alias("offset"))
    rows = packing.pack(pieces, ["doc_id"], capacity=10).collect()
    assert check_plan([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 10) == 334
    with pytest.raises(ValueError, match="between 1 and 2"):
        packing.pack(pieces, ["doc_id"], capacity=2)
