"""Ranked lexical search against a scorer written from the definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import ranked_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(small)


def plain(docs, items, k):
    rows = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    rows = [(i, c, c.total()) for i, c in rows if c]
    total, length = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for doc, c, n in rows:
            m = 75 + 25 * n * total // length
            score = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in q.items() if c[t])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(seed, rows):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Élan", "élan", "ABC", "abc", "x_y", "漢字"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=int(r.lognormvariate(2.5, 1))))) for i in range(rows)]
    return docs + [(3, docs[3][1]), (rows + 1, docs[5][1]), (None, "w0 w1"), (rows + 2, None), (rows + 3, " .,-")]


def asked(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices([f"w{k}" for k in range(60)], k=r.randint(1, 25)))) for i in range(12)]
    return items + [(4, "w9 Élan"), (50, None), (51, "nowhere"), (None, "w1"), (52, "w3 w3 w3, ABC")]


@pytest.mark.parametrize("rows_per_segment, width, block", [(4096, 512, 500_000), (37, 8, 40), (500, 16, 1)])
def test_ranks_equal_the_definition(spark, rows_per_segment, width, block):
    docs, items = corpus(1, 400), asked(2)
    found = search.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        5, segment_rows=rows_per_segment, width=width, block_rows=block,
    )
    assert sorted(map(tuple, found.collect())) == plain(docs, items, 5)


def test_fewer_documents_than_asked_for(spark):
    docs, items = [(1, "a b"), (2, "b c c"), (3, "d")], [(0, "b"), (1, "z")]
    found = search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == plain(docs, items, 20)


def test_a_term_that_all_documents_hold_scores_nothing_at_weight_zero(spark):
    docs = [(i, "same") for i in range(2000)]
    found = search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, "same")], "item_id long, text string"))
    assert found.count() == 0 and plain(docs, [(0, "same")], 20) == []


def test_long_texts_are_counted_in_parts():
    text = "word Other " * 300_000 + "x" * 3_000_000
    assert search.term_counts(text) == Counter({b"word": 300_000, b"other": 300_000, b"x" * 3_000_000: 1})


def segment_of(docs, vocabulary, width):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    lists = {t: [(p, c[t]) for p, (_, c) in enumerate(rows) if c[t]] for t in vocabulary}
    held = [t for t in vocabulary if lists[t]]
    as_bytes = lambda k, kind: np.array([x[k] for t in held for x in lists[t]], dtype=kind).tobytes()
    row = {
        "docs": np.array([i for i, _ in rows], dtype=np.int64).tobytes(), "sizes": np.array([c.total() for _, c in rows], dtype=np.int64).tobytes(),
        "terms": [vocabulary.index(t) for t in held], "counts": [len(lists[t]) for t in held], "places": as_bytes(0, np.int32), "tfs": as_bytes(1, np.int64),
    }
    weights = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * len(lists[t]) + 1))) for t in vocabulary], dtype=np.int64)
    return search.Segment(row, len(rows), sum(c.total() for _, c in rows), weights, width)


def test_ranges_below_the_worst_kept_score_are_skipped():
    # The best documents come first; later ranges hold the long lists' terms once in long texts.
    docs = [(i, "rare common other " * 4) for i in range(30)] + [(i, "common " + "filler " * 400) for i in range(30, 2000)]
    segment, seen = segment_of(docs, ["rare", "common", "other"], 64), {}
    best = search.Best(20, 1)
    search.search(segment, search.Query(0, np.arange(3), np.ones(3, dtype=np.int64)), best, seen)
    assert best.docs.tolist() == list(range(20))
    assert seen["ranges"] == 32 and seen["skipped"] >= 30


def test_trouble_and_nothing(spark, trouble, nothing):
    items = spark.createDataFrame([(0, "word again"), (1, None), (2, ""), (3, "漢字 ünïcödé")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in trouble.collect()]
    got = search.ranked(trouble, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, [tuple(r) for r in items.collect()], 20)
    assert search.ranked(nothing, items).count() == 0
    assert search.ranked(trouble, items.limit(0)).count() == 0
