import re

import pytest

from sensorloom.llm import decontaminate as leaks


def sets(text, width):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, items, width=5, threshold=0.8):
    found = {}
    for item, text in items:
        n = len(re.findall(r"\w+", (text or "").lower()))
        mine = sets(text, min(width, n)) if n else set()
        for k, (_, t) in enumerate(docs):
            held = len(mine & sets(t, min(width, n))) if mine else 0
            if mine and held >= threshold * len(mine) - 1e-9:
                found[k, item] = (held, len(mine))
    return found


def words(low, high):
    return " ".join(f"w{i}" for i in range(low, high))


ITEMS = [(1, words(0, 40)), (2, words(100, 112)), (3, "Just Three words!"), (4, ""), (5, None), (6, "one"), (7, words(0, 40)), (8, "Élan vital Ωμέγα ça va bien"), (None, words(300, 330))]
DOCS = [
    (10, "x " * 500 + words(0, 40).upper() + " y" * 500), (11, words(0, 36)), (12, words(0, 20) + " gap " + words(20, 40)),
    (13, words(0, 30)), (14, "a. " + words(100, 112).replace(" ", ", ") + "!"), (15, "only just three words here"), (16, None),
    (17, ""), (18, "ÉLAN vital, ωμέγα — ça va bien"), (None, words(300, 330)), (10, words(0, 40)), (19, "z " * 20_000 + words(0, 40)),
    (20, "one"), (21, "words three just"),
]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("width", [3, 5])
def test_search_finds_exactly_what_is_contained(threshold, width):
    ready = leaks.Items(ITEMS, width, threshold)
    got = {}
    for d, i, held, total in ready.found([t for _, t in DOCS]):
        got[d, ready.ids[i]] = (held, total)
    assert got == brute(DOCS, ITEMS, width, threshold)


def test_blocks_and_documents_of_the_tables(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in leaks.contained_items(docs, items).collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((rows[k][0], i, h, n, h / n) for (k, i), (h, n) in want.items()) == whole and whole


def test_several_blocks_give_the_same(spark, folder, monkeypatch):
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in leaks.contained_items(docs, items).collect())
    blocks = leaks.item_blocks
    monkeypatch.setattr(leaks, "item_blocks", lambda items, **kw: blocks(items, block_bytes=3000, **kw))
    assert sorted(tuple(r) for r in leaks.contained_items(docs, items).collect()) == whole


def test_clean_documents_stay_as_they_are(spark):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(DOCS)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    leaking = {k for k, _ in brute(DOCS, ITEMS)}
    kept = leaks.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r["item_id"] for r in kept.collect()} == set(range(len(DOCS))) - leaking


def test_trouble(spark, trouble, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks.contained_items(trouble, items).count() == 0
    assert leaks.contained_items(nothing, items).count() == 0
    assert leaks.contained_items(trouble, items.limit(0)).count() == 0
    assert leaks.without_leaks(trouble, items.limit(0)).count() == trouble.count()
