import random

import corpus_pipeline
import pytest

from sensorloom.llm import near_copies as near


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(rows):
    sets = {i: slow_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                links += x != y
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, links


def edited(seed, groups=12, copies=14):
    """Groups of copies with a few words replaced, chains of edits, and a passage that all texts quote."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage, rows = [word() for _ in range(40)], []
    for g in range(groups):
        text = [word() for _ in range(r.choice([3, 30, 120, 400]))] + passage
        last = text
        for _ in range(copies):
            new = list(last if g % 2 else text)
            for _ in range(r.randint(0, max(1, len(new) // 60))):
                new[r.randrange(len(new))] = word()
            last = new
            rows.append((len(rows) + 1, (" " if r.random() < 0.5 else "\n ").join(new).title()))
    return rows + [(len(rows) + 1, "one two"), (len(rows) + 2, "ONE  two"), (len(rows) + 3, "two one"), (len(rows) + 4, "%%% !!!"), (len(rows) + 5, "?")]


@pytest.mark.parametrize("seed, sample", [(1, 4000), (2, 4000), (3, 0), (4, 40)])
def test_components_equal_brute_force(spark, seed, sample):
    rows = edited(seed)
    want, links = slow_components(rows)
    assert links > 100
    got = near.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sample=sample).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_documents_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, links = slow_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert links > 0
    assert {r["doc_id"]: r["component_id"] for r in near.near_copies(docs).collect()} == want


def test_the_stage_drops_an_edited_copy(spark, folder):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:100], "other", *words[101:]])), (3, " ".join([*words[:150], *(f"v{i}" for i in range(50))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, folder).collect()) == [1, 3]


def test_pairs_of_a_group_of_near_copies_grow_with_its_size(spark, monkeypatch):
    """Copies with edits of their own: each is verified against the text they come from, hardly any against each other."""
    made = []
    whole = near._verified

    def counting(pairs, *rest):
        made.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(near, "_verified", counting)
    r, text, totals = random.Random(6), [f"w{i}" for i in range(150)], []
    for copies in (60, 240):
        rows = [(0, " ".join(text))]
        for i in range(1, copies + 1):
            new = list(text)
            for _ in range(r.randint(1, 9)):
                new[r.randrange(len(new))] = f"v{r.randrange(10**9)}"
            rows.append((i, " ".join(new)))
        made.clear()
        got = near.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {x["doc_id"]: x["component_id"] for x in got} == slow_components(rows)[0]
        totals.append(sum(made))
    assert totals[1] <= 6 * totals[0] and totals[1] <= 6 * 240


def test_trouble(spark, trouble, nothing):
    got = near.near_copies(trouble).collect()
    assert len(got) == trouble.count()
    assert near.near_copies(nothing).count() == 0
    assert near.near_copies(trouble.where("doc_id IS NULL")).first()["component_id"] is None
