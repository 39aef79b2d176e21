import random

import numpy as np

from sensorloom.llm import toxicity


def corpus(seed, n=400, clean_words=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(clean_words)]
    bad = ["vile", "rotten", "nasty", "loathsome"]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for w in r.sample(bad, r.randint(1, 4)):
                text.insert(r.randint(0, len(text)), w + r.choice(["", "ness", "er"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_texts_are_told_and_graded(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 280], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    held = [r for r in rows if r[0] >= 280]
    assert np.mean([got[i]["toxic"] == bool(y) for i, _, y in held]) > 0.97
    bad = ("vile", "rotten", "nasty", "loathsome")
    count = {i: sum(any(w.startswith(b) for w in t.split()) for b in bad) for i, t, _ in rows}
    mean = {k: np.mean([got[i]["severity"] for i in count if count[i] == k]) for k in range(5)}
    assert mean[0] < mean[1] < mean[2] < mean[3] <= mean[4] + 1e-9
    assert all(0 <= r["severity"] <= 2 and r["grade"] in (0, 1, 2) for r in got.values())


def test_gradient_equals_differences():
    r = np.random.default_rng(3)
    n, width = 30, 7
    owner, feature = r.integers(0, n, 80), r.integers(0, width, 80)
    grade = r.integers(0, 4, n)
    p = r.normal(size=width + 3)
    value, g = toxicity._loss(p, owner, feature, width, grade)
    for i in range(len(p)):
        step = np.zeros_like(p)
        step[i] = 1e-6
        up, down = (toxicity._loss(p + s, owner, feature, width, grade)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_thresholds_are_ordered():
    r = np.random.default_rng(4)
    owner, feature = np.arange(60), r.integers(0, 5, 60)
    _, thresholds = toxicity.fit(owner, feature, 5, r.integers(0, 4, 60))
    assert (np.diff(thresholds) > 0).all()


def test_nothing_to_learn_from(spark, trouble, nothing):
    for rows in ([], [(1, 1)], [(1, 0)], [(None, 1), (2, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.severity(trouble, toxicity.train(trouble, labels)).collect()
        assert len(got) == trouble.count() and not any(r["toxic"] for r in got)
    assert toxicity.severity(nothing, toxicity.train(nothing, labels)).count() == 0


def test_trouble(spark, trouble):
    rows = corpus(2, 120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.severity(trouble, toxicity.train(docs, labels)).collect()
    assert len(got) == trouble.count() and not any(r["toxic"] for r in got)


def test_grades_without_spread_become_one(spark):
    rows = [(i, f"some text {'awful' if i % 2 else 'fine'} here", i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert len(model.thresholds) == 1
    assert {r["toxic"] for r in toxicity.severity(docs, model).where("doc_id % 2 = 1").collect()} == {True}


def plain_probabilities(model, text):
    """From the definition: the sum of the weights of the text's distinct features, each word taken by itself."""
    words = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()
    found = {int(h) for w in words for h in toxicity.text_features([w])[0]}
    weight = dict(zip(map(int, model.keys), model.weights))
    score = sum(weight[h] for h in found if h in weight)
    below = [0.0, *(1 / (1 + np.exp(-(t - score))) for t in model.thresholds), 1.0]
    return [b - a for a, b in zip(below, below[1:])]


def test_severity_equals_its_plain_version(spark, trouble):
    rows = corpus(4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert len(model.keys) and len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    for df in (docs, trouble):
        texts = [r["text"] for r in df.collect()]
        got = toxicity.severity(df.coalesce(1), model).collect()
        for text, row in zip(texts, got):
            p = plain_probabilities(model, text)
            assert abs(row["severity"] - sum(j * x for j, x in enumerate(p))) < 1e-9
            assert row["grade"] == int(np.argmax(p)) and row["toxic"] == (p[0] <= 0.5)


def test_marks_and_grades_equal_their_plain_version():
    r = random.Random(9)
    texts = [({r.randrange(12) for _ in range(r.randint(0, 6))} | ({12, 13} if k % 3 == 0 and r.random() < 0.7 else {12} if k % 3 == 0 else set()), k % 3 == 0) for k in range(90)]
    toxic = np.array([t for _, t in texts])
    owner = np.array([k for k, (f, _) in enumerate(texts) for _ in f])
    feature = np.array([x for f, _ in texts for x in f])
    marked = toxicity.marks(toxic, owner, feature, 14)
    bad, good = sum(t for _, t in texts), sum(not t for _, t in texts)
    for x in range(14):
        a, b = (sum(x in f for f, t in texts if t == kind) + 0.5 for kind in (True, False))
        assert marked[x] == (a / (bad + 1) >= 8 * b / (good + 1))
    assert marked[12] and marked[13]
    held = [sum(marked[x] for x in f) for f, _ in texts]
    middle = float(np.median([h for h, (_, t) in zip(held, texts) if t]))
    want = [0 if not t else 2 if h > middle else 1 for h, (_, t) in zip(held, texts)]
    assert toxicity.graded(toxic, marked, owner, feature).tolist() == want
