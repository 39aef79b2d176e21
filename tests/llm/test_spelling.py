"""Spelling variants against loops over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from sensorloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(docs, least_length=7, least_count=2):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            counts[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    return {w: n for w, n in counts.items() if n >= least_count and len(w) >= least_length}


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 10 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near[w]), form[w] or "", words[form[w]] if form[w] else 0, root(w)) for w, n in words.items())


def rows(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize("letters, sizes, blocks", [("ab", (1, 9), 6), ("abc", (7, 9), 6), ("aé", (5, 12), 3), ("abcd", (1, 5), 6)])
def test_near_pairs_are_all_pairs_of_one_edit(spark, letters, sizes, blocks):
    r = random.Random(len(letters) + sizes[0])
    words = sorted({"".join(r.choices(letters, k=r.randint(*sizes))) for _ in range(250)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted(tuple(sorted((p.a, p.b))) for p in spelling.near_pairs(df, blocks).collect())
    assert got == sorted((v, w) for i, v in enumerate(words) for w in words[i + 1 :] if one_edit(v, w))


def test_variants_equal_the_definition(spark):
    r = random.Random(5)
    stems = ["reading", "morning", "Élégance", "STATION", "libraries", "kitchen"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = r.choices(stems, [1000, 300, 100, 100, 30, 10])[0]
            if r.random() < 0.06:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aeé") + w[k:], w[:k] + r.choice("xÿ") + w[k + 1 :]])
            words.append(w)
        docs.append((i, "  ".join(words) + "."))
    docs += [docs[0], (None, docs[1][1]), (900, None), (901, ""), (902, "1234 -- 漢字漢字漢字漢字漢字")]
    want = plain_variants(plain_words(docs))
    assert rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == want
    assert any(row[3] for row in want)


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w18" for w, _ in chain}


def test_long_texts_are_cut_between_runs():
    text = "abcdefg, " * 300_000 + "y" * 3_000_000 + " end"
    assert spelling.runs(text) == Counter({"abcdefg": 300_000, "y" * 3_000_000: 1, "end": 1})


def test_trouble_and_nothing(spark, trouble, nothing):
    assert rows(spelling.variants(trouble)) == plain_variants(plain_words([(r.doc_id, r.text) for r in trouble.collect()]))
    twice = trouble.union(trouble)
    assert rows(spelling.variants(twice)) == plain_variants(plain_words([(r.doc_id, r.text) for r in twice.collect()]))
    assert spelling.variants(nothing).count() == 0
