"""The near-copy stage pairs texts by their fingerprints, and its order of shingles follows the corpus."""

import random

import corpus_pipeline

from sensorloom.llm import near_copies as near
from sensorloom.llm import simhash_index


def made(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def test_fingerprints_alone_pair_texts(spark, folder, monkeypatch):
    """Without the shingles over which sets meet, the fingerprints still find what lies within two bits."""
    shared = near._shared
    monkeypatch.setattr(near, "_shared", lambda marked: shared(marked).where("false"))
    text, far = made(1, 4000), made(2, 4000)
    rows = [(1, text), (2, text + " end"), (3, far), (4, far + " x y"), (5, made(3, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, folder).collect()) == [1, 3, 5]


def test_fingerprint_of_a_set(spark):
    (found,) = near.shingle_sets([made(4, 50)])
    want = sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in found) * 2 > len(found))
    assert simhash_index.of_hashes(found) == want
    assert simhash_index.of_hashes(found[:0]) == 0


def test_the_share_of_texts_that_tells_the_order_grows_with_them(spark):
    quote = "one two three four five six"
    rows = [(f"{made(k, 6)} {quote}" if k % 60 == 0 else made(k, 12),) for k in range(6000)]
    texts = spark.createDataFrame(rows, "text string")
    common, _ = near.common_shingles(texts, 5, sample=40)
    (found,) = near.shingle_sets([quote])
    assert set(found) <= set(common)
