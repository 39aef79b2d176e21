import random

import pytest
import xxhash

from sensorloom.llm import simhash_index as near
from sensorloom.llm.stores import components


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "one", "Two words", "A b\tc\n d", "x " * 50, "É à É " * 9, "a b c a b c a b c"])
def test_fingerprint_follows_the_definition(text):
    assert near.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_does_not_depend_on_the_block(monkeypatch):
    text = " ".join(str(i * 7919 % 101) for i in range(1000))
    whole = near.fingerprint(text)
    monkeypatch.setattr(near, "BLOCK", 64)
    assert near.fingerprint(text) == whole == slow_fingerprint(text)


def values(seed):
    """Fingerprints around a few centres, some of them in one crowded half."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)]
    found = set()
    for c in centres:
        for _ in range(60):
            v = c
            for _ in range(r.randint(0, 4)):
                v ^= 1 << r.randint(0, 63)
            found.add(v)
    half = r.getrandbits(32)
    found |= {half << 32 | r.getrandbits(7) | r.getrandbits(3) << 20 for _ in range(120)}
    return sorted(found)


@pytest.mark.parametrize("seed, crowd", [(1, 64), (2, 0), (3, 5), (4, 10**6)])
def test_links_connect_what_is_near(spark, seed, crowd):
    vs = values(seed)
    signed = {v if v < 2**63 else v - 2**64: v for v in vs}
    df = spark.createDataFrame([(s,) for s in signed], "bits long")
    links = {(signed[r["a"]], signed[r["b"]]) for r in near.links(df, crowd).collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
    slow = [(a, b) for i, a in enumerate(vs) for b in vs[:i] if bin(a ^ b).count("1") <= 2]
    assert len(slow) > 100
    assert classes(vs, links) == classes(vs, slow)


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(spark, df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200, 202: 200}
    assert components(spark, df.limit(0)).count() == 0


def test_documents_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # Near-copies: one letter more in a long text.
    rows += [(10_000 + i, f"{t} q") for i, t in rows[:60] if len(t) > 2000]
    prints = {i: near.fingerprint(t) for i, t in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    want = classes(prints, linked)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in got)


def test_trouble(spark, trouble, nothing):
    got = near.near_duplicates(trouble).collect()
    assert len(got) == trouble.count()
    # Null, empty and blank texts share fingerprint zero; the null id of one of them is never smallest.
    assert {(r["doc_id"], r["component_id"]) for r in got if r["fingerprint"] == "0" * 16} == {(None, 1), (1, 1), (2, 1)}
    assert near.near_duplicates(nothing).count() == 0
    alone = trouble.where("doc_id IS NULL")
    assert near.near_duplicates(alone).first()["component_id"] is None


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long, 1), (3, long, 2), (9, long.upper(), 3), (9, long, 4), (7, "something else entirely here", 5), (7, "something else entirely here", 6), (None, "no name", 7), (None, "none", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 7), (True, 0), (True, 0)]
    assert near.keep_one(df.limit(0)).count() == 0
