import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import cover_tree as ct


def slow(rows, k):
    """rows: (id, vector or None)."""
    known = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in known]
    out = set()
    for q, a in {i: v for i, v in whole if i % 20 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def found(spark, rows, k=20, **blocks):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = df.select("vec_id", ct.quantised(F.col("embedding")).alias("vector"), F.lit(0).alias("score"))
    return ct.top_k(vectors, F.col("vec_id") % 20 == 0, k, **blocks)


def clustered(seed, n, d=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    points = centres[r.integers(0, 5, n)] + 0.1 * r.normal(size=(n, d))
    points[::7] = points[0]  # many copies of one vector
    return [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]


@pytest.mark.parametrize("blocks", [{}, {"data_block": 50, "query_block": 4}, {"data_block": 10_000, "query_block": 1}])
def test_equals_brute_force(spark, blocks):
    rows = clustered(1, 400)
    got = {tuple(r) for r in found(spark, rows, **blocks).collect()}
    assert got == slow(rows, 20)


def test_nulls_odd_numbers_lengths_and_few_rows(spark):
    rows = [(0, [0.5, 0.25]), (20, [1.0]), (1, [0.1, 0.2, 0.3]), (2, None), (40, [None, 1.0]), (3, [float("nan"), 1.0]), (60, [float("inf")]), (None, [1.0, 1.0]), (4, []), (80, [])]
    got = {tuple(r) for r in found(spark, rows, 3).collect()}
    assert got == slow(rows, 3)
    assert found(spark, []).count() == 0
    assert found(spark, [(1, [1.0]), (2, [2.0])]).count() == 0
    assert found(spark, [(20, [1.0])]).count() == 0


def test_repeated_rows_each_count_as_candidates(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    got = sorted(tuple(r) for r in found(spark, rows, 3).collect())
    assert got == [(0, 1, 1, 64 * 128), (0, 2, 1, 64 * 128), (0, 3, 2, 64 * 64)]


def test_large_vectors_are_scored_in_whole_numbers(spark):
    big = [1.5e6, 3.25e6, 2.0**26]
    rows = [(20 * i, [b + i, 0.5 * i, -b]) for i, b in enumerate(big)] + [(7 + i, [b, 1.0 + i / 64, b + 1]) for i, b in enumerate(big)] + [(41, [1.0, 2.0, 3.0])]
    got = {tuple(r) for r in found(spark, rows, 5).collect()}
    assert got == slow(rows, 5) and max(abs(g[3]) for g in got) > 2**53


def test_scores_beyond_a_long_count_as_its_ends(spark):
    got = sorted(tuple(r) for r in found(spark, [(0, [1e30]), (1, [1.0]), (2, [1e30]), (3, [-1e30])], 3).collect())
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 3, -(2**63))]


def test_pairs_of_far_clusters_are_not_scored(monkeypatch):
    """Counted on clustered vectors: most pairs of leaves are left out by their bounds."""
    r, made = np.random.default_rng(5), []
    centres = 100 * r.normal(size=(40, 8))
    points = np.floor(64 * (centres[r.integers(0, 40, 8000)] + r.normal(size=(8000, 8))))
    whole = ct.scored
    monkeypatch.setattr(ct, "scored", lambda mine, theirs, exact: made.append(len(mine) * len(theirs)) or whole(mine, theirs, exact))
    data, queries = ct.build(np.arange(8000), points), ct.build(np.arange(9000, 9100), points[:100], leaf=8)
    best = ct.Best(100, 10)
    ct.search(queries, data, best)
    assert sum(made) < 0.5 * 100 * 8000
    for row in range(100):
        scores = (data.points @ queries.points[row]).astype(int)
        assert best.scores[row].tolist() == sorted(scores.tolist(), reverse=True)[:10]


def test_tree_covers_its_points_with_separated_centres():
    r = np.random.default_rng(2)
    points = np.floor(64 * r.normal(size=(600, 3)))
    tree = ct.build(np.arange(600), points, leaf=8)
    nodes = [tree.root]
    while nodes:
        node = nodes.pop()
        mine = tree.points[node.low : node.high]
        assert np.sqrt(((mine - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert (node.children[0].centre == node.centre).all()
            assert node.children[0].low == node.low and node.children[-1].high == node.high
            centres = np.array([c.centre for c in node.children])
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.diag([np.inf] * len(centres))
            assert gaps.min() >= max(c.radius for c in node.children) - 1e-9
        nodes += node.children
    assert sorted(tree.ids) == list(range(600))


def test_far_pairs_are_left_out(monkeypatch):
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(size=(300, 4)) + 100, r.normal(size=(300, 4)) - 100])
    data, queries = ct.build(np.arange(600), points, leaf=16), ct.build(np.arange(1000, 1010), points[:10], leaf=4)
    best, seen = ct.Best(10, 5), []
    offer = best.offer
    monkeypatch.setattr(best, "offer", lambda row, scores, ids: (seen.extend(ids), offer(row, scores, ids)))
    ct.search(queries, data, best)
    assert max(seen) < 300 or len([i for i in seen if i >= 300]) < 30
    for row, heap in enumerate(best.heaps):
        want = sorted((float(queries.points[row] @ p), -i) for i, p in zip(data.ids, data.points))[-5:]
        assert sorted(i for _, i in heap) == sorted(i for _, i in want)
