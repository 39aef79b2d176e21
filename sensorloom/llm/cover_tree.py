"""Exact top-k by inner product with cover trees over queries and data.

Vectors are dealt into blocks of bounded size and each block is indexed by a cover tree:
a node has a centre among its points, children that cover it with centres chosen farthest
first (so they are apart from each other by at least the radius they cover, and the node's own centre
is among them), and the true covering radius. Queries are indexed the same way. Each pair of a
query tree and a data tree is searched together: of a query node with centre a and radius r and
a data node with centre b and radius s, no inner product exceeds a.b + r|b| + s|a| + rs, and the
pair is left out when that lies below the worst k-th score of the group's queries so far. Ties are
never left out. The scores found carry over from one data tree to the next in a task, and the best k
of all tasks are merged by a window per query. Leaves are scored as one matrix product; what lies below the
worst kept score of its query is dropped by comparison, and only the rest is ordered.

Whole numbers below 2 ** 53 are exact in doubles. Pairs of trees whose inner products may exceed that are scored in
integers, of any size; what a long can't hold counts as the largest or smallest long.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stores import store

DATA_BLOCK = 4096
QUERY_BLOCK = 1024
LEAF = 512
FANOUT = 32
# Data trees that a task goes through with a query tree.
TREES_PER_TASK = 4
EXACT = 2.0**53
LONG = 2**63 - 1


@dataclass
class Node:
    low: int
    high: int
    centre: np.ndarray
    norm: float
    radius: float
    children: list[Node]


@dataclass
class Tree:
    ids: np.ndarray
    points: np.ndarray
    root: Node


def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree over the rows of ``points``; the rows are put in the tree's order."""
    order = np.arange(len(ids))

    def grow(low: int, high: int, centre: np.ndarray) -> Node:
        mine = points[order[low:high]]
        apart = _far(mine, centre)
        node = Node(low, high, centre, float(np.sqrt((centre**2).sum())), float(apart.max(initial=0.0)), [])
        if high - low <= leaf or node.radius == 0.0:
            return node
        nearest, owner, centres = apart, np.zeros(high - low, dtype=np.int64), [centre]
        while len(centres) < FANOUT and nearest.max() > node.radius / 2:
            new = mine[int(nearest.argmax())]
            d = _far(mine, new)
            closer = d < nearest
            nearest = np.where(closer, d, nearest)
            owner[closer] = len(centres)
            centres.append(new)
        order[low:high] = order[low:high][np.argsort(owner, kind="stable")]
        bounds = low + np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(centres)))))
        node.children = [grow(a, b, c) for a, b, c in zip(bounds[:-1], bounds[1:], centres) if b > a]
        return node

    root = grow(0, len(ids), points[0])
    return Tree(ids[order], points[order], root)


class Best:
    """The k best of each query so far: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = [np.zeros(0, dtype=np.int64)] * queries, [np.zeros(0, dtype=np.int64)] * queries
        self.worst = np.full(queries, -LONG - 1, dtype=np.int64)

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate((self.scores[row], np.asarray(scores).astype(np.int64)))
        ids = np.concatenate((self.ids[row], ids))
        if len(scores) > 4 * self.k:  # all that ties with the k-th stays for the order by id
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            kept = scores >= least
            scores, ids = scores[kept], ids[kept]
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores[row], self.ids[row] = scores[order], ids[order]
        if len(order) == self.k:
            self.worst[row] = self.scores[row][-1]

    @property
    def heaps(self) -> list[list[tuple[int, int]]]:
        """(score, negative id) of each query's best."""
        return [list(zip(s.tolist(), (-i).tolist())) for s, i in zip(self.scores, self.ids)]


def scored(mine: np.ndarray, theirs: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; ``exact`` tells that doubles hold them."""
    if exact:
        return (mine @ theirs.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in part], dtype=object).reshape(part.shape) for part in (mine, theirs)]
    return np.clip(whole[0] @ whole[1].T, -LONG - 1, LONG).astype(np.int64)


def _bound(q: Node, d: Node) -> float:
    top = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return top + 1e-9 * (q.norm + q.radius) * (d.norm + d.radius) + 1e-6


def search(queries: Tree, data: Tree, best: Best) -> None:
    """Offer every data point that can be among the best of a query, never the query's own id."""
    exact = math.prod(t.root.norm + t.root.radius for t in (queries, data)) < EXACT / 2
    stack = [(_bound(queries.root, data.root), queries.root, data.root)]
    while stack:
        top, q, d = stack.pop()
        if top < best.worst[q.low : q.high].min():
            continue
        if not q.children and not d.children:
            mine, theirs = queries.points[q.low : q.high], data.points[d.low : d.high]
            scores, ids = scored(mine, theirs, exact), data.ids[d.low : d.high]
            good = (scores >= best.worst[q.low : q.high, None]) & (ids[None, :] != queries.ids[q.low : q.high, None])
            for row in np.flatnonzero(good.any(axis=1)):
                best.offer(q.low + row, scores[row, good[row]], ids[good[row]])
            continue
        split_query = q.children and (not d.children or q.radius > d.radius)
        pairs = [(c, d) for c in q.children] if split_query else [(q, c) for c in d.children]
        stack += sorted(((_bound(a, b), a, b) for a, b in pairs), key=lambda t: t[0])


def quantised(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component as double; null unless all components are there and finite."""
    usable = vector.isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    whole = F.transform(vector, lambda x: F.rint(F.floor(F.lit(factor) * x.cast("double")).cast("double")))
    return F.when(F.coalesce(usable, F.lit(False)), whole)


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for row, values in enumerate(lists):
        out[row, : len(values)] = values
    return out


def _trees(vectors: DataFrame, block_rows: int, count: int) -> DataFrame:
    """(block, tree): the vectors dealt by hash, one pickled tree per block."""
    blocks = max(1, math.ceil(count / block_rows))

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        tree = build(ids[order], _matrix(table.column("vector").combine_chunks())[order])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(grown, "block int, tree binary")


def _padded(points: np.ndarray, width: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, width - points.shape[1])))


def _same_width(a: Tree, b: Tree) -> None:
    width = max(a.points.shape[1], b.points.shape[1])
    for tree in (a, b):
        if tree.points.shape[1] < width:
            tree.points = _padded(tree.points, width)
            nodes = [tree.root]
            while nodes:
                node = nodes.pop()
                node.centre = np.pad(node.centre, (0, width - len(node.centre)))
                nodes += node.children


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector",
          data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with other rows.

    ``vector_col`` holds whole numbers as doubles, as ``quantised`` makes them; rows with a null
    vector or id take no part. Shorter vectors count as if zeros followed. Ties go to the smaller id.
    A query's own row is told by its id, so rows repeating that id are left out with it, and
    further rows repeating a candidate's id each count. Fewer candidates than k are all
    returned; without queries or rows the result is empty. Of query rows that repeat an id the one whose
    vector hashes lowest asks. Scores beyond a long count as its ends. ``is_query`` reads the columns of ``vectors``.
    """
    rows = store(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
        .where("vec_id is not null and vector is not null"),
        "vectors",
    )
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    data = store(_trees(rows, data_block, total), "data_trees")
    blocks = max(1, math.ceil(total / data_block))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    queries = _trees(asked, query_block, asking).select(F.col("block").alias("group"), F.col("tree").alias("asked"))
    pairs = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(data, "block")

    def searched(batches):
        group, tree, best = None, None, None

        def found():
            asked_ids = np.repeat(tree.ids, [len(i) for i in best.ids])
            columns = [pa.array(c) for c in (asked_ids, np.concatenate(best.ids), np.concatenate(best.scores))]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                number, blob, other = (batch.column(i)[row].as_py() for i in range(3))
                if number != group:
                    if group is not None:
                        yield found()
                    group, tree = number, pickle.loads(blob)
                    best = Best(len(tree.ids), k)
                data_tree = pickle.loads(other)
                _same_width(tree, data_tree)
                search(tree, data_tree, best)
        if group is not None:
            yield found()

    # A task keeps a query tree while it goes through some of the data trees.
    tasks = pairs.repartition(F.col("group"), F.floor(F.col("block") / TREES_PER_TASK)).sortWithinPartitions("group")
    near = tasks.select("group", "asked", "tree").mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
