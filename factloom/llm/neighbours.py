"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt into shards of about `SHARD` rows, and each goes once to its shard's task, which builds one tree of
vantage points. The queries, sorted behind the shard's vectors, stream through the tree in blocks, so a task holds one
shard and one block, however many queries there are. A branch is passed over when the triangle inequality's bound on its
distances, times `factor`, is above the k-th distance found so far: factor 1 is exact, larger ones prune more. Distances
are double precision, on the original vectors. The best k of each shard meet in one row number per query. That every
query visits every shard is what exactness asks for; the tree keeps most of a shard's rows from being looked at only
where the vectors have fewer dimensions than these, so a search costs queries times vectors in the worst case.

Vectors that are null, zero or hold null or non-finite components take no part. Of rows with one id the one with the
least vector counts. Vectors of another length than a query's are not its candidates. Ties go to the smaller id. With
fewer candidates than k, all are returned; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import checkpointed

SHARD = 16384
BLOCK = 1024
LEAF = 128


class Tree:
    """A vantage-point tree over the rows of x: inner nodes split by the median distance, leaves hold rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.nodes: list[tuple] = []
        self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= leaf:
            self.nodes[at] = (rows,)
            return at
        d = distances(self.x[rows], self.x[rows[:1]])[:, 0]
        far = rows[int(d.argmax())]  # a vantage point at the rim splits better than one in the middle
        d = distances(self.x[rows], self.x[far : far + 1])[:, 0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        spans = (d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max())
        self.nodes[at] = (far, spans, self._build(rows[inner], leaf), self._build(rows[outer], leaf))
        return at


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; the squares are added component by component, so their order is the same anywhere."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 18) // max(1, len(b)))
    for k in range(0, len(a), step):
        total = np.zeros((min(step, len(a) - k), len(b)))
        for x, y in zip(a[k : k + step].T, b.T):
            total += (x[:, None] - y[None, :]) ** 2
        out[k : k + step] = np.sqrt(total)
    return out


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest (distance, id) of each query but its own id; inf where there are fewer."""
    n = len(queries)
    best, name = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    squares, asked = (tree.x**2).sum(1), (queries**2).sum(1)

    def look(which: np.ndarray, rows: np.ndarray) -> None:
        # a product of matrices tells which pairs can't be among the k best; the others are measured as they are
        near = asked[which, None] + squares[None, rows] - 2 * (queries[which] @ tree.x[rows].T)
        itself = own[which, None] == ids[rows][None, :]
        near[itself] = np.inf
        slack = 1e-9 * (asked[which, None] + squares[None, rows]) + 1e-290
        limit = best[which, -1] ** 2
        if len(rows) > k:
            limit = np.minimum(limit, np.partition(near + 2 * slack, k - 1, axis=1)[:, k - 1])
        q, r = np.nonzero(~(near > limit[:, None] + slack) & ~itself)  # what overflows isn't ruled out
        if not len(q):
            return
        total = np.zeros(len(q))
        for x, y in zip(queries[which[q]].T, tree.x[rows[r]].T):
            total += (x - y) ** 2
        some, q = np.unique(q, return_inverse=True)
        d = np.concatenate([best[which[some]].ravel(), np.sqrt(total)])
        i = np.concatenate([name[which[some]].ravel(), ids[rows[r]]])
        of = np.concatenate([np.repeat(np.arange(len(some)), k), q])
        order = np.lexsort((i, d, of))
        first = np.searchsorted(of[order], np.arange(len(some)))
        take = order[first[:, None] + np.arange(k)]
        best[which[some]], name[which[some]] = d[take], i[take]

    def descend(at: int, which: np.ndarray) -> dict[int, np.ndarray]:
        """First the leaf where each query lies, for a bound to prune with."""
        node = tree.nodes[at]
        if len(node) == 1:
            look(which, node[0])
            return {at: which}
        d = distances(queries[which], tree.x[node[0] : node[0] + 1])[:, 0]
        near = d <= node[1][1]
        seen = {}
        for child, part in ((node[2], which[near]), (node[3], which[~near])):
            if len(part):
                seen |= descend(child, part)
        return seen

    def visit(at: int, which: np.ndarray, seen: dict[int, np.ndarray]) -> None:
        node = tree.nodes[at]
        if len(node) == 1:
            rest = which[~np.isin(which, seen[at])] if at in seen else which
            if len(rest):
                look(rest, node[0])
            return
        d = distances(queries[which], tree.x[node[0] : node[0] + 1])[:, 0]
        low_in, high_in, low_out, high_out = node[1]
        to_in, to_out = np.maximum(d - high_in, low_in - d), np.maximum(d - high_out, low_out - d)
        # the branch that is nearer to most goes first; the k-th distances are looked at again before the other
        both = [(node[2], to_in), (node[3], to_out)]
        for child, bound in both if (to_in <= to_out).mean() >= 0.5 else both[::-1]:
            go = which[bound * factor <= best[which, -1] * (1 + 1e-12)]
            if len(go):
                visit(child, go, seen)

    everyone = np.arange(n)
    if len(tree.x) and n:
        visit(0, everyone, descend(0, everyone))
    return best, name


def usable(column: str) -> Column:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def _planted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[Tree, np.ndarray] | None:
    """The tree over a shard's vectors, sorted by id, and their ids; of rows with one id the first."""
    if not held:
        return None
    ids = np.concatenate([i for i, _ in held])
    once = np.append(True, ids[1:] != ids[:-1])
    return Tree(np.concatenate([x for _, x in held])[once]), ids[once]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, factor: float = 1.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each row that `queries`, a predicate on vec_id, picks."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(usable("v") & F.col("vec_id").isNotNull())
    asked = checkpointed(rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    shards = max(1, -(-rows.count() // SHARD))
    kept = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("part"), "vec_id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"), "vec_id", "v")
    dealt = kept.unionByName(sent).select(F.size("v").alias("dim"), "shard", "part", "vec_id", "v")
    order = ["dim", "shard", "part", "vec_id", "v"]

    def run(batches):
        key, trees = None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("dim", "shard", "part")]
            ids, v = batch.column("vec_id").to_numpy(), batch.column("v")
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)]):
                dim, shard, part = (int(c[a]) for c in columns)
                if (dim, shard) != key:
                    key, held, trees = (dim, shard), [], None
                x = v.slice(a, b - a).flatten().to_numpy().reshape(b - a, dim)
                if not part:
                    held.append((ids[a:b], x))
                    continue
                if trees is None:
                    trees, held = _planted(held), []
                for q in range(0, b - a if trees else 0, BLOCK):
                    own = ids[a:b][q : q + BLOCK]
                    best, name = search(*trees, x[q : q + BLOCK], own, k, factor)
                    found = np.isfinite(best)
                    yield pa.record_batch([np.repeat(own, found.sum(1)), name[found], best[found]], names=["query_id", "vec_id", "score"])

    found = dealt.repartition(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
