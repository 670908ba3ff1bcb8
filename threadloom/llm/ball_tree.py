"""Exact top-k inner products: a ball tree for each shard, descended by bounds.

Vectors are dealt into shards by a hash of their id, queries into blocks; every shard meets every block, in rounds of
growing numbers of shards. A task builds its shard's ball tree. For a query q no vector in a ball with centre c and
radius r scores over q.c + r|q|, nor over its greatest norm times |q|, nor over what the bounds of the balls around it
allow. Each query first goes down to the leaf that the higher bounds lead to. Then the queries of a block descend from
the root together: at a node those whose bound is under their kth score drop out, the child with the higher bounds comes
first, and a sub-tree that no query is left for is never entered. The kth scores that the shards of a round find are
where the next round starts.

How much that saves depends on the vectors: clustered ones leave most leaves unvisited; vectors that point in random
directions of many dimensions fill balls as wide as the whole set, so nearly every leaf must be visited and the search
costs what a scan costs (README has figures). Results are exact either way.

Scores are whole numbers (exact below 2**53), so a bound is rounded down; leaves whose bound equals the kth score are
visited, for they may hold a smaller id. Ties go to the smaller id.

Vectors that are null, empty or hold null or non-finite components take no part; nor do rows with a null id. Vectors
of another length than the query's are no candidates for it. Rows of a repeated id are candidates each, but never for
a query of their own id; the id asks once, with its least vector. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialize

SHARD_ROWS = 32_768
LEAST_SHARD_ROWS = 2_048
QUERY_ROWS = 8_192
LEAF_ROWS = 64
ROUND_GROWTH = 8
NO_ID = np.iinfo(np.int64).max


class BallTree:
    """Balls in arrays; ``rows`` gives the rows (from, to) of each leaf's node, ``down`` the two children of the others.
    ``visited`` counts the leaves that queries were compared with, ``bounded`` the nodes that a bound was taken of."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.lexsort((ids,))
        nodes, stack = [], [(0, len(order), -1)]
        self.rows, self.down = {}, {}
        while stack:
            a, b, parent = stack.pop()
            own = vectors[order[a:b]]
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            at = len(nodes)
            nodes.append((centre, radius, float(np.sqrt((own**2).sum(axis=1).max()))))
            if parent >= 0:
                self.down.setdefault(parent, []).append(at)
            if b - a <= leaf:
                self.rows[at] = (a, b)
                continue
            one = own[int(((own - centre) ** 2).sum(axis=1).argmax())]
            two = own[int(((own - one) ** 2).sum(axis=1).argmax())]
            along = own @ (two - one)
            order[a:b] = order[a:b][np.argsort(along, kind="stable")]
            mid = a + int((along < (one + two) @ (two - one) / 2).sum())  # each row goes to the nearer of two far ones
            if min(mid - a, b - mid) * 16 < b - a:
                mid = (a + b) // 2
            stack += [(a, mid, at), (mid, b, at)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii, self.norms = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes])
        self.visited = self.bounded = 0

    def bounds(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """For each query: no row of the node scores more."""
        self.bounded += len(queries)
        return np.floor(np.minimum(queries @ self.centres[node] + norms * self.radii[node], norms * self.norms[node]) + 1e-6)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, chunk: int = 2_048) -> None:
        """Better ``scores`` and ``ids`` (queries, k), best first, by this tree's rows; free places hold -inf and ``NO_ID``."""
        for at in range(0, len(queries), chunk):
            part = slice(at, at + chunk)
            self._search(query_ids[part], queries[part], scores[part], ids[part])

    def _search(self, query_ids, queries, scores, ids) -> None:
        norms = np.sqrt((queries**2).sum(axis=1)) * (1 + 1e-12)
        everyone = np.arange(len(queries))
        seen: dict[int, np.ndarray] = {}
        stack = [(0, everyone)]
        while stack:  # each query's way down, by the higher bound
            node, asking = stack.pop()
            if node in self.rows:
                seen[node] = asking
                self._visit(node, asking, query_ids, queries, scores, ids)
                continue
            one, two = self.down[node]
            left = self.bounds(one, queries[asking], norms[asking]) >= self.bounds(two, queries[asking], norms[asking])
            stack += [(child, part) for child, part in ((one, asking[left]), (two, asking[~left])) if len(part)]
        stack = [(0, everyone, self.bounds(0, queries, norms))]
        while stack:
            node, asking, bound = stack.pop()
            hope = bound >= scores[asking, -1]
            asking, bound = asking[hope], bound[hope]
            if not len(asking):
                continue
            if node in self.rows:
                new = np.setdiff1d(asking, seen[node], assume_unique=True) if node in seen else asking
                self._visit(node, new, query_ids, queries, scores, ids)
                continue
            below = [(child, np.minimum(bound, self.bounds(child, queries[asking], norms[asking]))) for child in self.down[node]]
            below.sort(key=lambda x: x[1].sum())  # the child of higher bounds is taken from the stack first
            stack += [(child, asking, own) for child, own in below]

    def _visit(self, leaf, asking, query_ids, queries, scores, ids) -> None:
        if not len(asking):
            return
        a, b = self.rows[leaf]
        own = self.ids[a:b]
        self.visited += len(asking)
        got = queries[asking] @ self.vectors[a:b].T
        got[query_ids[asking][:, None] == own] = -np.inf
        last = scores[asking, -1:]
        better = ((got > last) | ((got == last) & (own < ids[asking, -1:]))).any(axis=1)
        rows, k = asking[better], scores.shape[1]
        all_scores = np.concatenate([scores[rows], got[better]], axis=1)
        all_ids = np.concatenate([ids[rows], np.broadcast_to(own, (len(rows), b - a))], axis=1)
        all_ids[np.isneginf(all_scores)] = NO_ID
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        scores[rows], ids[rows] = np.take_along_axis(all_scores, best, axis=1), np.take_along_axis(all_ids, best, axis=1)


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<int>, d): floor(scale * x) of every usable vector."""
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"), F.size("embedding").alias("d"))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row.

    Shards hold ``SHARD_ROWS`` vectors, or fewer where that leaves the session's cores without work.
    """
    spark = vectors.sparkSession
    base = materialize(quantized(vectors, scale), "vectors")
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    if shard_rows is None:
        shard_rows = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, -(-counts["n"] // (2 * spark.sparkContext.defaultParallelism))))
    shards, blocks = max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["q"] // query_rows))
    cand = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = base.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("d", "v")).alias("x"))
    query = asked.select("query_id", F.col("x.v").alias("q"), F.col("x.d").alias("d"), F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    out_schema = "query_id bigint, vec_id bigint, score bigint"

    def run(key, candidates, queries):
        import pyarrow as pa

        if not candidates.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        matrix = lambda table, name: np.array(table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)
        own, known = queries.column("query_id").to_numpy(), queries.column("known").to_pylist()
        scores, ids = np.full((len(own), k), -np.inf), np.full((len(own), k), NO_ID)
        for i, pairs in enumerate(known):
            for j, pair in enumerate(pairs):
                scores[i, j], ids[i, j] = -pair["s"], pair["i"]
        before = ids.copy()
        BallTree(candidates.column("vec_id").to_numpy(), matrix(candidates, "v")).search(own, matrix(queries, "q"), scores, ids)
        new = (ids != NO_ID) & ~(ids[:, :, None] == before[:, None, :]).any(axis=2)
        return pa.table({"query_id": np.broadcast_to(own[:, None], ids.shape)[new], "vec_id": ids[new], "score": scores[new].astype(np.int64)})

    order = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))
    first_k = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found, low, high = spark.createDataFrame([], out_schema), 0, 1
    while low < shards:
        # Each query starts from the k best that earlier rounds found.
        known = found.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("known"))
        start = query.join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<s:bigint,i:bigint>>")))
        each = start.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        rows = cand.where((F.col("shard") >= low) & (F.col("shard") < high)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        more = rows.groupBy("shard", "block", "d").cogroup(each.groupBy("shard", "block", "d")).applyInArrow(run, out_schema)
        ranked = found.unionByName(more).withColumn("rank", F.row_number().over(first_k)).where(F.col("rank") <= k)
        found = materialize(ranked.select("query_id", "vec_id", "score", "rank"), "top-k").drop("rank")
        low, high = high, min(shards, high * ROUND_GROWTH)
    return found.withColumn("rank", F.row_number().over(first_k)).select("query_id", "rank", "vec_id", "score")
