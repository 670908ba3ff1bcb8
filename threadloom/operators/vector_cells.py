"""Exact vector search with pruning: vectors in cells around centres, bounds by the triangle inequality.

A cell holds the vectors nearest to its centre and their distances to it. For a query at distance d from a centre, a
vector at distance s from that centre is at least |d - s| away; so whole cells fall out by their nearest and farthest
distances, and in a cell only a ring of distances is read. Centres come from a bounded sample (``SAMPLE`` rows with the
least hash of their key): they decide how much is read, never what is found.

Vectors have one length and finite values; rows with a null vector are left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.blocks import BLOCK, DIGITS, ERROR, ROWS, candidates, few, matrix, squares
from threadloom.operators.retrieval import l2
from threadloom.operators.storage import settled

SAMPLE = 10_000
MAX_CELLS = 1024
STEPS = 4
FIRST_CELLS = 4
TILE = BLOCK
SLACK = 1e-6  # distances to centres come from squares and products, which lose digits near zero


def centres(vectors: DataFrame, key: str, v: str, cells: int | None = None) -> np.ndarray:
    """A few steps of k-means over the sample."""
    n = vectors.count()
    cells = min(MAX_CELLS, cells or max(1, math.isqrt(n)))
    rows = vectors.where(F.col(v).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(v).collect()
    x = np.array([r[0] for r in rows], dtype=float)
    if not len(x):
        return np.zeros((1, 1))
    at = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(STEPS):
        own = ((at**2).sum(1)[None, :] - 2 * x @ at.T).argmin(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=len(at))
        at = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], at)
    return at


def _distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, centres)."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (at**2).sum(1)[None, :] - 2 * x @ at.T, 0))


def assigned(vectors: DataFrame, v: str, at: np.ndarray) -> DataFrame:
    """``vectors`` with ``cell`` and ``dist``, the distance to its centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(at)
    kept = vectors.where(F.col(v).isNotNull())
    place = kept.columns.index(v)

    def run(batches):
        import pyarrow as pa

        for part in batches:
            if part.num_rows:
                d = _distances(matrix(part.column(place)), shared.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*part.schema.names, "cell", "dist"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(list(kept.schema.fields)).add("cell", IntegerType()).add("dist", DoubleType())
    return kept.mapInArrow(run, schema)


class CellIndex:
    """Cells in shared storage, sorted by cell and distance, so that rings are row groups next to each other."""

    def __init__(self, spark: SparkSession, address: str, key: str, v: str):
        self.rows, self.key, self.v = spark.read.parquet(f"{address}/rows"), key, v
        cells = sorted(spark.read.parquet(f"{address}/cells").collect(), key=lambda r: r["cell"])
        self.numbers = [r["cell"] for r in cells]
        self.at = np.array([r["centre"] for r in cells], dtype=float)
        self.near, self.far = np.array([r["near"] for r in cells]), np.array([r["far"] for r in cells])
        self.size = np.array([r["n"] for r in cells])

    @classmethod
    def build(cls, vectors: DataFrame, key: str, v: str, address: str, cells: int | None = None) -> CellIndex:
        """Of ``vectors``, all columns, so that searches can filter by them."""
        spark, at = vectors.sparkSession, centres(vectors, key, v, cells)
        assigned(vectors, v, at).repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("cell", "dist").write.parquet(f"{address}/rows")
        sizes = spark.read.parquet(f"{address}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far"))
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell int, centre array<double>")
        known.join(sizes, "cell").coalesce(1).write.parquet(f"{address}/cells")
        return cls(spark, address, key, v)

    def _ring(self, cells: list[int], d: np.ndarray, reach: float) -> Column:
        """Rows of these cells (positions) that can be within ``reach``."""
        if math.isinf(reach):
            return F.col("cell").isin([self.numbers[i] for i in cells])
        parts = [(F.col("cell") == self.numbers[i]) & F.col("dist").between(float(d[i] - reach - SLACK), float(d[i] + reach + SLACK)) for i in cells]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    def knn(self, q: list[float], k: int, where: Column | None = None) -> tuple[DataFrame, dict[str, int]]:
        """The ``k`` nearest rows that pass the filter, with ``distance``, ties to lesser keys; and of how many rows the
        distance was computed.

        Cells are asked in rounds, nearest bound first, each round twice as many as the one before, until no cell that
        is left can hold anything nearer than the k-th row found. ``k`` distances come to the driver a round.
        """
        d = np.sqrt(((self.at - np.array(q)) ** 2).sum(1))
        bound = np.maximum(np.maximum(d - self.far, self.near - d), 0)
        order, best, done, step = np.argsort(bound, kind="stable").tolist(), [], 0, FIRST_CELLS
        asked = 0
        reach = math.inf
        rows = (self.rows if where is None else self.rows.where(where)).withColumn("distance", l2(F.col(self.v), q))
        while done < len(order) and bound[order[done]] <= reach + SLACK:
            cells = [i for i in order[done : done + step] if bound[i] <= reach + SLACK]
            ring = self._ring(cells, d, reach)
            found = rows.where(ring).orderBy("distance", self.key).limit(k).select("distance").collect()
            best = sorted([*best, *(r["distance"] for r in found)])[:k]
            reach = best[-1] if len(best) == k else math.inf
            asked += self.rows.where(ring).count()
            done, step = done + step, step * 2
        cells = [i for i in order if bound[i] <= reach + SLACK]
        kept = rows.where(self._ring(cells, d, reach)) if cells else rows.limit(0)
        return kept.orderBy("distance", self.key).limit(k).drop("cell", "dist"), {"rows": int(self.size.sum()), "computed": asked}


def nearest_within(rows: DataFrame, scope: list[str], reach: float, cells: int | None = None, tile: int = TILE, least: float | None = None) -> DataFrame:
    """(id, nearest, distance_sq, asked) of rows (id, scope, v): each row's nearest other row of its scope within ``reach``,
    ties of the similarity (to ``DIGITS``) to lesser ids; with ``least`` only rows of that similarity count.

    A scope's rows are laid out by cell and cut into blocks of about ``tile`` rows, so a block holds few cells. Two blocks
    meet in a task if some cell of one can hold something within reach of some cell of the other; there a row is compared
    with the cells that it can reach. So a row is copied once for each block it meets, however many cells and rings there
    are, and a task holds two blocks. ``asked`` counts the pairs whose distance was computed, summed over a row.
    """
    spark = rows.sparkSession
    rows = settled(rows.select("id", *scope, "v").where(F.col("v").isNotNull()))
    at = centres(rows, "id", "v", cells)
    placed = settled(assigned(rows, "v", at))
    edges = {r["cell"]: (r["near"], r["far"]) for r in placed.groupBy("cell").agg(F.min("dist").alias("near"), F.max("dist").alias("far")).collect()}
    near, far = (np.array([edges.get(c, (np.inf, -np.inf))[side] for c in range(len(at))]) for side in (0, 1))
    apart = _distances(at, at)
    shared = spark.sparkContext.broadcast((at, near, far, apart - far[:, None] - far[None, :] <= reach + SLACK))
    # A row's place in its scope is that of its cell and a hash in it: nothing is sorted, and a cell may span blocks.
    counts = placed.groupBy(*scope, "cell").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(*scope).orderBy("cell")) - F.col("_n"))
    kept = settled(placed.join(starts, [*scope, "cell"]).withColumn("block", F.floor((F.col("_start") + F.pmod(F.xxhash64("id"), F.col("_n"))) / tile)).select("id", *scope, "cell", "block", "v"))
    held = settled(kept.groupBy(*scope, "block").agg(F.sort_array(F.collect_set("cell")).alias("cells")))
    renamed = held.select(*(F.col(c).alias(c) for c in scope), F.col("block").alias("b"), F.col("cells").alias("_others"))
    both = held.select(*scope, F.col("block").alias("a"), "cells").join(renamed, scope)

    def meeting(batches):
        import pyarrow as pa

        can = shared.value[3]
        for part in batches:
            left, right = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("cells", "_others"))
            yield part.select([*scope, "a", "b"]).filter(pa.array([bool(can[np.ix_(x, y)].any()) for x, y in zip(left, right)], pa.bool_()))

    types = dict(kept.dtypes)
    pairs = settled(both.select(*scope, "a", "b", "cells", "_others").mapInArrow(meeting, ", ".join(f"`{c}` {types[c]}" for c in scope) + ", a bigint, b bigint"))
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  (both sides come from the same rows)
    left = kept.withColumnRenamed("block", "a").join(pairs, [*scope, "a"]).select("id", "v", *scope, "a", "b")
    right = fresh(kept).withColumnRenamed("block", "b").join(fresh(pairs), [*scope, "b"]).select("id", "cell", "v", *scope, "a", "b")
    kind = types["id"]

    def best(asker, there):
        import pyarrow as pa

        row, col, exact, count = [], [], [], np.zeros(asker.num_rows, dtype=np.int64)
        if asker.num_rows and there.num_rows:
            centre, near, far, _ = shared.value
            there = there.sort_by([("cell", "ascending"), ("id", "ascending")])
            x, y, cell = matrix(asker["v"]), matrix(there["v"]), there["cell"].to_numpy()
            asks, ids = asker["id"].to_numpy(), there["id"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size, known = np.diff(np.append(first, len(cell))), cell[first]
            d = _distances(x, centre[known])
            reached = (d - far[known] <= reach + SLACK) & (near[known] - d <= reach + SLACK)
            half_x, half_y = (x**2).sum(1) / 2, (y**2).sum(1) / 2
            error, least = ERROR * (half_x + half_y.max()), -reach * reach / 2 - SLACK
            for low in range(0, len(x), ROWS):
                here = reached[low : low + ROWS]
                mine = np.arange(low, low + len(here))
                for some in (here.all(axis=1), ~here.all(axis=1)):  # those that reach every cell ask them at once
                    if not some.any():
                        continue
                    own = mine[some]
                    score = np.full((len(own), len(y)), -np.inf)
                    if here[some].all():
                        score = x[own] @ y.T - half_x[own, None] - half_y[None, :]
                        count[own] += len(y)
                    else:
                        for c in np.flatnonzero(here[some].any(axis=0)):
                            who, to = np.flatnonzero(here[some][:, c]), slice(first[c], first[c] + size[c])
                            score[who, to] = x[own[who]] @ y[to].T - half_x[own[who], None] - half_y[None, to]
                            count[own[who]] += size[c]
                    self_ = asks[own, None] == ids[None, :]
                    count[own] -= (self_ & np.isfinite(score)).sum(1)
                    score[self_] = -np.inf
                    i, j = candidates(score, 1, least, error[own])
                    s = squares(x[own[i]], y[j])
                    keep = few(i, ids[j], s, 1)  # the first of copies; near ties are left to the rounding
                    row.append(own[i[keep]])
                    col.append(j[keep])
                    exact.append(s[keep])
        put = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        row, met = put(row, np.int64), np.flatnonzero(count)
        names, near_ids = ["id", "nearest", "distance_sq", "asked"], there["id"].take(pa.array(put(col, np.int64)))
        # Found rows first, then how many pairs each asker was in.
        found = pa.table([asker["id"].take(pa.array(row)), near_ids, pa.array(put(exact, float)), pa.array(np.zeros(len(row), np.int64))], names)
        spent = pa.table([asker["id"].take(pa.array(met)), pa.nulls(len(met), near_ids.type), pa.array(np.full(len(met), np.inf)), pa.array(count[met])], names)
        return pa.concat_tables([found, spent])

    keys = [*scope, "a", "b"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"id {kind}, nearest {kind}, distance_sq double, asked bigint")
    similarity = 1 - F.pow(F.sqrt("distance_sq"), 2) / 2
    met = met.where(F.col("nearest").isNull() | ((F.col("distance_sq") <= reach * reach + 1e-9) & (F.lit(True) if least is None else similarity >= least)))
    best_of = F.min(F.struct((-F.round(similarity, DIGITS)).alias("key"), "nearest", "distance_sq")).alias("m")
    return met.groupBy("id").agg(best_of, F.sum("asked").alias("asked")).where(F.col("m.nearest").isNotNull()).select("id", "m.nearest", "m.distance_sq", "asked")
