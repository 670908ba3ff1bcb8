"""Exact search for the best few of many vectors, block by block.

Queries are dealt into blocks and rows into tiles by a hash of their key; a task meets one block with one tile. Matrix
products find what can be among the best, the sums that SQL takes, term by term, then decide. So a pair costs a few
nanoseconds, a task holds one block and one tile, and what is shuffled is a vector for each block or tile that it meets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.storage import settled

BLOCK = 8192
ROWS = 256  # rows of a matrix product
DIGITS = 9
SLACK = 3 * 10.0**-DIGITS  # rounding moves two scores by one unit of the last digit at most
ERROR = 1e-13  # of a product of vectors of norm one, in whatever order it is summed


def matrix(column) -> np.ndarray:
    """Vectors of one length (an Arrow column of lists without nulls) as doubles."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def norms(x: np.ndarray) -> np.ndarray:
    """Of finite rows; others have scores that no sum alters."""
    return np.nan_to_num(np.sqrt((x**2).sum(1)), nan=0.0, posinf=0.0)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first component on as SQL sums them."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed in order."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        d = x[:, i] - y[:, i]
        out += d * d
    return out


def candidates(score: np.ndarray, k: int, least: float, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what can be among the ``k`` best of its row and reach ``least``. ``score`` is near the exact one
    by ``error`` (a row), minus infinity where a pair does not count; what is not a number is greater than any."""
    score = np.where(np.isnan(score), np.inf, score)
    kth = score.max(axis=1) if k == 1 else np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -np.inf)
    cut = np.maximum(kth, least) - SLACK - 2 * error
    return np.nonzero((score >= cut[:, None]) & (score > -np.inf))


def few(row: np.ndarray, order: np.ndarray, exact: np.ndarray, k: int) -> np.ndarray:
    """Positions that keep, of each row's equal scores, the ``k`` first by ``order``; copies are not handed on whole."""
    at = np.lexsort((order, exact, row))
    starts = np.flatnonzero(np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (exact[at][1:] != exact[at][:-1])]))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[place < k]


def best_in_scope(asked: DataFrame, rows: DataFrame, scope: list[str], k: int, least: float | None = None, others: bool = False, block: int = BLOCK, tile: int = BLOCK) -> DataFrame:
    """(qid, id, similarity): for each query (qid, scope, q) the ``k`` rows (id, scope, v) of its scope with the highest
    dot product, rounded to ``DIGITS``, ties to lesser ids; with ``least`` those at or over it, with ``others`` without
    the row of the query's own id. Vectors that are null, hold a null or have another length meet none."""
    whole = lambda df, key, v: settled(df.where(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())).select(key, *(F.col(c).alias(c) for c in scope), v, F.size(v).alias("_dim")))
    asked, rows, own = whole(asked, "qid", "q"), whole(rows, "id", "v"), [*scope, "_dim"]
    size = lambda df, n, name: df.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    both = settled(size(asked, block, "_blocks").join(size(rows, tile, "_tiles"), own))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(both, own).withColumn("a", dealt("qid", "_blocks")).withColumn("b", each("_tiles")).select("qid", "q", *own, "a", "b")
    right = rows.join(both, own).withColumn("b", dealt("id", "_tiles")).withColumn("a", each("_blocks")).select("id", "v", *own, "a", "b")
    floor = -np.inf if least is None else least

    def meet(queries, there):
        import pyarrow as pa

        names, row, col, exact = ["qid", "id", "similarity"], [], [], []
        if queries.num_rows and there.num_rows:
            there = there.sort_by("id")
            x, y = matrix(queries["q"]), matrix(there["v"])
            norm = norms(x) * norms(y).max()
            ids, asks = (there["id"].to_numpy(), queries["qid"].to_numpy()) if others else (None, None)
            for at in range(0, len(x), ROWS):
                score = x[at : at + ROWS] @ y.T
                if others:
                    score[asks[at : at + ROWS, None] == ids[None, :]] = -np.inf
                i, j = candidates(score, k, floor, ERROR * norm[at : at + ROWS])
                s = products(x[at + i], y[j])
                kept = few(i, j, s, k)
                row.append(at + i[kept])
                col.append(j[kept])
                exact.append(s[kept])
        put = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table([queries["qid"].take(pa.array(put(row, np.int64))), there["id"].take(pa.array(put(col, np.int64))), pa.array(put(exact, float))], names)

    kinds, keys = (dict(left.dtypes)["qid"], dict(right.dtypes)["id"]), [*own, "a", "b"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"qid {kinds[0]}, id {kinds[1]}, similarity double").withColumn("similarity", F.round("similarity", DIGITS))
    met = met if least is None else met.where(F.col("similarity") >= least)
    first = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return met.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
