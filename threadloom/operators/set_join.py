"""Set-similarity join block by block, and ordered pairs counted without making them.

Words that half of the sets hold make any two of them meet, so what is shuffled must not be their pairs. Distinct sets
are dealt into blocks and tiles by a hash, a task meets one block with one tile and hands on the similar pairs alone. It
counts shared words by a matrix product over those that many of its sets hold, and by postings over the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.storage import settled

SLACK = 1e-9
BLOCK = 8192
ROWS = 256  # rows of a matrix product
COMMON = 0.005  # share of the pairs of a block and a tile that a word must join to be a column of the product


def similar_sets(left: DataFrame, right: DataFrame, least: float, scope: list[str] | None = None, k: int | None = None, block: int = BLOCK, tile: int = BLOCK) -> DataFrame:
    """(left_id, right_id, score) of the pairs of ``left`` and ``right`` (id, words, and the columns of ``scope``, in which
    they must agree) whose distinct words have a Jaccard similarity of ``least`` (over 0) or more; with ``k`` the best ones
    of each left row of a scope, ties to lesser right ids.

    Null and empty sets are similar to nothing. Equal sets meet once.
    """
    if not 0 < least <= 1:
        raise ValueError("sets that share nothing are not joined: the similarity must be over 0")
    scope = scope or []
    a, b = settled(_named(left, scope, "l")), settled(_named(right, scope, "r"))
    near = candidates(a, b, least, scope, k, block, tile)
    mine, theirs = a.select(*scope, "_lh", F.col("id").alias("left_id")), b.select(*scope, "_rh", F.col("id").alias("right_id"))
    if k is not None:
        # Of equal sets the first k rows can be among the best, so copies do not meet copies.
        first = F.row_number().over(Window.partitionBy(*scope, "_rh").orderBy("right_id"))
        theirs = theirs.distinct().withColumn("_n", first).where(F.col("_n") <= k).drop("_n")
    # Rows of equal sets share the verdict; they are spread out again by joins, not gathered.
    met = near.join(theirs, [*scope, "_rh"])
    if k is not None:
        best = F.row_number().over(Window.partitionBy(*scope, "_lh").orderBy(F.desc("score"), "right_id"))
        met = met.withColumn("_n", best).where(F.col("_n") <= k)
    return met.join(mine, [*scope, "_lh"]).select("left_id", "right_id", "score").distinct()


def _named(rows: DataFrame, scope: list[str], side: str) -> DataFrame:
    """(scope, id, words, h) with distinct sorted words and the digest that stands for the set."""
    w = f"_{side}w"
    own = rows.select(*scope, "id", F.array_sort(F.array_distinct(F.array_compact("words"))).alias(w)).where(F.size(w) > 0)
    return own.withColumn(f"_{side}h", F.unhex(F.sha2(F.concat_ws("\0", w), 256)))


def candidates(left: DataFrame, right: DataFrame, least: float, scope: list[str], k: int | None = None, block: int = BLOCK, tile: int = BLOCK) -> DataFrame:
    """(scope, _lh, _rh, score): pairs of distinct sets (as ``_named`` gives them) that are that similar; with ``k`` at least
    the best of each left set."""
    own = [*scope, "_one"]
    fold = lambda rows, side: rows.select(*scope, F.lit(0).alias("_one"), f"_{side}h", f"_{side}w").dropDuplicates([*own, f"_{side}h"])
    a, b = settled(fold(left, "l")), settled(fold(right, "r"))
    size = lambda df, n, name: df.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    both = settled(size(a, block, "_blocks").join(size(b, tile, "_tiles"), own))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sets = a.join(both, own).withColumn("a", dealt("_lh", "_blocks")).withColumn("b", each("_tiles")).select(*own, "a", "b", "_lh", "_lw")
    others = b.join(both, own).withColumn("b", dealt("_rh", "_tiles")).withColumn("a", each("_blocks")).select(*own, "a", "b", "_rh", "_rw")

    def meet(here, there):
        import pyarrow as pa

        i, j, score = similar(*encoded(here["_lw"], there["_rw"]), least, k)
        i, j = pa.array(i), pa.array(j)
        return pa.table([*(here[c].take(i) for c in scope), here["_lh"].take(i), there["_rh"].take(j), pa.array(score)], [*scope, "_lh", "_rh", "score"])

    kinds, keys = dict(a.dtypes), [*own, "a", "b"]
    return sets.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(meet, ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "_lh binary, _rh binary, score double"]))


def encoded(left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and word numbers of the sets of two Arrow columns of lists without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (left, right)]
    words = [x.flatten() for x in lists]
    codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    return sizes[0], codes[: len(words[0])], sizes[1], codes[len(words[0]) :]


def similar(ln: np.ndarray, lc: np.ndarray, rn: np.ndarray, rc: np.ndarray, least: float, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the similar pairs of sets, given by sizes and word numbers, one set after the other; with
    ``k`` those at or over the row's kth score."""
    row, col, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(lc) and len(rc):
        n = int(max(lc.max(), rc.max())) + 1
        lr, rr = np.repeat(np.arange(len(ln)), ln), np.repeat(np.arange(len(rn)), rn)
        held = np.bincount(lc, minlength=n)
        common = held * np.bincount(rc, minlength=n) > COMMON * len(ln) * len(rn)
        place = np.cumsum(common) - 1
        wide = int(common.sum())
        y = np.zeros((wide, len(rn)), np.float32)
        c = common[rc]
        y[place[rc[c]], rr[c]] = 1
        rare = ~c & (held[rc] > 0)
        order = np.argsort(rc[rare], kind="stable")
        lists, length = rr[rare][order], np.bincount(rc[rare], minlength=n)
        start, ends = np.cumsum(length) - length, np.concatenate([[0], np.cumsum(ln)])
        # a / (n + m - a) >= t means a >= t / (1 + t) * (n + m); a margin covers what floats lose, doubles decide.
        share = (least - 2 * SLACK) / (1 + least) * (1 - 1e-5)
        for at in range(0, len(ln), ROWS):
            until = min(at + ROWS, len(ln))
            codes, rows = lc[ends[at] : ends[until]], lr[ends[at] : ends[until]] - at
            c = common[codes]
            x = np.zeros((until - at, wide), np.float32)
            x[rows[c], place[codes[c]]] = 1
            shared = x @ y
            w = codes[~c]
            k_of = length[w]
            hit = np.repeat(start[w] - (np.cumsum(k_of) - k_of), k_of) + np.arange(k_of.sum())
            pair, times = np.unique(np.repeat(rows[~c], k_of) * len(rn) + lists[hit], return_counts=True)
            shared.reshape(-1)[pair] += times
            need = (share * ln[at:until]).astype(np.float32)[:, None] + (share * rn).astype(np.float32)
            i, j = np.nonzero((shared >= need) & (shared > 0))
            s = shared[i, j].astype(float)
            s /= ln[at + i] + rn[j] - s
            fit = s >= least - SLACK
            i, j, s = i[fit], j[fit], s[fit]
            if k is not None and len(i):
                best = np.lexsort((-s, i))
                first = np.searchsorted(i[best], i[best])
                kth = np.full(until - at, -1.0)
                last = np.arange(len(best)) - first == k - 1
                kth[i[best][last]] = s[best][last]
                fit = s >= kth[i]
                i, j, s = i[fit], j[fit], s[fit]
            row.append(at + i)
            col.append(j)
            out.append(s)
    return np.concatenate(row), np.concatenate(col), np.concatenate(out)


def ordered_pairs(rows: DataFrame, group: list[str], kind: str, at: str) -> DataFrame:
    """(first, then, n): how often a row of one kind stands before one of another (or the same) in its group, by ``at``.

    Rows of equal clocks are not in order. For each kind of a group the rows before a clock are a running count, so a
    group of n rows and k kinds costs n * k rows and a sort, not n * n pairs.
    """
    clock = F.col(at).cast("timestamp") if dict(rows.dtypes)[at] in ("date", "timestamp", "timestamp_ntz") else None
    counted = rows.select(*group, F.col(kind).alias("_kind"), (F.unix_micros(clock) if clock is not None else F.col(at)).alias("_at")).where("_at is not null").groupBy(*group, "_kind", "_at").agg(F.count(F.lit(1)).alias("_k"))
    # Null groups are no groups, as in a join.
    counted = counted.dropna(subset=group)
    kinds = counted.select(*group, F.col("_kind").alias("first")).distinct()
    asked = counted.join(kinds, group).select(*group, "_at", "first", F.col("_kind").alias("then"), F.col("_k").alias("_asked"), F.lit(0).cast("long").alias("_own"))
    told = counted.select(*group, "_at", F.col("_kind").alias("first"), F.lit(None).cast(dict(counted.dtypes)["_kind"]).alias("then"), F.lit(0).cast("long").alias("_asked"), F.col("_k").alias("_own"))
    before = F.sum("_own").over(Window.partitionBy(*group, "first").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1))
    return asked.unionByName(told).withColumn("_before", before).where("_asked > 0 and _before > 0").groupBy("first", "then").agg(F.sum(F.col("_asked") * F.col("_before")).alias("n"))
