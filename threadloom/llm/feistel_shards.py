"""Sharding by a keyed permutation of global row numbers, in DataFrame functions only.

Rows are numbered without gaps in key order. A Feistel network over Z_a x Z_b (a*b just over the row count) permutes
the numbers; a value outside the row count walks on along its cycle until it is inside. The permuted number p gives
shard p mod S and slot p div S: shard sizes differ by one at most, slots have no gaps, and both can be computed from
the row number alone.

Null texts have no bytes. Null keys are numbered first, equal keys next to each other in the order of their texts'
checksums; rows that agree in all of these are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialize

SEED = 20240229
RANGE_ROWS = 10_000_000
ROUNDS = 6


def feistel(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of the network: a bijection of 0 .. a*b-1, a and b from ``domain(n)``."""
    a, b = domain(n)
    left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b))
    for r in range(rounds):
        if r % 2:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(r)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(r)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def walked(once: Column, n: int, seed: int = SEED) -> Column:
    """Cycle walking: ``once`` (a first pass) if it is under n, else the first value under n on its cycle.

    A walk meets each of the a*b - n values outside at most once, which bounds the loop; it runs only for the few rows
    that the first pass leaves outside.
    """
    a, b = domain(n)
    if a * b == n:
        return once
    on = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), once, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed)))
    return F.when(once < n, once).otherwise(on)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_number`` from 0 in this order, and how many there are.

    The rows are sorted into ranges of ``RANGE_ROWS`` or fewer and written once; the first number of a range is the count of rows in the ranges
    before it, from one count per range.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    at = F.monotonically_increasing_id()
    kept = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"range": F.shiftright(at, 33), "place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "row-numbers")
    sizes = kept.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    total = kept.count()
    return kept.join(F.broadcast(starts), "range").withColumn("row_number", F.col("start") + F.col("place")).drop("range", "place", "start"), total


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, row_number, shard, slot) per row. Texts are measured where they are read, never moved."""
    raw = F.encode(F.coalesce(docs[text].cast("string"), F.lit("")), "UTF-8")
    meta = docs.select(docs[key].alias(key), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, n = numbered(meta, [key, "text_crc32", "size"])
    placed = rows.withColumn("once", feistel(F.col("row_number"), n, seed)).withColumn("p", walked(F.col("once"), n, seed))
    return placed.select(key, "size", "text_crc32", "row_number", F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("p") / shards).cast("long").alias("slot"))
