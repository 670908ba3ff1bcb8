"""Near duplicates by SimHash, with pivot distance tables.

Equal fingerprints are first folded into one. Fingerprints within ``RADIUS`` bits agree wholly in two of six blocks of
bits, so they meet in a bucket of one of the fifteen pairs of blocks. Inside a bucket each fingerprint's Hamming
distances to fixed reference fingerprints are known; by the triangle inequality a pair whose distances to some
reference differ by more than ``RADIUS`` is discarded, survivors are verified bit by bit. A bucket hands on a forest
of links, not all pairs; components of the forests are those of all links.

Buckets over ``TILE`` fingerprints are split into tiles and each pair of tiles is compared on its own, so no task holds
more than two tiles of a bucket.

Null and empty texts have fingerprint zero and link like any other. Texts under four words have one shingle. Repeated
rows share a fingerprint. Rows with a null id keep a fingerprint and take part, but never name a component unless
alone. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, slices, text_or_empty
from threadloom.llm.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 4096
PIVOTS = 24
SMALL = 48
# Six blocks of a 64-bit fingerprint: (first bit, bits).
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: str) -> int:
    """Bit i is set if over half of the shingle hashes set it."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))) or [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) per row; fp is the 64-bit fingerprint as a signed integer."""
    types = dict(docs.dtypes)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            prints = np.array([fingerprint(t) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["key", "fp"])

    return docs.select(docs[key].alias("key"), text_or_empty(text)).mapInArrow(run, f"key {types[key]}, fp bigint").withColumnRenamed("key", key)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: masks of 32 set bits drawn once from a fixed seed."""
    rng = np.random.default_rng(20240101)
    bits = np.zeros((n, 64), dtype=np.uint8)
    for row in bits:
        row[rng.permutation(64)[:32]] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def distance_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """(pivots, n) Hamming distances."""
    return np.bitwise_count(prints[None, :] ^ refs[:, None]).astype(np.int8)


def _survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Positions of the pairs (a[i], b[i]) that no reference discards; references are asked one by one."""
    left = np.arange(len(a))
    for row in table:
        if not len(left):
            break
        left = left[np.abs(row[a[left]] - row[b[left]]) <= radius]
    return left


def bucket_links(prints: np.ndarray, radius: int = RADIUS, refs: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of links over one bucket (indices), by breadth-first search over what is not reached yet."""
    table = distance_table(prints, pivots() if refs is None else refs)
    waiting, links = np.arange(len(prints)), []
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            near = waiting[_survivors(table, np.full(len(waiting), at), waiting, radius)]
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= radius]
            if len(near):
                links += [(at, int(x)) for x in near]
                queue += near.tolist()
                waiting = waiting[~np.isin(waiting, near, assume_unique=True)]
    return links


def _sorted_links(keys: np.ndarray, prints: np.ndarray, refs: np.ndarray, radius: int = RADIUS):
    """Links of consecutive buckets (rows sorted by key): small buckets all at once, lag by lag; large ones searched."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        links = np.array(bucket_links(prints[s : s + n], radius=radius, refs=refs), dtype=np.int64).reshape(-1, 2) + s
        if len(links):
            yield prints[links[:, 0]], prints[links[:, 1]]
    small = np.repeat(sizes <= SMALL, sizes)
    table = distance_table(prints, refs)
    for lag in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        at = at[_survivors(table, at, at + lag, radius)]
        at = at[np.bitwise_count(prints[at] ^ prints[at + lag]) <= radius]
        if len(at):
            yield prints[at], prints[at + lag]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) links over distinct fingerprints (column fp) whose components are those of all pairs within ``radius``."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("blocks guarantee four differing bits at most")
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)) for first, bits in BLOCKS]
    pairs = [F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(block[i], 11)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    keyed = distinct.select("fp", F.explode(F.array(*pairs)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(sizes, "key")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    others = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(t, own).alias("a"), F.greatest(t, own).alias("b")))
    split = rows.select("fp", F.explode(others).alias("t"), "key").select("fp", F.xxhash64("key", "t.a", "t.b").alias("bucket"), "key", "t.a", "t.b")
    placed = split.select("fp", "bucket").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")

    def run(batches):
        import pyarrow as pa

        refs = pivots()

        def out(keys, prints):
            for a, b in _sorted_links(keys, prints, refs, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if batch.num_rows:
                prints = np.concatenate([prints, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
                keys = np.concatenate([keys, batch.column(1).to_numpy(zero_copy_only=False)])
                done = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if done:
                    yield from out(keys[:done], prints[:done])
                    keys, prints = keys[done:], prints[done:]
        if len(keys):
            yield from out(keys, prints)

    return placed.mapInArrow(run, "u bigint, v bigint").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint in hexadecimal digits, component_id) per row."""
    prints = materialize(fingerprint_documents(docs, key, text), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    roots = connected_components(link_fingerprints(distinct.select("fp"), radius))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", find=classes) -> DataFrame:
    """The rows of ``docs``, all columns, with the least id of their class; of rows with that same id one stays.

    Classes without any id keep one row. ``find`` (docs, key, text) gives every row's class as ``classes`` does.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if ids["n"] == ids["d"]:
        keepers = find(docs, key, text).where(F.col(key) == F.col("component_id")).select(key)
        return docs.join(keepers, key, "left_semi").select(*docs.columns)
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    table = find(rows.select(row, text), row, text).select(F.col(row).alias("_member"), "component_id")
    own = rows.select(F.col(row).alias("_number"), F.col(key).alias("_id"))
    first = own.join(table, F.col("_number") == F.col("_member")).groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_number")).alias("least"))
    return rows.join(first.select(F.col("least._number").alias(row)), row, "left_semi").select(*docs.columns)
