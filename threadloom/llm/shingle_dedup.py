"""SimHash near duplicates at five words and a Jaccard similarity of ``SIMILARITY``, for corpora.

Four bits of 64, the radius that blocks of bits guarantee, are far too few for similarity 0.8. So here fingerprints have
128 bits and pairs count as candidates up to ``RADIUS`` bits (a pair of similarity 0.8 differs in 20 bits or so, the
standard deviation is 4; over 40 lie at most 1e-6 of such pairs). Sets under ``SMALL`` shingles spread wider, so a pair
with one has ``SMALL_RADIUS`` (nine deviations). Fingerprints meet in ``BANDS`` buckets of ``ROWS`` min-hashes each, which lose a pair of
similarity 0.8 with probability (1 - 0.8**4)**32 < 5e-8. In a bucket, pivot distance tables discard pairs, Hamming
distances the next, and the exact Jaccard similarity of the sets of five-word shingles decides.

Texts with equal sets are first folded into one. Each member of a bucket is compared with its least member, by pivots
and distance there too. Buckets
whose members are then still in different components get their members' shingles, and a task compares all pairs of a
bucket that are in different components where it holds them; it hands on a forest of links between components, never
pairs. Buckets over ``TILE`` members or ``TILE_BYTES`` of shingles are split, and every two tiles meet in a group of their own. A member that many are
compared with is copied to many tasks.

What buckets and radius lose is found exactly (``links_beyond``). Of a set of n shingles a similar one lacks a fifth at
most; so, shingles taken in any one order, the first n // 5 + k of both share k. First the order is that of the hashes: a
set stays if it shares as many of its first as it must with sets of other components. Those that stay are few; their
shingles are then ordered by how many sets have them, sets that meet in one of their first n // 5 + 1 are pairs. Pivot
tables of the votes, distances that bound the symmetric difference, discard pairs without loss, and the exact similarity
decides. Shingles are compared by their 64-bit hashes, and in the first step by 48 bits of them, where
equal ones only let more sets stay.

Words are those of ``simhash_dedup``. Texts under five words have one shingle, the whole text. Null and empty
texts have equal sets. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import simhash_dedup
from threadloom.llm.common import materialize, slices, text_or_empty
from threadloom.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
RADIUS = 40
SMALL = 8
SMALL_RADIUS = 64
TILE = 1024
TILE_BYTES = 32 << 20
COLUMNS = 2048
PAIRS_PER_COPY = 512
LACK = 5  # a set of similarity 0.8 lacks one in so many shingles at most
SPARE = 16  # one in so many is looked at beyond those
PART_TOKENS = 1 << 20
DEALT_ROWS = 8192
DEALT_BYTES = 8 << 20
HALVES = 16
SIZES = 1.05
TOKEN_BYTES = 6
SEED = 42
_RNG = np.random.default_rng(20240102)
_MUL = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    import xxhash

    words = text.encode().lower().split()
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))) or [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def band_keys(own: np.ndarray) -> list[int]:
    """One signed 64-bit key a band."""
    import xxhash

    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024] * _MUL + _ADD).min(axis=1), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) - 2**63 for k in range(BANDS)]


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of a set of shingle hashes, as two signed integers."""
    votes = np.zeros(128, dtype=np.int64)
    for at in range(0, len(own), 1 << 15):
        part = own[at : at + (1 << 15)]
        both = np.stack([part, part * _MUL[0] + (part >> np.uint64(29)) * _MUL[1]], axis=1)
        votes += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * votes > len(own), bitorder="little").view("<i8").tolist())


def shared_first(n):
    """How many of their first ``n // LACK`` and so many shingles more two similar sets share, if the lesser has ``n``."""
    return np.maximum(1, n // SPARE)


def first_tokens(own: np.ndarray) -> bytes:
    """The first shingles of a set, ``TOKEN_BYTES`` of each, mixed so that they fill their range evenly."""
    first = own[: len(own) // LACK + int(shared_first(len(own)))] * _MUL[2]
    return first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES :].tobytes()


def sign_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sig, n, lo, hi, bands, first) per row: a hash of the whole set, its size, its fingerprint, the keys of its
    bands and its first shingles."""
    types = dict(docs.dtypes)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for part in slices(batches):
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            sigs = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - 2**63 for s in sets], pa.int64())
            lo, hi = np.array([fingerprint(s) for s in sets], dtype=np.int64).reshape(-1, 2).T.copy()
            yield pa.RecordBatch.from_arrays([part.column(0), sigs, pa.array([len(s) for s in sets], pa.int64()), pa.array(lo), pa.array(hi), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array([first_tokens(s) for s in sets], pa.binary())], ["key", "sig", "n", "lo", "hi", "bands", "first"])

    return docs.select(docs[key].alias("key"), text_or_empty(text)).mapInArrow(run, f"key {types[key]}, sig bigint, n bigint, lo bigint, hi bigint, bands array<bigint>, first binary").withColumnRenamed("key", key)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts (node, text) reach the similarity. The text of a node u with many pairs is copied,
    so that each ``PAIRS_PER_COPY`` of them can meet it apart."""
    kind = dict(texts.dtypes)["node"]

    def run(batches):
        import pyarrow as pa

        last, own = None, None
        for part in slices(batches):
            near = []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if own is None or a != last:
                    last, own = a, shingle_set(a)
                near.append(similarity(own, shingle_set(b)) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    copies = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_COPY).cast("int").alias("copies"))
    left = copies.join(texts.withColumnRenamed("node", "u"), "u").select("u", F.col("text").alias("a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(copies, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int").alias("copy"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return dealt.join(right, "v").join(left, ["u", "copy"]).select("u", "v", "a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def pivots() -> np.ndarray:
    """Reference fingerprints (pivots, 2) of 128 bits."""
    return np.random.default_rng(20240101).integers(0, 2**64, (simhash_dedup.PIVOTS, 2), dtype=np.uint64)


def _pairs_apart(roots: np.ndarray, prints: np.ndarray, small: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs in one bucket with different roots and as few differing bits as their sizes ask for."""
    table = np.bitwise_count(prints[None] ^ refs[:, None]).sum(axis=2, dtype=np.int16)
    left, right = [], []
    for at in range(len(roots) - 1):
        near = at + 1 + np.flatnonzero(roots[at + 1 :] != roots[at])
        radius = np.where(small | small[at], SMALL_RADIUS, RADIUS)
        for row in table:
            near = near[np.abs(row[near] - row[at]) <= radius[near]]
        near = near[np.bitwise_count(prints[near] ^ prints[at]).sum(axis=1) <= radius[near]]
        left.append(np.full(len(near), at))
        right.append(near)
    return np.concatenate(left), np.concatenate(right)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1  # what stands in one set only is in no intersection
    at, column = at[common], (np.cumsum(count > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        dense = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        dense[at[a:b], column[a:b] - low] = 1
        out += dense @ dense.T
    return out.astype(np.float64)


def forest_apart(roots: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], refs: np.ndarray) -> list[tuple[int, int]]:
    """A forest of links between different roots (numbers) of one bucket: pairs that pivots, Hamming distance and the exact
    similarity let pass."""
    left, right = _pairs_apart(roots, prints, np.array([len(s) < SMALL for s in sets], dtype=bool), refs)
    if not len(left):
        return []
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = place[: len(left)], place[len(left) :]
    size = np.array([len(sets[k]) for k in used.tolist()], dtype=np.float64)
    shared = _shared([sets[k] for k in used.tolist()])[i, j]
    near = shared / (size[i] + size[j] - shared) >= SIMILARITY
    parent, forest = {}, []

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in np.unique(np.sort(np.stack([roots[left[near]], roots[right[near]]], axis=1), axis=1), axis=0).tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.append((a, b))
    return forest


def close_prints(a: str, b: str) -> Column:
    """Whether the fingerprints (n, lo, hi) under two prefixes can be near: first their distances to the pivots, then
    their own."""
    radius = F.when(F.least(a + "n", b + "n") < SMALL, SMALL_RADIUS).otherwise(RADIUS)
    apart = lambda of, lo, hi: F.bit_count(F.col(of + "lo").bitwiseXOR(lo)) + F.bit_count(F.col(of + "hi").bitwiseXOR(hi))
    out = F.lit(True)
    for lo, hi in pivots().view(np.int64).tolist():
        out = out & (F.abs(apart(a, F.lit(lo), F.lit(hi)) - apart(b, F.lit(lo), F.lit(hi))) <= radius)
    return out & (apart(a, F.col(b + "lo"), F.col(b + "hi")) <= radius)


def links_apart(open_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct links (u, v) between the roots of members that meet in a bucket and reach the similarity, among
    (band, node, root, n, lo, hi); ``texts`` are (node, text)."""
    kind = dict(open_rows.dtypes)["node"]

    def shingles(batches):
        import pyarrow as pa

        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["node", "grams"])

    grams = texts.join(open_rows.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(shingles, f"node {kind}, grams binary")
    sizes = open_rows.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("a"), F.greatest(t, own).alias("b")))
    split = open_rows.join(sizes, "band").select("node", "root", "lo", "hi", "band", F.explode(others).alias("t"))
    buckets = split.select("node", "root", "lo", "hi", F.xxhash64("band", "t.a", "t.b").alias("bucket")).join(grams, "node")

    def run(key, table):
        import pyarrow as pa

        rows = table.combine_chunks()
        names = rows.column("root").chunk(0).dictionary_encode() if rows.num_rows else None
        links = []
        if names is not None and len(names.dictionary) > 1:
            prints = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi")], axis=1)
            sets = [np.frombuffer(g, dtype=np.uint64) for g in rows.column("grams").to_pylist()]
            links = forest_apart(names.indices.to_numpy(), prints, sets, pivots())
        node_type = rows.schema.field("root").type
        of = (lambda side: names.dictionary.take(pa.array([x[side] for x in links], pa.int64()))) if links else (lambda side: pa.array([], node_type))
        return pa.table({"u": of(0), "v": of(1)})

    found = buckets.select("bucket", "root", "lo", "hi", "grams").groupBy("bucket").applyInArrow(run, f"u {kind}, v {kind}")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _tokens(blobs: list[bytes]) -> np.ndarray:
    """What ``first_tokens`` wrote, as numbers."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, TOKEN_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - TOKEN_BYTES :] = raw
    return out.view("<u8").ravel()


def _by_token(tokens: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by token and label, where tokens begin, whether a token stands under several labels)."""
    order = np.lexsort((labels, tokens))
    tokens, labels = tokens[order], labels[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return order, starts, labels[starts] != labels[np.append(starts[1:], len(tokens)) - 1]


def may_have_more(sets: DataFrame, parts: int) -> DataFrame:
    """(sig) of the sets (sig, label, n, first) that share as many first shingles with sets of other labels as a similar
    set asks for.

    Tokens travel packed, dealt by their value. Of a token under several labels in one batch two rows tell the others;
    the rest are counted where they are, so a common token is a few rows from each batch.
    """

    def bounded(batches):
        import pyarrow.compute as pc

        for part in slices(batches, DEALT_ROWS):
            filled = np.cumsum(pc.binary_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)) // DEALT_BYTES
            cuts = [0, *(np.flatnonzero(filled[1:] != filled[:-1]) + 1).tolist(), part.num_rows]
            yield from (part.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    def deal(batches):
        import pyarrow as pa

        for part in bounded(batches):
            sigs, labels = (part.column(k).to_numpy() for k in (0, 1))
            blobs = part.column(2).to_pylist()
            tokens = _tokens(blobs)
            owner = np.repeat(np.arange(len(sigs)), [len(b) // TOKEN_BYTES for b in blobs])
            order, starts, open_ = _by_token(tokens, labels[owner])
            tokens, owner = tokens[order], owner[order]
            ends = np.append(starts[1:], len(tokens))
            sent = np.repeat(~open_, ends - starts)
            sent[starts] = sent[ends - 1] = True
            here = np.bincount(owner[~sent], minlength=len(sigs))
            tokens, owner = tokens[sent], owner[sent]
            cuts = np.searchsorted((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            rows = [(0, b"", b"", sigs[here > 0].tobytes(), here[here > 0].astype(np.int64).tobytes())]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                used, place = np.unique(owner[cuts[k] : cuts[k + 1]], return_inverse=True)
                raw = np.ascontiguousarray(tokens[cuts[k] : cuts[k + 1]]).view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES :]
                rows.append((k, raw.tobytes(), place.astype(np.uint16).tobytes(), sigs[used].tobytes(), (labels[used] ^ sigs[used]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["part", "tokens", "place", "sigs", "labels"])

    def meet(batches):
        import pyarrow as pa

        out = lambda sigs, counts: pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(counts, pa.int64())], ["sig", "shared"])
        blobs, sigs, labels = [], [], []
        for part in slices(batches, 64):
            for raw, place, own, other in zip(*(part.column(k).to_pylist() for k in range(4))):
                own, other, place = np.frombuffer(own, np.int64), np.frombuffer(other, np.int64), np.frombuffer(place, np.uint16)
                if raw:
                    blobs.append(raw)
                    sigs.append(own[place])
                    labels.append((own ^ other)[place])
                else:
                    yield out(own, other)
        if blobs:
            sigs = np.concatenate(sigs)
            order, starts, open_ = _by_token(_tokens(blobs), np.concatenate(labels))
            shared = np.repeat(open_, np.diff(np.append(starts, len(order))))
            yield out(*np.unique(sigs[order[shared]], return_counts=True))

    dealt = sets.select("sig", "label", "first").mapInArrow(deal, "part int, tokens binary, place binary, sigs binary, labels binary")
    met = dealt.repartitionById(parts, F.col("part")).drop("part").mapInArrow(meet, "sig bigint, shared bigint")
    least = F.expr(f"greatest(1, (n - n div {LACK}) div {SPARE})")  # what the least similar set asks for
    return met.groupBy("sig").agg(F.sum("shared").alias("shared")).join(sets.select("sig", "n"), "sig").where(F.col("shared") >= least).select("sig")


def half_counts(own: np.ndarray) -> list[int]:
    """How many shingles have each of ``HALVES`` bits set: the votes of a fingerprint before they become signs."""
    return np.unpackbits(own.view(np.uint8).reshape(-1, 8)[:, : HALVES // 8], axis=1, bitorder="little").sum(axis=0).tolist()


def pairs_beyond(sets: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of sets (node, label, n, halves, grams) of different labels that can be similar: those that
    meet in one of their rarest shingles, with enough shingles behind it. A shingle of many sets meets tile by tile
    and by classes of sizes.

    Similar sets of m and n shingles have 4/9 of m + n in common at least, so 1/9 apart. The shingles with a bit set are
    a pivot, from which a set's distance (of symmetric difference) is known up to a constant by ``half_counts``; by the
    triangle inequality no similar pair is lost.
    """
    grams = sets.select("node", "label", "n", F.explode("grams").alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("gram", "sets")
    own = grams.join(held, "gram").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "gram"))).alias("own"))
    alone = F.col("n") - F.size("own")  # shingles of no other set come first
    first = own.withColumn("alone", alone).where(f"alone <= n div {LACK}").select("node", "label", "n", "alone", F.posexplode(F.expr(f"slice(own, 1, cast(n div {LACK} + 1 - alone as int)).gram")).alias("at", "gram"))
    rare = materialize(first.join(sets.select("node", "halves"), "node").select("node", "label", "gram", F.struct("n", (F.col("n") - F.col("alone") - F.col("at")).alias("behind"), "halves").alias("of")), "rare-shingles")
    sizes = rare.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiled = rare.join(sizes.select("gram", "tiles"), "gram").select("node", "label", "of", "gram", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    size = lambda n: F.floor(F.log(n) / F.log(F.lit(SIZES))).cast("int")
    # The lesser set of a pair has four fifths of the greater at least, and as few as what stands behind the shingle asks for.
    least, most = F.expr(f"of.n - of.n div {LACK}"), F.expr("least(of.n, 9 * of.behind div 4 - of.n)")
    greater = tiled.where(least <= most).withColumn("size", F.explode(F.sequence(size(least), size(most))))
    left = greater.select(F.col("node").alias("u"), F.col("label").alias("a"), F.col("of").alias("x"), "gram", "tile", "other", "size")
    right = tiled.select(F.col("node").alias("v"), F.col("label").alias("b"), F.col("of").alias("y"), "gram", F.col("other").alias("tile"), F.col("tile").alias("other"), size(F.col("of.n")).alias("size"))
    both = F.col("x.n") + F.col("y.n")
    near = ((F.col("y.n") < F.col("x.n")) | (F.col("y.n") == F.col("x.n")) & (F.col("u") < F.col("v"))) & (F.col("a") != F.col("b")) & (9 * F.least("x.behind", "y.behind") >= 4 * both)
    for k in range(HALVES):
        near = near & (9 * F.abs((F.col("x.n") - 2 * F.col("x.halves")[k]) - (F.col("y.n") - 2 * F.col("y.halves")[k])) <= both)
    return left.join(right, ["gram", "tile", "other", "size"]).where(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def links_beyond(docs: DataFrame, prints: DataFrame, roots: DataFrame, key: str, text: str) -> DataFrame:
    """Links (u, v) between similar texts that are in different components of ``roots`` (node, root): all there are."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    heads = materialize(prints.groupBy("sig").agg(F.min(key).alias("node")), "heads")
    labels = roots.join(heads, "node").select("sig", "root").join(heads.select(F.col("node").alias("root"), F.col("sig").alias("label")), "root").select("sig", "label")
    sets = prints.groupBy("sig").agg(F.first("n").alias("n"), F.first("first").alias("first")).join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    parts = max((prints.agg(F.sum("n")).first()[0] or 0) // LACK // PART_TOKENS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = materialize(may_have_more(sets, parts).join(heads, "sig").join(labels, "sig", "left").select("node", F.coalesce("label", "sig").alias("label")), "sets-left")
    if left.isEmpty():
        return spark.createDataFrame([], f"u {kind}, v {kind}")
    texts = materialize(docs.select(docs[key].alias("node"), text_or_empty(text)).join(left, "node").select("node", "label", "text"), "texts-left")

    def shingles(batches):
        import pyarrow as pa

        for part in slices(batches):
            sets = [shingle_set(t) for t in part.column(2).to_pylist()]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([half_counts(s) for s in sets], pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["node", "label", "n", "halves", "grams"])

    grams = materialize(texts.mapInArrow(shingles, f"node {kind}, label bigint, n bigint, halves array<bigint>, grams array<bigint>"), "grams-left")
    pairs = materialize(pairs_beyond(grams), "pairs-beyond")
    return materialize(verified(pairs, texts.select("node", "text")), "links-beyond")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) per row; keys must be unique and not null. A component's name is its least key."""
    prints = materialize(sign_documents(docs, key, text), "shingle-signs")
    distinct = prints.groupBy("sig").agg(F.min(key).alias("node"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    keyed = distinct.select("node", "n", "lo", "hi", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "n", "lo", "hi")).alias("least")).where("n > 1").select("band", "least")
    met = materialize(keyed.join(shared, "band"), "shared-bands")
    texts = materialize(docs.select(docs[key].alias("node"), text_or_empty(text)).join(met.select("node").distinct(), "node", "left_semi"), "shared-texts")
    stars = materialize(met.where((F.col("node") != F.col("least.node")) & close_prints("", "least.")).select(F.col("least.node").alias("u"), F.col("node").alias("v")).distinct(), "star-pairs")
    links = materialize(verified(stars, texts), "star-links")
    placed = met.join(connected_components(links), "node", "left").select("band", "node", "n", "lo", "hi", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    open_rows = materialize(placed.join(mixed, "band", "left_semi"), "open-bands")
    more = materialize(links_apart(open_rows, texts), "more-links")
    roots = connected_components(links.union(more))
    beyond = links_beyond(docs, prints, roots, key, text)
    if not beyond.isEmpty():
        roots = connected_components(links.union(more).union(beyond))
    named = prints.groupBy("sig").agg(F.min(key).alias("node")).join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("component_id"))
    return prints.select(key, "sig").join(named, "sig").select(key, "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the least id of their class, as ``simhash_dedup.keep_one`` keeps them."""
    return simhash_dedup.keep_one(docs, key, text, find=classes)
