"""How far the sources of a language differ in their terms: a recount over minimal perfect hashes.

First pass: in how many documents of its language each term stands, exactly; terms under the floor go. The kept terms
are dealt into shards, and every shard gets a minimal perfect hash of its own: levels of bit tables, a key taking the
first level where nothing else falls on its place, and the keys themselves in slot order. Second pass: every task gets
the shards as broadcasts, in rounds of ``ROUND_BYTES`` or one shard, looks its terms up, compares the stored key, and
adds to one dense row of slots for each (lang, source) group. Nothing depends on hashes being free of collisions: keys
that no level parts are listed, and a term that was not kept fails the comparison.

Sums of slots then give every group's smoothed shares; distances between sources are summed shard by shard and tile by
tile (``TILE`` sources), so a task holds two tiles of one shard.

Null texts, languages and sources are ''. Groups without terms take part with zero counts; a language without kept
terms gives pairs of value 0. Terms of any length are kept whole. Equal rows count as often as they stand there; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, slices, text_or_empty

FLOOR = 30
ADD = 5
SCALE = 1_000_000_000
TOP = 50
SHARD_TERMS = 8192
ROUND_BYTES = 48 << 20
LEVELS = 24
ROOM = 2.0
TILE = 128
HELD = 300_000
SLOTS = 4 << 20
SLICE_BYTES = 1 << 20

# Letters A to Z in lower case; what is neither an ASCII letter nor outside ASCII parts terms.
_BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
_TERMS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in bytes(range(256)).lower())


def terms_of(text: str):
    """Lists of a text's terms as UTF-8 bytes, in bounded pieces."""
    data = text.encode()
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE_BYTES:
            end = hit.start() if (hit := _BREAK.search(data, at + SLICE_BYTES)) else end
        yield data[at:end].translate(_TERMS).split()
        at = end


# --- perfect hashing ---


def digests(terms: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class PerfectHash:
    """A bijection of a shard's keys onto slots 0 .. n-1, with the keys in slot order."""

    def __init__(self, sizes: list[int], table: np.ndarray, keys: list[bytes], listed: dict[bytes, int]):
        self.sizes, self.table, self.keys, self.listed = sizes, table, keys, listed

    @classmethod
    def build(cls, terms: list[bytes]) -> PerfectHash:
        h = digests(terms)
        left = np.arange(len(terms))
        sizes, tables, order = [], [], []
        while len(left) and len(sizes) < LEVELS:
            size = int(ROOM * len(left)) + 1
            at = (_mixed(h[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            table = np.zeros(size, bool)
            table[at[alone]] = True
            order.append(left[alone][np.argsort(at[alone])])
            sizes.append(size)
            tables.append(table)
            left = left[~alone]
        place = np.concatenate([*order, left]).astype(np.int64)
        keys = [terms[i] for i in place.tolist()]
        return cls(sizes, np.concatenate(tables) if tables else np.zeros(0, bool), keys, {terms[i]: len(keys) - len(left) + k for k, i in enumerate(left.tolist())})

    def dump(self) -> bytes:
        return pickle.dumps((self.sizes, np.packbits(self.table).tobytes(), len(self.table), self.keys, self.listed), protocol=5)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        sizes, bits, n, keys, listed = pickle.loads(blob)
        return cls(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool), keys, listed)


class ShardedHash:
    """The hashes of some shards of one language, looked up together; slots are numbered through."""

    def __init__(self, shards: int, parts: dict[int, PerfectHash]):
        self.shards = shards
        self.numbers = sorted(parts)
        self.first = {}
        self.size = np.zeros((LEVELS, shards), np.uint64)
        self.off = np.zeros((LEVELS, shards), np.int64)
        tables, self.keys, self.listed, at = [], [], {}, 0
        for s in self.numbers:
            p = parts[s]
            self.first[s] = len(self.keys)
            for level, size in enumerate(p.sizes):
                self.size[level, s], self.off[level, s] = size, at
                at += size
            slots = np.full(len(p.table), -1, np.int32)
            slots[p.table] = len(self.keys) + np.arange(int(p.table.sum()), dtype=np.int32)
            tables.append(slots)
            self.listed |= {t: len(self.keys) + k for t, k in p.listed.items()}
            self.keys += p.keys
        self.slot_at = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def find(self, terms: list[bytes]) -> np.ndarray:
        """Slots of ``terms``; -1 where the stored key is another one."""
        h = digests(terms)
        shard = (h % np.uint64(self.shards)).astype(np.int64)
        slots = np.full(len(terms), -1, np.int64)
        left = np.arange(len(terms))
        for level in range(LEVELS):
            size = self.size[level, shard[left]]
            left = left[size > 0]
            if not len(left):
                break
            at = self.off[level, shard[left]] + (_mixed(h[left], level) % size[size > 0]).astype(np.int64)
            slots[left] = self.slot_at[at]
            left = left[slots[left] < 0]
        keys = self.keys
        right = np.fromiter((s >= 0 and keys[s] == t for s, t in zip(slots.tolist(), terms)), bool, len(terms))
        slots[~right] = -1
        if self.listed:
            for i in np.flatnonzero(~right).tolist():
                slots[i] = self.listed.get(terms[i], -1)
        return slots


# --- first pass ---


def kept_terms(docs: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(lang, term as bytes, docs): terms in ``floor`` documents of their language or more. Tasks hand on partial counts."""

    def run(batches):
        import pyarrow as pa

        def out(counts):
            n = sum(map(len, counts.values()))
            langs = pa.array(np.repeat(np.array(list(counts), dtype=object), [len(c) for c in counts.values()]).tolist(), pa.string())
            terms = pa.array([t for c in counts.values() for t in c], pa.binary())
            return pa.RecordBatch.from_arrays([langs, terms, pa.array([v for c in counts.values() for v in c.values()], pa.int64())], ["lang", "term", "docs"]) if n else None

        counts: defaultdict[str, Counter] = defaultdict(Counter)
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen: set[bytes] = set()
                for terms in terms_of(text):
                    seen.update(terms)
                counts[lang].update(seen)
            if sum(map(len, counts.values())) > HELD:
                yield out(counts)
                counts.clear()
        if counts and (batch := out(counts)):
            yield batch

    found = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, docs bigint")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= floor)


def shard_hashes(kept: DataFrame, terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, shards, shard, terms, bytes, blob): a perfect hash for about ``terms`` kept terms each."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / terms).cast("int").alias("shards"))

    def deal(batches):
        import pyarrow as pa

        for part in batches:
            shards = part.column(1).to_numpy(zero_copy_only=False)
            at = (digests(part.column(2).to_pylist()) % shards.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at), part.column(2)], ["lang", "shards", "shard", "term"])

    def build(table):
        import pyarrow as pa

        one = PerfectHash.build(sorted(table["term"].to_pylist()))
        blob = one.dump()
        return pa.table([table["lang"][:1], table["shards"][:1], table["shard"][:1], pa.array([len(one.keys)], pa.int64()), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], ["lang", "shards", "shard", "terms", "bytes", "blob"])

    dealt = kept.join(sizes, "lang").select("lang", "shards", "term").mapInArrow(deal, "lang string, shards int, shard int, term binary")
    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shards int, shard int, terms bigint, bytes bigint, blob binary")


def rounds_of(sizes: list[tuple[str, int, int]], limit: int) -> list[list[tuple[str, int]]]:
    """(lang, shard) of each round, by (lang, shard, bytes): ``limit`` bytes or a single shard."""
    out, held = [], 0
    for lang, shard, n in sorted(sizes):
        if not out or held + n > limit:
            out.append([])
            held = 0
        out[-1].append((lang, shard))
        held += n
    return out


# --- second pass ---


def recount(docs: DataFrame, hashes: DataFrame, limit: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, shard, slots, counts): what stands in a group's row of slots, dense in the task, packed for the way.

    Each round reads the texts once and holds its shards as a broadcast of ``limit`` bytes or a single shard.
    """
    spark = docs.sparkSession
    sizes = [(r["lang"], r["shard"], r["bytes"]) for r in hashes.select("lang", "shard", "bytes").collect()]
    done = None
    for these in rounds_of(sizes, limit):
        low, high = these[0], these[-1]
        key, of = F.struct("lang", "shard"), lambda x: F.struct(F.lit(x[0]).alias("lang"), F.lit(x[1]).cast("int").alias("shard"))
        rows = hashes.where((key >= of(low)) & (key <= of(high))).select("lang", "shards", "shard", "blob").collect()
        shared = spark.sparkContext.broadcast([(r["lang"], r["shards"], r["shard"], bytes(r["blob"])) for r in rows])
        part = materialize(_summed(docs.select("lang", "source", "text").mapInArrow(_counter(shared), _PACKED)), "recount")
        shared.destroy()
        done = part if done is None else done.unionByName(part)
    return done if done is not None else spark.createDataFrame([], _PACKED)


_PACKED = "lang string, source string, shard int, slots binary, counts binary"


def _counter(shared):
    def run(batches):
        import pyarrow as pa

        by_lang: defaultdict[str, dict] = defaultdict(dict)
        shards = {}
        for lang, n, shard, blob in shared.value:
            by_lang[lang][shard] = PerfectHash.load(blob)
            shards[lang] = n
        hashes = {lang: ShardedHash(shards[lang], parts) for lang, parts in by_lang.items()}
        counts: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
        dense: dict[tuple[str, str], np.ndarray] = {}

        def add():
            for (lang, source), c in counts.items():
                terms = list(c)
                slots = hashes[lang].find(terms)
                row = dense.setdefault((lang, source), np.zeros(len(hashes[lang].keys), np.int64))
                own = slots >= 0
                row[slots[own]] += np.fromiter(c.values(), np.int64, len(terms))[own]  # terms are distinct, so are their slots
            counts.clear()

        def out():
            rows = []
            for (lang, source), row in dense.items():
                ends = [*hashes[lang].first.values(), len(row)]
                for shard, a, b in zip(hashes[lang].numbers, ends, ends[1:]):
                    at = np.flatnonzero(row[a:b])
                    if len(at):
                        rows.append((lang, source, shard, at.astype("<i4").tobytes(), row[a:b][at].astype("<i8").tobytes()))
            dense.clear()
            kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["lang", "source", "shard", "slots", "counts"])

        for part in slices(batches):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                if lang in hashes:
                    c = counts[lang, source]
                    for terms in terms_of(text):
                        c.update(terms)
            if sum(map(len, counts.values())) > HELD:
                add()
                if sum(map(len, dense.values())) > SLOTS:
                    yield out()
        add()
        if dense:
            yield out()

    return run


def _summed(packed: DataFrame) -> DataFrame:
    """One row for each (lang, source, shard). Rows of a key come sorted and are added as they come; keys are salted first,
    so a source that every task has seen is added up by many tasks."""
    for salted in (True, False):
        by = ["lang", "source", "shard", *(["salt"] if salted else [])]
        rows = packed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))) if salted else packed
        parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        packed = rows.repartition(parts, *by).sortWithinPartitions(*by).select("lang", "source", "shard", "slots", "counts").mapInArrow(_add_rows, _PACKED)
    return packed


def _add_rows(batches):
    import pyarrow as pa

    def row(key, total):
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([key[2]], pa.int32()), pa.array([at.astype("<i4").tobytes()]), pa.array([total[at].astype("<i8").tobytes()])], ["lang", "source", "shard", "slots", "counts"])

    key, total = None, np.zeros(0, np.int64)
    for part in slices(batches, 64):
        for lang, source, shard, slots, counts in zip(*(part.column(i).to_pylist() for i in range(5))):
            if (lang, source, shard) != key:
                if key:
                    yield row(key, total)
                key, total = (lang, source, shard), np.zeros(0, np.int64)
            at = np.frombuffer(slots, "<i4")
            if len(at) and at[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
            total[at] += np.frombuffer(counts, "<i8")
    if key:
        yield row(key, total)


# --- shares and distances ---


def smoothed(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADD) / (total + ADD * terms)), exact: a long division with steps of a thousand."""
    whole = int(total) + ADD * int(terms)
    if whole * 1000 < 1 << 62:
        rest, out = counts.astype(np.int64) + ADD, np.zeros(counts.shape, np.int64)
        for _ in range(3):
            rest = rest * 1000
            out = out * 1000 + rest // whole
            rest = rest % whole
        return out + 1
    return np.array([1 + SCALE * (int(c) + ADD) // whole for c in counts.ravel()], np.int64).reshape(counts.shape)


def _row_of(slots: bytes | None, counts: bytes | None, n: int) -> np.ndarray:
    row = np.zeros(n, np.int64)
    if slots:
        row[np.frombuffer(slots, "<i4")] = np.frombuffer(counts, "<i8")
    return row


def _distances(table):
    """Partial distances of two tiles of sources over one shard."""
    import pyarrow as pa

    n, v = table["terms"][0].as_py(), table["v"][0].as_py()
    rows = sorted(zip(*(table[c].to_pylist() for c in ("source", "tile", "slots", "counts", "total"))), key=lambda r: (r[1], r[0].encode()))
    low, high = table["a"][0].as_py(), table["b"][0].as_py()
    shares = [smoothed(_row_of(r[2], r[3], n), r[4], v) for r in rows]
    names, tiles = [r[0] for r in rows], [r[1] for r in rows]
    left = [i for i, t in enumerate(tiles) if t == low]
    right = [i for i, t in enumerate(tiles) if t == high]
    block = np.stack([shares[i] for i in right]) if right else np.zeros((0, n), np.int64)
    source, item, value = [], [], []
    for i in left:
        apart = np.abs(block - shares[i]).sum(axis=1)
        for k, j in enumerate(right):
            if i < j:
                source += [names[i], names[j]]
                item += [names[j], names[i]]
                value += [int(apart[k])] * 2
    return pa.table([pa.array([table["lang"][0].as_py()] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def _telling(rows, whole):
    """A source's own terms of one shard: its ``TOP`` highest differences from the language."""
    import pyarrow as pa

    lang, source, item, value = [], [], [], []
    if rows.num_rows and whole.num_rows:
        w = whole.slice(0, 1).to_pylist()[0]
        keys, n = PerfectHash.load(w["blob"]).keys, w["terms"]
        q = smoothed(_row_of(w["slots"], w["counts"], n), w["total"], w["v"])
        for r in rows.to_pylist():
            at = np.frombuffer(r["slots"], "<i4")
            over = smoothed(np.frombuffer(r["counts"], "<i8"), r["total"], w["v"]) - q[at]
            mine = np.flatnonzero(over > 0)
            if len(mine) > TOP:  # ties at the edge stay until terms decide
                mine = mine[over[mine] >= np.partition(over[mine], -TOP)[-TOP]]
            best = sorted((-int(over[i]), keys[at[i]]) for i in mine.tolist())[:TOP]
            lang += [w["lang"]] * len(best)
            source += [r["source"]] * len(best)
            item += [t.decode() for _, t in best]
            value += [-f for f, _ in best]
    return pa.table([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


_FOUND = "lang string, source string, item string, value bigint"


def audit_sources(docs: DataFrame, floor: int = FLOOR, shard_terms: int = SHARD_TERMS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and terms that tell a source."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text_or_empty())
    hashes = materialize(shard_hashes(kept_terms(read, floor), shard_terms), "perfect-hashes")
    counts = recount(read, hashes, round_bytes)
    # Sums over slots are read from the packed counts: eight bytes each, the sum of a group's rows is its N.
    totals = counts.mapInArrow(_total, "lang string, source string, n bigint").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    per_lang = hashes.groupBy("lang").agg(F.sum("terms").alias("v"))

    # Every source of a language meets every shard; a language without terms has one empty shard.
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).join(per_lang, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    shards = langs.join(hashes.select("lang", "shard", "terms"), "lang", "left").select("lang", "tiles", "v", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("terms", F.lit(0)).alias("terms"))
    full = groups.join(shards, "lang").join(counts, ["lang", "source", "shard"], "left").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    apart = met.groupBy("lang", "shard", "a", "b").applyInArrow(_distances, _FOUND)
    pairs = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    whole = _summed(counts.withColumn("source", F.lit("")))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"))
    whole = whole.drop("source").join(of_lang, "lang").join(per_lang, "lang").join(hashes.select("lang", "shard", "terms", "blob"), ["lang", "shard"])
    tiles = langs.select("lang", "tiles")
    mine = counts.join(groups, ["lang", "source"]).join(tiles, "lang").select("lang", "source", "shard", "slots", "counts", "total", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"))
    whole = whole.join(tiles, "lang").select("lang", "shard", "slots", "counts", "total", "v", "terms", "blob", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    told = mine.groupBy("lang", "shard", "tile").cogroup(whole.groupBy("lang", "shard", "tile")).applyInArrow(_telling, _FOUND)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda found, part: found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(told, "term").where(F.col("rank") <= TOP))


def _total(batches):
    import pyarrow as pa

    for part in slices(batches):
        n = [int(np.frombuffer(c, "<i8").sum()) for c in part.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["lang", "source", "n"])
