"""Collocations from n-gram counts that are kept as weighted acyclic automata over words.

A task reads texts into shards. A shard's windows of ``MOST`` words, one from each word on, are sorted and counted; cut
at the bounds of global prefix ranges they become count transducers, built from the last word towards the first with
equal states folded. A window that its piece ends early is closed by label 0, so the weight below a prefix is the count
of that phrase. The transducers of a range meet in one task, which unites them, sums weights and prunes what stays under
the floor. Parts of candidates are looked up by composing a range's transducer with an acceptor of the parts wanted.

Range bounds come from a sample of windows. They decide where work is done, never what is counted: a prefix that a
bound cuts is kept in both ranges, whatever its weight, and its sums meet afterwards. So a hot word or phrase is split
over as many ranges as its windows fill, and one task holds the distinct windows of one range.

Null texts are empty, null languages ``und``. Texts of any length are read slice by slice. Texts without words add
nothing; equal texts count as often as they stand there; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate, count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, slices, text_or_empty

MOST = 4
FLOOR = 30
SHARE = 80
TOP = 2000
SHARD_WORDS = 1 << 20
SHARD_VOCABULARY = 58_000
TASK_WORDS = 2 << 20
UNION_PATHS = 1 << 18
SLICE_BYTES = 1 << 18
RANGE_BYTES = 4 << 20
MAX_RANGES = 1 << 18
SAMPLED = 1024
STRIDE = 64
HIGH = b"\xff"

_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
_CUT = re.compile(rb"[.,;:!?\x09-\x0d\x20]")


# --- paths: sorted rows of word ranks (1 .. m, 0 closes a window) with weights ---


def sum_paths(paths: np.ndarray, weights: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their weights."""
    if not len(paths):
        return paths, weights
    bits = max(1, int(words).bit_length())
    if MOST * bits <= 64:
        keys = np.zeros(len(paths), np.uint64)
        for column in paths.T:
            keys = keys << np.uint64(bits) | column.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
    else:
        order = np.lexsort(paths.T[::-1])
        rows = paths[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    at = np.flatnonzero(new)
    return paths[order[at]], np.add.reduceat(weights[order], at)


def _heads(paths: np.ndarray, depth: int) -> np.ndarray:
    """Where the first ``depth`` labels differ from those of the row before."""
    if not depth:
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.concatenate([[True], (paths[1:, :depth] != paths[:-1, :depth]).any(axis=1)]))


def _fold(starts: np.ndarray, labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which states stay, for each state its place among those): states with the same arcs are one."""
    sizes = np.diff(np.append(starts, len(labels)))
    mixed = labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    _, first, group = np.unique(np.add.reduceat(mixed ^ mixed >> np.uint64(32), starts), return_index=True, return_inverse=True)
    like = first[group.ravel()]
    near = np.minimum(np.repeat(starts[like] - starts, sizes) + np.arange(len(labels)), len(labels) - 1)  # equal sums are no proof: compare arc by arc
    same = (sizes == sizes[like]) & np.logical_and.reduceat((labels[near] == labels) & (values[near] == values), starts)
    like = np.where(same, like, np.arange(len(starts)))
    stay = like == np.arange(len(starts))  # a state that others are like is like itself
    return stay, (np.cumsum(stay) - 1)[like]


class Transducer:
    """A weighted acyclic automaton: for each depth the states' arcs (label, next state; at the last depth the weight)."""

    def __init__(self, words: list[bytes], sizes: list[np.ndarray], labels: list[np.ndarray], values: list[np.ndarray]):
        self.words, self.sizes, self.labels, self.values = words, sizes, labels, values

    @classmethod
    def build(cls, words: list[bytes], paths: np.ndarray, weights: np.ndarray) -> Transducer:
        """From sorted distinct rows. Only words that stand in them are kept."""
        used = np.bincount(paths.ravel(), minlength=len(words) + 1) > 0
        used[0] = False
        paths = np.where(paths > 0, np.cumsum(used)[paths], 0).astype(np.int32)
        kept = [words[i - 1] for i in np.flatnonzero(used).tolist()]
        sizes, labels, values = [], [], []
        for depth in range(MOST - 1, -1, -1):
            starts = _heads(paths, depth)
            arcs = paths[:, depth]
            stay, state = _fold(starts, arcs, weights)
            n = np.diff(np.append(starts, len(arcs)))
            own = np.repeat(stay, n)
            sizes.insert(0, n[stay])
            labels.insert(0, arcs[own])
            values.insert(0, weights[own])
            paths, weights = paths[starts], state
        return cls(kept, sizes, labels, values)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted rows and weights: all that the automaton accepts."""
        columns, state = [], np.zeros(1, np.int64)
        for sizes, labels, values in zip(self.sizes, self.labels, self.values):
            starts = np.cumsum(sizes) - sizes
            n = sizes[state]
            arcs = np.repeat(starts[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            columns = [np.repeat(c, n) for c in columns] + [labels[arcs]]
            state = values[arcs]
        return np.stack(columns, axis=1).astype(np.int32), state

    def compose(self, parts: list[tuple[bytes, ...]]) -> np.ndarray:
        """Weights of ``parts`` (of 1 to ``MOST`` words): the acceptor of the parts and this automaton are walked together.

        Both are read in one order, label by label: a part is alive while the state it has reached has an arc for its
        next word. The weight of what it reaches is the sum of all paths from there on.
        """
        rank = {w: i + 1 for i, w in enumerate(self.words)}
        wanted = np.array([[rank.get(w, -1) for w in p] + [0] * (MOST - len(p)) for p in parts], np.int64).reshape(-1, MOST)
        length = np.array([len(p) for p in parts], np.int64)
        below = self._below()
        state, found = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        alive = np.arange(len(parts))
        for depth, (sizes, labels, values) in enumerate(zip(self.sizes, self.labels, self.values)):
            width = len(self.words) + 1
            owner = np.repeat(np.arange(len(sizes)), sizes)
            key = owner * width + labels  # arcs are sorted by state and label
            ask = np.where(wanted[alive, depth] > 0, state[alive] * width + wanted[alive, depth], -1)
            at = np.minimum(np.searchsorted(key, ask), len(key) - 1)
            alive, at = alive[key[at] == ask], at[key[at] == ask]
            last = length[alive] == depth + 1
            found[alive[last]] = below[depth][at[last]]
            state[alive] = values[at] if depth < MOST - 1 else 0
            alive = alive[~last]
        return found

    def _below(self) -> list[np.ndarray]:
        """For each depth the weight behind every arc."""
        out = [self.values[-1].astype(np.int64)]
        for depth in range(MOST - 1, 0, -1):
            sizes = self.sizes[depth]
            total = np.add.reduceat(out[0], np.cumsum(sizes) - sizes)
            out.insert(0, total[self.values[depth - 1]])
        return out

    def dump(self) -> bytes:
        import zstandard

        parts = [b" ".join(self.words)]
        for arrays in (self.sizes, self.labels, self.values):
            for a in arrays:
                width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << 8 * w)
                parts.append(bytes([width]) + a.astype(f"<u{width}").tobytes())
        return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts))

    @classmethod
    def load(cls, blob: bytes) -> Transducer:
        import zstandard

        raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        n = 1 + 3 * MOST
        ends = np.cumsum((8 * n, *struct.unpack_from(f"<{n}Q", raw)))
        parts = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        arrays = [np.frombuffer(p[1:], f"<u{p[0]}").astype(np.int64) for p in parts[1:]]
        return cls(bytes(parts[0]).split(b" "), arrays[:MOST], arrays[MOST : 2 * MOST], arrays[2 * MOST :])


def unite(parts: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The union of (words, paths, weights): one vocabulary in byte order, weights of equal paths summed."""
    if len(parts) == 1:
        return parts[0]
    words = sorted(set().union(*(p[0] for p in parts)))
    rank = {w: i + 1 for i, w in enumerate(words)}
    moved = [np.array([0, *map(rank.__getitem__, p[0])], np.int32)[p[1]] for p in parts]
    paths, weights = sum_paths(np.concatenate(moved), np.concatenate([p[2] for p in parts]), len(words))
    return words, paths, weights


def prune(words: list[bytes], paths: np.ndarray, weights: np.ndarray, floor: int, bounds: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Paths cut where a prefix falls under ``floor``, unless it is a beginning of one of ``bounds``.

    What is cut off goes into the closing label, so the weights of all prefixes that stay are whole.
    """
    length = np.zeros(len(paths), np.int64)
    on = [np.ones(len(paths), bool) for _ in bounds]
    for depth in range(1, MOST + 1):
        heads = _heads(paths, depth)
        n = np.diff(np.append(heads, len(paths)))
        keep = np.repeat(np.add.reduceat(weights, heads) >= floor, n)
        for k, bound in enumerate(bounds):
            at = bisect_left(words, bound[depth - 1])
            on[k] &= paths[:, depth - 1] == (at + 1 if at < len(words) and words[at] == bound[depth - 1] else -1)
            keep |= on[k]
        length = np.where(keep & (length == depth - 1) & (paths[:, depth - 1] > 0), depth, length)
    paths = np.where(np.arange(MOST) < length[:, None], paths, 0).astype(np.int32)
    return sum_paths(paths[length > 0], weights[length > 0], len(words))


# --- shards: from texts to windows ---


class Shard:
    """Word numbers of one language's texts, in order; number 0 ends a piece."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.rank: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.rank[b"."] = 0

    def add(self, data: bytes) -> None:
        tokens = data.split()
        self.ids.append(np.fromiter(map(self.rank.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or len(self.rank) >= SHARD_VOCABULARY

    def take(self, more: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """(words, sorted paths, weights, words counted). With ``more`` of a text to come, its last words wait."""
        names = list(self.rank)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        wait = ids[-(MOST - 1) :] if more else ids[:0]
        padded = np.concatenate([ids, np.zeros(MOST - 1, np.int32)])
        n = len(ids) - len(wait)
        order = sorted(range(1, len(names)), key=names.__getitem__)
        place = np.zeros(len(names), np.int32)
        place[order] = np.arange(1, len(names), dtype=np.int32)
        columns, open_ = [], np.ones(n, bool)
        for k in range(MOST):
            column = place[padded[k : k + n]]
            open_ = open_ & (column > 0)
            columns.append(np.where(open_, column, 0))
        paths = np.stack(columns, axis=1)
        paths = paths[paths[:, 0] > 0]
        total = len(paths)
        paths, weights = sum_paths(paths, np.ones(total, np.int64), len(names) - 1)
        self.clear()
        if len(wait):
            self.add(b" ".join(names[i] for i in wait.tolist()))
        return [names[i] for i in order], paths, weights, total


def _pieces(text: str):
    """Bounded slices of a text as bytes, lower-cased, words and piece ends (``.``) parted by spaces."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE_BYTES and (hit := _CUT.search(data, at + SLICE_BYTES)):
            end = hit.end()
        yield data[at:end].translate(_ENDS).replace(b".", b" . ")
        at = end


def _cut_rows(shard: tuple, lang: str, bounds: list[tuple]):
    """(range, lang, words, blob) for each prefix range that a shard's windows fall into."""
    words, paths, weights, _ = shard
    low, high = bisect_left(bounds, (lang.encode(),)), bisect_left(bounds, (lang.encode() + b"\0",))
    cuts, lows = [0], 0
    for bound in bounds[low:high]:
        lows, top = 0, len(paths)
        for column, word in enumerate(bound[1:]):  # the first row that is not before the bound
            at = bisect_left(words, word) if word else -1
            part = paths[lows:top, column]
            if word and not (at < len(words) and words[at] == word):
                lows += int(np.searchsorted(part, at + 1))
                break
            lows, top = lows + int(np.searchsorted(part, at + 1)), lows + int(np.searchsorted(part, at + 1, "right"))
        cuts.append(lows)
    cuts.append(len(paths))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield low + k, lang, int(weights[a:b].sum()), Transducer.build(words, paths[a:b], weights[a:b]).dump()


_RANGE = "range int, lang string, words bigint, blob binary"


def shard_transducers(docs: DataFrame, bounds: list[tuple]) -> DataFrame:
    """(range, lang, words, blob): the count transducers of every shard, one for each prefix range it touches."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.binary()))], ["range", "lang", "words", "blob"])

        shards: defaultdict[str, Shard] = defaultdict(Shard)
        held = 0
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                shard = shards[lang]
                for data in _pieces(text):
                    before = shard.size
                    shard.add(data)
                    held += shard.size - before
                    if shard.full() or held >= TASK_WORDS:
                        big = shard if shard.full() else max(shards.values(), key=lambda s: s.size)
                        name = next(k for k, s in shards.items() if s is big)
                        held -= big.size
                        if rows := list(_cut_rows(big.take(more=True), name, shared.value)):
                            yield batch(rows)
                        held += big.size
                shard.add(b".")
                held += 1
        for lang, shard in shards.items():
            if rows := list(_cut_rows(shard.take(more=False), lang, shared.value)):
                yield batch(rows)

    return docs.mapInArrow(run, _RANGE)


def range_bounds(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[tuple]:
    """Windows (lang, words) that part the corpus into ranges of about equal weight, from a sample of texts.

    The sample is counted, sorted and numbered in tasks; only the bounds and a row for each sorted partition come to the
    driver. There are ``MAX_RANGES`` at most, which bounds what is broadcast; past 1 TB of text ranges grow instead.
    """
    spark = docs.sparkSession
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(min(bytes_ // range_bytes, MAX_RANGES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, ranges * SAMPLED * STRIDE * 6 / max(1, bytes_))
    names = ["lang", *(f"w{k}" for k in range(MOST))]

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            rows = []
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for data in _pieces(text):
                    tokens = data.split()
                    for at in range(0, len(tokens), STRIDE):
                        window = [*tokens[at : at + MOST], b"."]
                        if window[0] != b".":
                            rows.append([lang, *(w.decode() for w in window[: window.index(b".")]), *[""] * (MOST - window.index(b"."))])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    sample = docs if share == 1.0 else docs.sample(share, 17)
    windows = sample.mapInArrow(run, ", ".join(f"{c} string" for c in names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    laid = materialize(windows.orderBy(*names).withColumn("part", F.spark_partition_id()), "window-sample")
    counts = sorted(laid.groupBy("part").agg(F.sum("n")).collect())
    total = sum(n for _, n in counts)
    if not total:
        return []
    starts = spark.createDataFrame(list(zip((part for part, _ in counts), accumulate((n for _, n in counts), initial=0))), "part int, start bigint")
    own = Window.partitionBy("part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.join(F.broadcast(starts), "part").withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    # The k-th bound is the window at place total * k // ranges of the sample.
    k = F.greatest(F.lit(1), F.expr(f"(before * {ranges} + {total - 1}) div {total}"))
    bounds = placed.where((k < ranges) & (k * total < (F.col("before") + F.col("n")) * ranges)).select(*names)
    return sorted(tuple(w.encode() for w in r) for r in bounds.collect())


def range_transducers(shards: DataFrame, bounds: list[tuple], floor: int) -> DataFrame:
    """(range, lang, words, blob): one pruned transducer for each range and language; shards are united as they come."""
    shared = shards.sparkSession.sparkContext.broadcast(bounds)
    placed = shards.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "lang")

    def run(batches):
        import pyarrow as pa

        def out(key, waiting, whole, total):
            words, paths, weights = unite([*whole, *waiting])
            near = [b[1:] for b in shared.value[max(0, key[0] - 1) : key[0] + 1] if b[0] == key[1].encode()]
            paths, weights = prune(words, paths, weights, floor, near)
            blob = Transducer.build(words, paths, weights).dump() if len(paths) else None
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([total], pa.int64()), pa.array([blob], pa.binary())], ["range", "lang", "words", "blob"])

        key, waiting, whole, size, total = None, [], [], 0, 0
        for part in slices(batches, 16):
            for r, lang, words, blob in zip(*(part.column(i).to_pylist() for i in range(4))):
                if (r, lang) != key:
                    if key:
                        yield out(key, waiting, whole, total)
                    key, waiting, whole, size, total = (r, lang), [], [], 0, 0
                one = Transducer.load(blob)
                waiting.append((one.words, *one.paths()))
                size += len(waiting[-1][2])
                total += words
                if size >= max(UNION_PATHS, sum(len(w[2]) for w in whole)):
                    whole, waiting, size = [unite([*whole, *waiting])], [], 0
        if key:
            yield out(key, waiting, whole, total)

    return placed.mapInArrow(run, _RANGE)


def prefixes(transducers: DataFrame) -> DataFrame:
    """(lang, phrase, size, f) of every phrase that a transducer still holds; a phrase cut by a bound comes in parts."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 1):
            one = Transducer.load(part.column(1)[0].as_py())
            paths, weights = one.paths()
            names = np.array(["", *(w.decode() for w in one.words)], dtype=object)
            for depth in range(1, MOST + 1):
                heads = _heads(paths, depth)
                total = np.add.reduceat(weights, heads)
                real = paths[heads, depth - 1] > 0
                rows = names[paths[heads[real], :depth]]
                phrases = [" ".join(r) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[0].as_py()] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array([depth] * len(phrases), pa.int32()), pa.array(total[real], pa.int64())], ["lang", "phrase", "size", "f"])

    return transducers.where("blob is not null").select("lang", "blob").mapInArrow(run, "lang string, phrase string, size int, f bigint")


def look_up(transducers: DataFrame, parts: DataFrame, bounds: list[tuple]) -> DataFrame:
    """(lang, part, f) of distinct ``parts`` (lang, part): composed with the transducers of the ranges that may hold them."""
    shared = parts.sparkSession.sparkContext.broadcast(bounds)

    def route(batches):
        import pyarrow as pa

        for part in slices(batches, 4096):
            ranges, langs, parts_ = [], [], []
            for lang, phrase in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                key = (lang.encode(), *phrase.encode().split(b" "))
                low = bisect_right(shared.value, key + (b"",) * (MOST + 1 - len(key)))
                high = bisect_right(shared.value, key + (HIGH,) * (MOST + 1 - len(key)))
                ranges += range(low, high + 1)
                langs += [lang] * (high + 1 - low)
                parts_ += [phrase] * (high + 1 - low)
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(langs, pa.string()), pa.array(parts_, pa.string())], ["range", "lang", "part"])

    def compose(wanted, counts):
        import pyarrow as pa

        blobs = [b for b in counts["blob"].to_pylist() if b] if counts.num_rows else []
        parts_ = wanted["part"].to_pylist() if wanted.num_rows else []
        if not blobs or not parts_:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], ["lang", "part", "f"])
        found = Transducer.load(blobs[0]).compose([tuple(p.encode().split(b" ")) for p in parts_])
        return pa.table([wanted["lang"], wanted["part"], pa.array(found)], ["lang", "part", "f"])

    routed = parts.select("lang", "part").mapInArrow(route, "range int, lang string, part string")
    held = transducers.where("blob is not null").select("range", "lang", "blob")
    met = routed.groupBy("range", "lang").cogroup(held.groupBy("range", "lang")).applyInArrow(compose, "lang string, part string, f bigint")
    return met.where("f > 0").groupBy("lang", "part").agg(F.sum("f").alias("f"))


def count_phrases(docs: DataFrame, floor: int = FLOOR, text: str = "text", lang: str = "lang", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple]]:
    """(phrases, words, transducers, bounds): phrases (lang, phrase, size, f >= floor), words (lang, n), the ranges."""
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    bounds = range_bounds(read, range_bytes)
    shards = materialize(shard_transducers(read, bounds), "shard-transducers")
    ranges = materialize(range_transducers(shards, bounds, floor), "range-transducers")
    found = prefixes(ranges).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= floor)
    return materialize(found, "phrases"), ranges.groupBy("lang").agg(F.sum("words").alias("n")), ranges, bounds


def collocations(docs: DataFrame, floor: int = FLOOR, share: int = SHARE, top: int = TOP, **columns) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``MOST`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase is scored by its weakest cut; one whose words nearly always (``share`` per cent) stand in a longer one
    yields to that.
    """
    phrases, words, ranges, bounds = count_phrases(docs, floor, **columns)
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substr(phrase, length(substring_index(phrase, ' ', k)) + 2)"))
    parts = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    counts = materialize(look_up(ranges, parts, bounds), "part-counts")
    left = counts.select(F.col("lang"), F.col("part").alias("first"), F.col("f").alias("l"))
    right = counts.select(F.col("lang"), F.col("part").alias("rest"), F.col("f").alias("r"))
    exact = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", exact)
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s"))
    inside = phrases.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    inner = inside.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    longer = inner.select("lang", F.expr("array_join(slice(w, at, n), ' ')").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("s.a").cast("decimal(20,0)") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("s.a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return best.join(words, "lang").select("lang", "rank", "phrase", F.col("s.a").alias("a"), F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))
