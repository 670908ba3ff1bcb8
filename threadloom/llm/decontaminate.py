"""Benchmark decontamination.

For every benchmark item the windows of a document that are as long as the item get a SimHash of their five-word
shingles. Fingerprints are looked up in multi-index Hamming tables: cut into ``BLOCKS`` blocks, two fingerprints
within ``RADIUS`` bits agree in some block to ``RADIUS // BLOCKS`` bits, so tables of all block values that near lose
none. What is found is verified by the exact weighted Jaccard similarity of the shingles (weights are multiplicities).

A window without any shingle of an item has similarity zero, so only windows around such shingles are fingerprinted.

Words are runs of letters and digits in lower case. Items with fewer than five words have one shingle, the whole
item; items without words match nothing. Null and empty texts match nothing. Repeated documents are each reported,
equal items too; an item without id is reported with a null id. Benchmarks beyond ``SLICE_ITEMS`` items or
``SLICE_BYTES`` bytes are searched slice by slice; an item is never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.llm.common import slices, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 36
BLOCKS = 8
SPAN = 4096
SLICE_ITEMS = 20_000
SLICE_BYTES = 32 << 20
WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _hash64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word numbers."""
    if len(ids) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = _hash64(out + ids[k : len(ids) - size + 1 + k] * _MIX[k])
    return out


def _bits(grams: np.ndarray) -> np.ndarray:
    """(n, 128) votes of each shingle."""
    both = np.stack([_hash64(grams), _hash64(grams ^ _MIX[0])], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1, bitorder="little")


def _fingerprints(votes: np.ndarray, n: int) -> np.ndarray:
    """(rows, 8) blocks of 16 bits; a bit is set if over half of the ``n`` shingles set it."""
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view("<u2")


def _similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Index:
    """Benchmark items by length: word numbers, shingles, fingerprints and block tables."""

    def __init__(self, items: tuple[tuple[object, str], ...]):
        self.vocab: dict[str, int] = {}
        self.item_ids = [i for i, _ in items]
        split = [(at, words_of(t or "")) for at, (_, t) in enumerate(items)]
        for _, words in split:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.lengths: dict[int, list] = {}
        for item, words in split:
            if words:
                ids = np.array([self.vocab[w] for w in words], dtype=np.uint64)
                self.lengths.setdefault(len(words), []).append((item, _grams(ids, min(SHINGLE, len(ids)))))
        self.grams = {s: np.unique(np.concatenate([g for n, own in self.lengths.items() if min(SHINGLE, n) == s for _, g in own])) for s in {min(SHINGLE, n) for n in self.lengths}}
        near = np.array([v for v in range(1 << 16) if v.bit_count() <= RADIUS // BLOCKS], dtype=np.uint16)
        self.groups = {}
        for n, own in self.lengths.items():
            prints = np.concatenate([_fingerprints(_bits(g).sum(axis=0, keepdims=True), len(g)) for _, g in own])
            tables = np.zeros((BLOCKS, 1 << 16), dtype=bool)
            for block in range(BLOCKS):
                for value in np.unique(prints[:, block]):
                    tables[block, near ^ value] = True
            self.groups[n] = (own, prints, np.packbits(tables, axis=1, bitorder="little"), np.unique(np.concatenate([g for _, g in own])))

    def search(self, ids: np.ndarray) -> list[tuple[object, int, int, int, float]]:
        """(item id, first word, words, Hamming distance, similarity): the best window for each item that is found."""
        found = []
        sizes = {s: _grams(ids, s) for s in self.grams}
        anchors = {s: np.flatnonzero(self._known_grams(g, s)) for s, g in sizes.items()}
        for n, (own, prints, tables, own_grams) in self.groups.items():
            s = min(SHINGLE, n)
            m = n - s + 1
            grams = sizes[s]
            at = anchors[s][np.isin(grams[anchors[s]], own_grams)]
            if len(grams) < m or not len(at):
                continue
            edges = np.zeros(len(grams) - m + 2, dtype=np.int64)
            np.add.at(edges, np.maximum(at - m + 1, 0), 1)
            np.add.at(edges, np.minimum(at + 1, len(edges) - 1), -1)
            starts = np.flatnonzero(np.cumsum(edges[:-1]))
            # Spans of SPAN words at most, wherever the starts lie: a task holds the votes of one span.
            for part in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1):
                found += self._verify(part, grams, n, m, own, prints, tables)
        best: dict[int, tuple] = {}
        for row in found:
            if row[0] not in best or (-row[4], row[1]) < (-best[row[0]][4], best[row[0]][1]):
                best[row[0]] = row
        return [(self.item_ids[at], *row[1:]) for at, row in sorted(best.items())]

    def _verify(self, starts, grams, n, m, own, prints, tables):
        low, high = int(starts[0]), int(starts[-1]) + m
        votes = np.zeros((high - low + 1, 128), dtype=np.int32)
        np.cumsum(_bits(grams[low:high]), axis=0, out=votes[1:])
        windows = _fingerprints(votes[starts - low + m] - votes[starts - low], m)
        hit = np.zeros(len(windows), dtype=bool)
        for block in range(BLOCKS):
            value = windows[:, block]
            hit |= (tables[block, value >> 3] >> (value & 7) & 1).astype(bool)
        out = []
        for at in np.flatnonzero(hit):
            distance = np.bitwise_count(prints ^ windows[at]).sum(axis=1)
            start = int(starts[at])
            window = None
            for k in np.flatnonzero(distance <= RADIUS):
                window = window or Counter(grams[start : start + m].tolist())
                similarity = _similarity(window, Counter(own[k][1].tolist()))
                if similarity >= SIMILARITY:
                    out.append((own[k][0], start, n, int(distance[k]), similarity))
        return out

    def _has_anchor(self, known: np.ndarray, size: int) -> bool:
        """Does a run of ``size`` known words (0: unknown) spell an item's shingle?"""
        if len(known) < size:
            return False
        seen = np.concatenate([[0], np.cumsum(known > 0)])
        runs = np.flatnonzero(seen[size:] - seen[:-size] == size)
        if not len(runs):
            return False
        grams = np.zeros(len(runs), dtype=np.uint64)
        for k in range(size):
            grams = _hash64(grams + known[runs + k] * _MIX[k])
        return bool(self._known_grams(grams, size).any())

    def _known_grams(self, grams: np.ndarray, size: int) -> np.ndarray:
        own = self.grams[size]
        return own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams

    def numbers(self, text: str) -> np.ndarray | None:
        """Word numbers, other words numbered apart; None if no item's shingle can be there."""
        words = words_of(text)
        known = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        if not any(self._has_anchor(known, s) for s in self.grams):
            return None
        # A word outside the vocabulary gets a number that no item has, the same wherever it stands in this text.
        other: dict[str, int] = {}
        gaps = np.flatnonzero(known == 0).tolist()
        for g in gaps:
            known[g] = other.setdefault(words[g], (1 << 40) + len(other))
        return known


@lru_cache(maxsize=2)
def shared_index(items: tuple) -> Index:
    """One index for all tasks that a worker process runs."""
    return Index(items)


def benchmark_slices(spark: SparkSession, benchmark: DataFrame) -> list:
    """Broadcast tuples of (id, text), of about ``SLICE_ITEMS`` items and ``SLICE_BYTES`` bytes at most."""
    items = benchmark.select("item_id", text_or_empty("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n_slices = max(-(-size["n"] // SLICE_ITEMS), -(-size["b"] // SLICE_BYTES))
    parts = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k).collect() for k in range(n_slices))
    return [spark.sparkContext.broadcast(tuple(sorted(((r["item_id"], r["text"]) for r in part), key=lambda r: (r[0] is None, str(r[0]), r[1])))) for part in parts]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, start_word, n_words, distance, similarity) for each document and item found in it."""
    spark = docs.sparkSession
    schema = f"key {dict(docs.dtypes)[key]}, item_id {dict(benchmark.dtypes)['item_id']}, start_word bigint, n_words bigint, distance int, similarity double"
    out = spark.createDataFrame([], schema).withColumnRenamed("key", key)
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    for n, shared in enumerate(benchmark_slices(spark, benchmark)):

        def run(batches, shared=shared):
            import pyarrow as pa

            index = shared_index(shared.value)
            for part in slices(batches):
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(k, *hit) for k, t in zip(keys, texts) if t and (ids := index.numbers(t)) is not None for hit in index.search(ids)]
                cols = list(zip(*rows)) or [[]] * 6
                kinds = (part.schema.field(0).type, item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["key", "item_id", "start_word", "n_words", "distance", "similarity"])

        found = docs.select(docs[key].alias("key"), text_or_empty(text)).mapInArrow(run, schema).withColumnRenamed("key", key)
        out = found if n == 0 else out.unionByName(found)
    return out


def keep_free(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; rows are judged in place, no shuffle."""
    spark, out = docs.sparkSession, docs
    for shared in benchmark_slices(spark, benchmark):

        def run(batches, shared=shared):
            import pyarrow as pa

            index = shared_index(shared.value)
            for part in slices(batches):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield part.filter(pa.array([not (t and (ids := index.numbers(t)) is not None and index.search(ids)) for t in texts], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
