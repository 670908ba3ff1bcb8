"""Inverted indexes in shared storage: words with block maxima for ranked search, trigrams for substrings.

Documents are dealt into ranges of about ``RANGE_DOCS`` by a hash of their key. An index has a row for each entry (word
or trigram) and range, in folders by a hash of the entry and sorted there, so that a search reads the folders and row
groups of its own entries alone. A range bounds what a row gathers, however common its entry is.

Ranked search (block-max): a row of words tells its highest frequency and shortest document. Together they bound what
any document of the range can score, whatever the corpus's mean length is, so ranges are read in two rounds: those of
the highest bounds, which give a k-th score, and then only those whose bound reaches it.

Null texts have no entries. Keys are unique; an index over several builds (``folders``) counts all of them.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.retrieval import B, K1, tokens
from threadloom.operators.storage import settled

RANGE_DOCS = 128
BUCKETS = 64
SPREAD = 4
FIRST = 8
DIGITS = 6
_POSTINGS = "entry string, range bigint, n int, max_tf int, min_len int, postings array<struct<key: {key}, tf: int, len: int>>"
WORD = 64
_GRAMS = "entry string, range bigint, word int, bits bigint"


def bucket_of(entry: str, buckets: int) -> int:
    return zlib.crc32(entry.encode()) % buckets


def _ranged(docs: DataFrame, key: str, range_docs: int) -> tuple[DataFrame, int]:
    n = max(1, -(-docs.count() // range_docs))
    return docs.withColumn("range", F.pmod(F.xxhash64(key), F.lit(n))), n


def _written(rows: DataFrame, address: str, buckets: int) -> None:
    """Rows of an entry lie together and in order; a common entry's rows are spread over ``SPREAD`` files."""
    rows = rows.withColumn("bucket", F.pmod(F.crc32(F.col("entry").cast("binary")), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod("range", F.lit(SPREAD))).sortWithinPartitions("bucket", "entry", "range").write.partitionBy("bucket").parquet(address)


def _by_range(batches, columns):
    """(range, rows) for each range; rows come sorted by range."""
    rows = (r for part in batches for r in zip(*(part.column(i).to_pylist() for i in range(columns))))
    return itertools.groupby(rows, key=lambda r: r[0])


def _by_word(batches):
    """((range, word), rows) for rows (range, place, text) that come in order."""
    rows = (r for part in batches for r in zip(*(part.column(i).to_pylist() for i in range(3))))
    return itertools.groupby(rows, key=lambda r: (r[0], r[1] // WORD))


class _Index:
    """What both indexes share: their folders and how rows of some entries are read."""

    def __init__(self, spark: SparkSession, *folders: str):
        self.spark, self.folders = spark, folders
        self.meta = [spark.read.parquet(f"{f}/meta").first().asDict() for f in folders]

    def rows(self, entries: list[str]) -> DataFrame:
        """Rows of the entries asked for, ``build`` telling the folder; only their buckets are listed."""
        out = None
        for i, (folder, meta) in enumerate(zip(self.folders, self.meta)):
            buckets = sorted({bucket_of(e, meta["buckets"]) for e in entries})
            part = self.spark.read.parquet(f"{folder}/entries").where(F.col("bucket").isin(buckets) & F.col("entry").isin(entries)).withColumn("build", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def add(self, other: _Index):
        """One index over the builds of both; their keys are distinct."""
        return type(self)(self.spark, *self.folders, *other.folders)


class WordIndex(_Index):
    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, address: str, range_docs: int = RANGE_DOCS, buckets: int = BUCKETS) -> WordIndex:
        kind = dict(docs.dtypes)[key]
        words, n = _ranged(docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t")), "key", range_docs)

        def run(batches):
            import pyarrow as pa

            own = pa.list_(pa.struct([("key", key_type), ("tf", pa.int32()), ("len", pa.int32())]))
            for number, rows in _by_range(batches, 3):
                found: defaultdict[str, list] = defaultdict(list)  # of each word the numbers of its texts and its counts
                keys, lengths = [], []
                for at, (_, k, t) in enumerate(rows):
                    keys.append(k)
                    lengths.append(len(t))
                    for word, tf in Counter(t).items():
                        found[word] += (at, tf)
                flat = np.fromiter(itertools.chain.from_iterable(found.values()), dtype=np.int32).reshape(-1, 2)
                starts = np.cumsum([0, *(len(x) // 2 for x in found.values())], dtype=np.int32)
                at, tf, length = flat[:, 0], np.ascontiguousarray(flat[:, 1]), np.array(lengths, dtype=np.int32)[flat[:, 0]]
                most, least = (np.maximum.reduceat(tf, starts[:-1]), np.minimum.reduceat(length, starts[:-1])) if found else (tf, length)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(keys, key_type).take(pa.array(at)), pa.array(tf), pa.array(length)], fields=list(own.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(np.full(len(found), number, np.int64)), pa.array(np.diff(starts)), pa.array(most), pa.array(least), lists.cast(own)],
                    ["entry", "range", "n", "max_tf", "min_len", "postings"],
                )

        from pyspark.sql.pandas.types import to_arrow_type

        key_type = to_arrow_type(words.schema["key"].dataType)
        rows = words.where("t is not null").select("range", "key", "t").repartition("range").sortWithinPartitions("range").mapInArrow(run, _POSTINGS.format(key=kind))
        _written(rows, f"{address}/entries", buckets)
        size = words.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("sum_len"), F.count("t").alias("n_texts"))
        size.withColumns({"ranges": F.lit(n), "buckets": F.lit(buckets)}).coalesce(1).write.parquet(f"{address}/meta")
        return cls(docs.sparkSession, address)

    def hits(self, words: list[str], key: str = "key") -> DataFrame:
        """(key, token, tf, doc_len), as ``retrieval.matches`` counts them in the texts."""
        p = self.rows(words).select("entry", F.explode("postings").alias("p"))
        return p.select(F.col("p.key").alias(key), F.col("entry").alias("token"), F.col("p.tf").cast("long").alias("tf"), F.col("p.len").alias("doc_len"))

    def _idf(self, words: list[str]) -> dict[str, float]:
        n_docs = sum(m["n_docs"] for m in self.meta)
        df = {r["entry"]: r["df"] for r in self.rows(words).groupBy("entry").agg(F.sum("n").alias("df")).collect()}
        return {w: math.log(1 + (n_docs - df[w] + 0.5) / (df[w] + 0.5)) for w in words if w in df}

    def _norm(self, tf: Column, length: Column) -> Column:
        mean = sum(m["sum_len"] for m in self.meta) / max(1, sum(m["n_texts"] for m in self.meta))
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))

    def _scored(self, rows: DataFrame, idf: dict[str, float], words: int, all_words: bool) -> DataFrame:
        weight = F.coalesce(*(F.when(F.col("entry") == w, F.lit(v)) for w, v in idf.items()))
        p = rows.select(weight.alias("w"), F.explode("postings").alias("p"))
        score = p.groupBy("p.key").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum(F.col("w") * self._norm(F.col("p.tf"), F.col("p.len"))), DIGITS).alias("score"))
        return score.where(F.col("n_tokens") == words) if all_words else score

    def bm25(self, words: list[str], key: str = "key", all_words: bool = False) -> DataFrame:
        """(key, n_tokens, score) of every document that matches; nothing but the words' rows is read."""
        idf = self._idf(words)
        if not idf:
            return self.hits(words, key).select(key, F.col("tf").alias("n_tokens"), F.lit(0.0).alias("score"))
        return self._scored(self.rows(words), idf, len(words), all_words).withColumnRenamed("key", key)

    def top(self, words: list[str], k: int, key: str = "key", all_words: bool = False, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
        """The ``k`` best (key, score), ties to lesser keys, and how many (word, range) rows there are and were read.

        What comes to the driver is a frequency for each word, ``first`` ranges and ``k`` scores.
        """
        words = list(dict.fromkeys(words))
        idf = self._idf(words)
        if not idf or all_words and len(idf) < len(words):
            empty = self.hits(words, key).select(key, F.lit(0.0).alias("score")).limit(0)
            return empty, {"rows": 0, "read": 0}
        rows = self.rows(words)
        weight = F.coalesce(*(F.when(F.col("entry") == w, F.lit(v)) for w, v in idf.items()))
        bounds = rows.groupBy("build", "range").agg(F.sum(weight * self._norm(F.col("max_tf"), F.col("min_len"))).alias("bound"), F.count(F.lit(1)).alias("rows"))
        bounds = settled(bounds.where(F.col("rows") == len(words)) if all_words else bounds)
        lead = [(r["build"], r["range"]) for r in bounds.orderBy(F.desc("bound"), "build", "range").limit(first).collect()]
        leading = F.struct("build", "range").isin([F.struct(F.lit(b).alias("build"), F.lit(r).cast("bigint").alias("range")) for b, r in lead])
        begun = self._scored(rows.where(leading), idf, len(words), all_words).orderBy(F.desc("score"), "key").limit(k).collect()
        least = begun[-1]["score"] if len(begun) == k else -math.inf
        # Scores are rounded before they are compared, bounds are not; the slack covers both roundings.
        reach = F.col("bound") + 10.0**-DIGITS >= F.lit(least)
        wanted = bounds.where(reach | leading)
        best = self._scored(rows.join(wanted.select("build", "range"), ["build", "range"], "left_semi"), idf, len(words), all_words).orderBy(F.desc("score"), "key").limit(k)
        counts = bounds.agg(F.sum("rows").alias("rows"), F.sum(F.when(reach | leading, F.col("rows"))).alias("read")).first()
        return best.select(F.col("key").alias(key), "score"), {"rows": rows.count(), "read": counts["read"] or 0}


def literal_pieces(pattern: str, escape: str = "\\") -> list[str]:
    """What stands between the wildcards of a LIKE pattern, escapes resolved."""
    out, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == escape and at + 1 < len(pattern):
            at += 1
            out[-1] += pattern[at]
        elif c in "%_":
            out.append("")
        else:
            out[-1] += c
        at += 1
    return [p for p in out if p]


def containing(needle: str, escape: str = "\\") -> str:
    """The LIKE pattern of texts that hold ``needle``; its own signs are no wildcards."""
    return "%" + "".join(escape + c if c in (escape, "%", "_") else c for c in needle) + "%"


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


class TrigramIndex(_Index):
    """Of lower-cased texts, which it keeps by range for the exact test.

    A text has a number in its range; postings are bits of 64 numbers, a row for each trigram, range and ``word`` of 64. So
    a posting costs a bit, and searches intersect with ``bit_and``.
    """

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, address: str, range_docs: int = RANGE_DOCS, buckets: int = 4 * BUCKETS) -> TrigramIndex:
        texts, n = _ranged(docs.select(F.col(key).alias("key"), F.lower(text).alias("text")).where("text is not null"), "key", range_docs)
        place = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
        texts.withColumn("place", place).select("range", "place", "key", "text").write.parquet(f"{address}/texts")
        kept = docs.sparkSession.read.parquet(f"{address}/texts")

        def run(batches):
            import pyarrow as pa

            # Texts of a range lie together as they were written; a file that is read in parts gives a word's row in parts.
            for (number, word), rows in _by_word(batches):
                found: defaultdict[str, int] = defaultdict(int)
                for _, place, t in rows:
                    bit = 1 << (place % WORD)
                    for gram in trigrams(t):
                        found[gram] |= bit
                bits = np.array(list(found.values()), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(np.full(len(bits), number, np.int64)), pa.array(np.full(len(bits), word, np.int32)), pa.array(bits)], ["entry", "range", "word", "bits"])

        _written(kept.select("range", "place", "text").mapInArrow(run, _GRAMS), f"{address}/entries", buckets)
        kept.agg(F.count(F.lit(1)).alias("n_docs")).withColumns({"ranges": F.lit(n), "buckets": F.lit(buckets)}).coalesce(1).write.parquet(f"{address}/meta")
        return cls(docs.sparkSession, address)

    def texts(self) -> DataFrame:
        out = None
        for i, folder in enumerate(self.folders):
            part = self.spark.read.parquet(f"{folder}/texts").withColumn("build", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def candidates(self, pattern: str) -> DataFrame | None:
        """(build, range, place) of texts that hold all trigrams of the pattern; None if it has no three letters in a row."""
        grams = sorted(set().union(*map(trigrams, literal_pieces(pattern))))
        if not grams:
            return None
        held = self.rows(grams).groupBy("build", "range", "word", "entry").agg(F.bit_or("bits").alias("bits"))
        met = held.groupBy("build", "range", "word").agg(F.count(F.lit(1)).alias("n"), F.bit_and("bits").alias("bits")).where((F.col("n") == len(grams)) & (F.col("bits") != 0))
        own = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
        return met.select("build", "range", F.explode(F.transform(own, lambda i: i + F.col("word") * WORD)).alias("place"))

    def like(self, pattern: str, key: str = "key") -> DataFrame:
        """(key) of texts that are like ``pattern``, upper and lower case alike. Patterns too short for trigrams scan all."""
        low = self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
        found, texts = self.candidates(low), self.texts()
        if found is not None:
            texts = texts.join(found, ["build", "range", "place"], "left_semi")
        return texts.where(F.col("text").like(low)).select(F.col("key").alias(key))
