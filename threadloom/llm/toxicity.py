"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is folded first: lower case, look-alike letters of other scripts to Latin, digits and signs that stand for
letters to those letters, invisible characters away. Entries are words and word beginnings; the heaviest entry that
fits a word counts, unless an exception phrase covers it. The weights' sum, plain and per thousand characters, goes
through a logistic curve. Exception phrases are a few fixed ones and, learned like the entries, each pair of
neighbouring words around an entry that stands in ``MIN_DOCS`` clean texts or more and in no toxic one.

Entries, phrases, weights and curve are learned from at most ``FIT_ROWS`` labelled rows (those with the least hash of their
id). Null or empty texts match nothing and get the score of a text without hits. Without usable labels the lexicon
is empty and every score is the prior. Repeated rows score alike; rows with a null label are not learned from.
Columns other than id and text are never read for a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slices, text_or_empty

FIT_ROWS = 20_000
PREFIXES = (4, 5, 6, 7)
MIN_DOCS = 3
MIN_ODDS = math.log(30.0)
THRESHOLD = 0.3

# Letters that look like Latin ones, digits and signs that stand for letters, invisible characters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Harmless phrases that hold an abusive word.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "dumb bell", "pond scum")

_FOLD = str.maketrans(LOOKALIKES | STANDINS | {c: None for c in INVISIBLE} | {chr(0xFF01 + i): STANDINS.get(chr(0x21 + i), chr(0x21 + i)).lower() for i in range(94)})
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")


class Lexicon(dict):
    """(entry, whole word?) -> weight, and the exception phrases."""

    exceptions: frozenset[str] = frozenset(EXCEPTIONS)


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def _features(words: set[str]) -> set[tuple[str, bool]]:
    """(entry, whole word?) for each word and each of its beginnings."""
    return {(w, True) for w in words} | {(w[:n], False) for w in words for n in PREFIXES if len(w) > n}


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) for at most ``rows`` labelled ids, taken by a hash of the id."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = known if usable is None else known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", text_or_empty()).join(F.broadcast(known), "doc_id")


def _entry_counts(texts: DataFrame, among: set | None = None) -> DataFrame:
    """(entry, whole, n): in how many texts each entry stands; tasks hand on partial counts. ``among`` limits the entries."""
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            counts: Counter = Counter()
            for text in part.column(0).to_pylist():
                found = _features(set(_WORD.findall(fold(text))))
                counts.update(found if shared.value is None else found & shared.value)
            yield pa.RecordBatch.from_pydict({"entry": pa.array([k[0] for k in counts], pa.string()), "whole": pa.array([k[1] for k in counts], pa.bool_()), "n": pa.array(list(counts.values()), pa.int64())})

    return texts.select("text").mapInArrow(run, "entry string, whole boolean, n bigint").groupBy("entry", "whole").agg(F.sum("n").alias("n"))


def learn_exceptions(texts: DataFrame, lexicon: Lexicon, min_docs: int = MIN_DOCS) -> frozenset[str]:
    """Phrases of two words around an entry in ``min_docs`` clean texts (text, y) or more and in no toxic text."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(shared.value, ())
        for part in slices(batches):
            counts: Counter = Counter()
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts.update((phrase, y) for phrase in matcher.phrases(text))
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in counts], pa.string()), "y": pa.array([y for _, y in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    found = texts.select("text", "y").mapInArrow(run, "phrase string, y int, n bigint").groupBy("phrase").agg(F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("clean"), F.sum("y").alias("toxic"))
    return frozenset(r["phrase"] for r in found.where((F.col("clean") >= min_docs) & (F.col("toxic") == 0)).collect())


def learn_lexicon(sample: DataFrame, min_docs: int = MIN_DOCS, min_odds: float = MIN_ODDS) -> Lexicon:
    """Entries whose log-odds, less half a standard error, reach ``min_odds``.

    Equal texts count once. Entries of toxic texts are counted first; only those in ``min_docs`` of them are looked
    for in clean texts. The sample bounds what comes to the driver.
    """
    texts = sample.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    totals = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    toxic = {(r["entry"], r["whole"]): r["n"] for r in _entry_counts(texts.where("y = 1")).where(F.col("n") >= min_docs).collect()}
    clean = {(r["entry"], r["whole"]): r["n"] for r in _entry_counts(texts.where("y = 0"), set(toxic)).collect()}
    found = {}
    for entry, t in toxic.items():
        c = clean.get(entry, 0)
        odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        weight = odds - 0.5 * math.sqrt(1 / (t + 0.5) + (1 / (c + 0.5) if c else 0))
        if weight >= min_odds:
            found[entry] = weight
    # An entry says nothing more than a beginning of it that weighs as much.
    lexicon = Lexicon({k: w for k, w in found.items() if not any(found.get((k[0][:n], False), -1.0) >= w for n in PREFIXES if n < len(k[0]))})
    if lexicon:
        lexicon.exceptions = frozenset(EXCEPTIONS) | learn_exceptions(texts, lexicon, min_docs)
    return lexicon


class Matcher:
    """Sum of the weights of the words that fit an entry and lie in no exception phrase."""

    def __init__(self, lexicon: dict[tuple[str, bool], float], exceptions=None):
        import ahocorasick

        exceptions = getattr(lexicon, "exceptions", EXCEPTIONS) if exceptions is None else exceptions
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for (entry, whole), weight in lexicon.items():
            slot = entries.setdefault(entry, [0.0, 0.0, False])
            slot[whole] = max(slot[whole], weight)
        for phrase in exceptions:
            entries.setdefault(fold(phrase), [0.0, 0.0, False])[2] = True
        for entry, (begins, whole, harmless) in entries.items():
            self.automaton.add_word(entry, (len(entry), begins, whole, harmless))
        self.empty = not entries
        if entries:
            self.automaton.make_automaton()

    def weigh(self, text: str) -> tuple[float, int]:
        """(sum of weights, number of characters) of the folded text."""
        folded = fold(text)
        return sum(self.hits(folded).values()), len(folded)

    def phrases(self, text: str) -> set[str]:
        """The pairs of words, one space between them, of which one fits an entry."""
        folded = fold(text)
        hits = self.hits(folded)
        words = list(_WORD.finditer(folded)) if hits else []
        return {folded[a.start() : b.end()] for a, b in zip(words, words[1:]) if b.start() == a.end() + 1 and folded[a.end()] == " " and (a.start() in hits or b.start() in hits)}

    def hits(self, folded: str) -> dict[int, float]:
        """Where an entry fits a word -> its weight."""
        if self.empty:
            return {}
        hits, covered, n = {}, [], len(folded)
        for end, (size, begins, whole, harmless) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            closed = end + 1 == n or not folded[end + 1].isalpha()
            if harmless and closed:
                covered.append((start, end))
            weight = max(begins, whole if closed else 0.0)
            if weight > hits.get(start, 0.0):
                hits[start] = weight
        for start, end in covered:
            for at in [h for h in hits if start <= h <= end]:
                del hits[at]
        return hits


def _inputs(total, chars) -> np.ndarray:
    """Bias, weights per thousand characters (saturating) and plain sum (saturating)."""
    total, chars = np.asarray(total, dtype=float), np.asarray(chars, dtype=float)
    return np.stack([np.ones_like(total), np.log1p(1000 * total / (chars + 200)), np.log1p(total)], axis=1)


def fit_curve(total, chars, y, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Logistic coefficients by Newton's method; the bias alone where a class is missing."""
    x, y = _inputs(total, chars), np.asarray(y, dtype=float)
    beta = np.zeros(3)
    beta[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 9.5))  # without labels: one in twenty
    if not 0 < y.sum() < len(y) or not np.any(total):
        return beta
    penalty = np.diag([1e-6, ridge, ridge])
    loss = lambda b: np.logaddexp(0, x @ b).sum() - y @ (x @ b) + b @ penalty @ b / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() >= 1e-8:  # classes that a line parts make Newton's steps too long
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, usable=None, rows: int = FIT_ROWS) -> tuple[dict, list[float]]:
    """Lexicon and curve. Both are bounded by the sample: the lexicon by its toxic rows, the curve by three numbers.

    Half of the sample (by the id's hash) teaches the lexicon that the other half's sums calibrate the curve with, so
    that weights of entries seen once too often do not look better than they are; then the lexicon is learned of all.
    """
    sample = labelled_sample(docs, labels, usable, rows).persist()
    try:
        half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
        trial = learn_lexicon(sample.where(half == 0))
        sums = weigh_documents(sample.where(half == 1), trial, carry=("y",)).select("total", "chars", "y").toPandas()
        return learn_lexicon(sample), fit_curve(sums["total"], sums["chars"], sums["y"]).tolist()
    finally:
        sample.unpersist()


def weigh_documents(docs: DataFrame, lexicon: dict, key: str = "doc_id", text: str = "text", carry: tuple = ()) -> DataFrame:
    """(key, carried columns, total, chars) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    types = dict(docs.dtypes)

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(shared.value)
        for part in slices(batches):
            got = [matcher.weigh(t) for t in part.column(0).to_pylist()]
            kept = {n: part.column(1 + i) for i, n in enumerate((key, *carry))}
            yield pa.RecordBatch.from_pydict(kept | {"total": pa.array([g[0] for g in got], pa.float64()), "chars": pa.array([g[1] for g in got], pa.int64())})

    schema = "".join(f"`{c}` {types[c]}, " for c in (key, *carry)) + "total double, chars bigint"
    return docs.select(text_or_empty(text), key, *carry).mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: tuple[dict, list[float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) per row."""
    lexicon, (bias, density, plain) = model
    z = F.lit(bias) + density * F.log1p(1000 * F.col("total") / (F.col("chars") + 200)) + plain * F.log1p("total")
    score = F.round(1 / (1 + F.exp(-z)), 6)
    return weigh_documents(docs, lexicon, key, text).select(key, score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[dict, list[float]], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays under ``THRESHOLD``; rows are judged in place, no shuffle."""
    lexicon, beta = model
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, beta))

    def run(batches):
        import pyarrow as pa

        words, coefficients = shared.value
        matcher = Matcher(words)
        for part in slices(batches):
            got = np.array([matcher.weigh(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()], dtype=float).reshape(-1, 2)
            z = _inputs(got[:, 0], got[:, 1]) @ np.array(coefficients)
            yield part.filter(pa.array(np.round(1 / (1 + np.exp(-z)), 6) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
