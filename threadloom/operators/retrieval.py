"""Full text, vectors and their merge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.storage import settled

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(query: str, cap: int = 10, most: int = 6) -> list[str]:
    """Distinct tokens; of more than six the six longest, those with digits and short capitals stay, ten at most."""
    import re

    raw = [t for t in re.split(r"[\W_]+", query) if t]
    words = list(dict.fromkeys(t.lower() for t in raw))
    if len(words) <= most:
        return words
    longest = sorted(words, key=lambda t: (-len(t), words.index(t)))[:most]
    marked = [t.lower() for t in raw if any(c.isdigit() for c in t) or 2 <= len(t) <= 4 and t.isupper()]
    return list(dict.fromkeys([*longest, *marked]))[:cap]


def capped_tokens(text: Column, most: int = 6, cap: int = 10) -> Column:
    """``query_tokens`` as an expression: the words of a query, or of more than ``most`` the longest (earlier ones first),
    then those with digits and short capitals, ``cap`` at most."""
    raw = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    words = F.array_distinct(F.transform(raw, F.lower))
    longest = F.slice(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), 1, most)
    marked = F.filter(raw, lambda t: t.rlike("[0-9]") | (F.length(t).between(2, 4) & t.rlike(r"^[\p{Lu}0-9]*\p{Lu}[\p{Lu}0-9]*$")))
    return F.when(F.size(words) <= most, words).otherwise(F.slice(F.array_distinct(F.concat(F.transform(longest, lambda x: x["w"]), F.transform(marked, F.lower))), 1, cap))


def occurrences(tokens_of: str, word: str) -> Column:
    return F.size(F.filter(tokens_of, lambda x: x == word))


def matches(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, token, tf, doc_len) of the tokens asked for; a document's tokens are counted where it is read."""
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    counts = F.array(*(F.struct(F.lit(w).alias("token"), occurrences("t", w).cast("long").alias("tf")) for w in words))
    return t.select(key, F.size("t").alias("doc_len"), F.inline(F.filter(counts, lambda c: c["tf"] > 0))).select(key, "token", "tf", "doc_len")


def bm25(docs: DataFrame, key: str, text: str, words: list[str], all_words: bool = False) -> DataFrame:
    """(key, n_tokens, score); with ``all_words`` only documents that hold every token.

    Every document is tokenized once, to a row of its length and its counts of the words asked for; what is known of the
    whole corpus (documents, mean length, documents with each word) is one row of sums over these.
    """
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    names = [f"_tf{i}" for i in range(len(words))]
    rows = settled(t.select(key, F.size("t").alias("doc_len"), *(occurrences("t", w).alias(n) for w, n in zip(words, names))))
    size = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"), *(F.count_if(F.col(n) > 0).alias(f"{n}_df") for n in names))
    score, held = F.lit(0.0), F.lit(0)
    for n in names:
        idf = F.log(1 + (F.col("n_docs") - F.col(f"{n}_df") + 0.5) / (F.col(f"{n}_df") + 0.5))
        norm = F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
        score, held = score + F.when(F.col(n) > 0, idf * norm).otherwise(0.0), held + F.when(F.col(n) > 0, 1).otherwise(0)
    kept = rows.where(" or ".join(f"{n} > 0" for n in names)).join(F.broadcast(size), how="cross").select(key, held.cast("long").alias("n_tokens"), score.alias("score"))
    return kept.where(F.col("n_tokens") == len(words)) if all_words else kept


def ladder(docs: DataFrame, key: str, text: str, words: list[str], limit: int) -> DataFrame:
    """(key, rung): all tokens first, then the 4, 3, 2 rarest together, then single ones; each rung gives at most half
    of the limit before the rest is filled up in rung order."""
    return ladder_of(matches(docs, key, text, words), key, words, limit)


def ladder_of(hit: DataFrame, key: str, words: list[str], limit: int) -> DataFrame:
    """``ladder`` over hits (key, token) that are known already."""
    df = hit.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.orderBy("df", "token"))
    held = hit.join(F.broadcast(df.withColumn("rarity", rank)), "token").groupBy(key).agg(F.collect_set("rarity").alias("held"))
    has = lambda n: F.size(F.array_intersect("held", F.array(*(F.lit(i) for i in range(1, n + 1))))) == n
    n = len(words)
    rung = F.coalesce(F.when(F.size("held") == n, 0), *(F.when(has(k), i + 1) for i, k in enumerate((4, 3, 2)) if k < n), F.lit(4))
    return quota_fill(held.select(key, rung.alias("rung")), key, limit)


def quota_fill(rungs: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, rung): each rung first gives its first keys up to half of the limit, then what is left is filled up in rung
    order. Ranks over the limit are filtered at once, so that Spark keeps ``limit`` rows a rung before it shuffles."""
    ranked = rungs.withColumn("at", F.row_number().over(Window.partitionBy("rung").orderBy(key))).where(F.col("at") <= limit)
    return ranked.orderBy(F.col("at") > math.ceil(limit / 2), "rung", "at").limit(limit).select(key, "rung")


def l2(v: Column, q: list[float]) -> Column:
    probe = F.array(*map(F.lit, q))
    return F.sqrt(F.aggregate(F.zip_with(v, probe, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def knn(vectors: DataFrame, key: str, v: str, q: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest rows that pass the filter; the filter comes first, so nothing has to be fetched again."""
    kept = vectors if where is None else vectors.where(where)
    return kept.select("*", l2(F.col(v), q).alias("distance")).orderBy("distance", key).limit(k)


def conversation_similarity(distance: Column) -> Column:
    return 1 - distance


def fact_similarity(distance: Column) -> Column:
    return 1 - distance * distance / 2


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, key: str, limit: int) -> DataFrame:
    """Vector hits in their order, then text hits not seen yet; text-only hits have distance 0, so similarity 1."""
    v = vector_hits.select(key, "distance", F.lit(0).alias("lane"), F.row_number().over(Window.orderBy("distance", key)).alias("at"))
    t = text_hits.select(key, F.lit(0.0).alias("distance"), F.lit(1).alias("lane"), F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("at"))
    first = v.unionByName(t).groupBy(key).agg(F.min(F.struct("lane", "at", "distance")).alias("f"))
    return first.select(key, "f.*").orderBy("lane", "at").limit(limit).select(key, "lane", conversation_similarity(F.col("distance")).alias("similarity"))


def ordered_union(lanes: list[tuple[DataFrame, list]], key: str) -> DataFrame:
    """(key, lane, pos): bounded hit lists one after the other, each in its own order; a key keeps its first place."""
    out = None
    for n, (hits, order) in enumerate(lanes):
        part = hits.select(key, F.lit(n).alias("lane"), F.row_number().over(Window.orderBy(*order)).alias("at"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(key).agg(F.min(F.struct("lane", "at")).alias("f"))
    return first.select(key, "f.lane", F.row_number().over(Window.orderBy("f.lane", "f.at")).cast("long").alias("pos"))


def snippet(text: Column, n: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)
