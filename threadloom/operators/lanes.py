"""Facts found by words, by vectors, or by both; probes, margins and quotas over what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.blocks import BLOCK, best_in_scope
from threadloom.operators.retrieval import dot, fact_similarity, knn

# The shapes of identifiers (path, dotted name, call, upper and lower snake case, mixed case).
IDENTIFIERS = (
    r"(?:/?[A-Za-z0-9_$.-]+[\\/])+[A-Za-z0-9_$.-]+",
    r"\b[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)+\b",
    r"\b[A-Za-z_$][A-Za-z0-9_$]*\(\)",
    r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
    r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    r"\b[A-Za-z_$][A-Za-z0-9_$]*[A-Z][A-Za-z0-9_$]*\b",
)
MAX_IDENTIFIERS = 4


def identifiers(text: Column) -> Column:
    """The first four distinct identifiers, shape by shape; marks around them do not count."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in IDENTIFIERS))
    bare = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"\(\)$", ""), r"[.!?,;:]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 2)), 1, MAX_IDENTIFIERS)


def names_exactly(text: Column) -> Column:
    """Does the query name something: an identifier, or a single word with an extension?"""
    return (F.size(identifiers(text)) > 0) | (~text.rlike(r"\s") & text.rlike(r"\.[A-Za-z0-9]+$"))


def holds_word(text: Column, word: str) -> Column:
    """The word stands in the text, in any case, with no letter, digit, ``_`` or ``$`` on either side; a path-like word
    (with ``/``, ``\\`` or ``.``) with no ``.``, ``/``, ``\\`` or ``-`` there either, but a stop that ends a sentence."""
    import re

    if re.search(r"[/\\.]", word):
        return text.rlike(rf"(?i)(?<![A-Za-z0-9_$.\\/-]){re.escape(word)}(?:(?![A-Za-z0-9_$.\\/-])|(?=\.(?![A-Za-z0-9_$])))")
    return text.rlike(rf"(?i)(?<![A-Za-z0-9_$]){re.escape(word)}(?![A-Za-z0-9_$])")


def nearest_of_two(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, distance): the smaller distance of each id over two indexes; partial minima travel, not rows."""
    both = first.select(key, "distance").unionByName(second.select(key, "distance"))
    return both.groupBy(key).agg(F.min("distance").alias("distance"))


def scoped_knn(facts: DataFrame, distances: DataFrame, visible: Column, threshold: float, k: int) -> DataFrame:
    """The k nearest active facts in scope whose similarity reaches the threshold."""
    kept = facts.where(F.col("is_active") & visible).join(distances, "id")
    return kept.where(fact_similarity(F.col("distance")) >= threshold).orderBy("distance", "id").limit(k)


def lexical(facts: DataFrame, text: str, literal: str, words: list[str], visible: Column, k: int) -> DataFrame:
    """(id, lexical_score) of active facts in scope: 2 where a named identifier stands as a word; without identifiers
    1 where the literal query stands."""
    hit, score = F.contains(F.lower(text), F.lit(literal.lower())), 1
    if words:
        hit, score = F.lit(False), 2
        for w in words:
            hit = hit | holds_word(F.col(text), w)
    return facts.where(F.col("is_active") & visible & hit).select("id", F.lit(score).alias("lexical_score")).orderBy("id").limit(k)


def combined(lexical_hits: DataFrame, semantic_hits: DataFrame, k: int) -> DataFrame:
    """(id, lane, lexical_score, similarity): words first, then similarity, then the id."""
    s = semantic_hits.select("id", fact_similarity(F.col("distance")).alias("similarity"))
    lane = F.when(F.col("lexical_score").isNull(), "semantic").when(F.col("similarity").isNull(), "lexical").otherwise("both")
    joined = lexical_hits.join(s, "id", "full").withColumn("lane", lane)
    return joined.orderBy(F.desc_nulls_last("lexical_score"), F.desc_nulls_last("similarity"), "id").limit(k).select("id", "lane", "lexical_score", "similarity")


def baseline(vector: Column, probes: list[list[float]]) -> Column:
    """The largest inner product with a probe, at least -1."""
    return F.greatest(F.lit(-1.0), *(dot(vector, F.array(*map(F.lit, p))) for p in probes))


def clears_margin(similarity: Column, base: Column, lexical_score: Column, margin: float = 0.045) -> Column:
    """Found by words, or far enough over the baseline; the raw gap decides, not the rounded one."""
    return lexical_score.isNotNull() | F.coalesce(similarity - base >= margin, F.lit(False))


def concepts_together(vectors: DataFrame, key: str, v: str, group: str, probes: list[list[float]], limit: int) -> DataFrame:
    """(group, mean_distance, representative): groups that hold a near row of every concept.

    Each concept gives its ``5 * limit`` nearest rows; a group's score is the mean of its nearest row for each concept,
    its representative the nearest row of the first concept.
    """
    near = None
    for n, probe in enumerate(probes):
        hits = knn(vectors, key, v, probe, 5 * limit).select(group, F.col(key).alias("row"), "distance", F.lit(n).alias("concept"))
        near = hits if near is None else near.unionByName(hits)
    best = near.groupBy(group, "concept").agg(F.min(F.struct("distance", "row")).alias("b"))
    whole = best.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("b.distance").alias("mean_distance"), F.min(F.when(F.col("concept") == 0, F.col("b.row"))).alias("representative"))
    return whole.where(F.col("n") == len(probes)).orderBy("mean_distance", group).limit(limit).drop("n")


def repeats(hits: DataFrame, rows: DataFrame, key: str, project: str, limit: int, threshold: float) -> DataFrame:
    """Of the nearest ``3 * limit`` rows those over the threshold and of the project, with the answer in three lines.

    The cut comes before the project test, so a project may get fewer than ``limit``.
    """
    near = hits.orderBy("distance", key).limit(3 * limit).withColumn("similarity", fact_similarity(F.col("distance"))).where(F.col("similarity") >= threshold)
    lines = F.filter(F.split("assistant_message", "\n"), lambda x: F.length(F.trim(x)) > 10)
    kept = near.join(rows.where(F.col("project") == project), key)
    answer = F.substring(F.array_join(F.slice(lines, 1, 3), "\n"), 1, 300)
    return kept.select(key, F.substring("user_message", 1, 200).alias("user_message"), answer.alias("summary"), "similarity").orderBy(F.desc("similarity"), key).limit(limit)


def uncovered_in_turns(turns: DataFrame, facts: DataFrame, words: list[str], limit: int = 2, chars: int = 160) -> DataFrame:
    """(word, id, snippet): turns whose user text names a word that no active fact names; newest first."""
    spark = turns.sparkSession
    asked = F.array_compact(F.array(*(F.when(holds_word(F.col("user_message"), w), F.lit(w)) for w in words)))
    said = turns.select("id", "timestamp", "user_message", F.explode(asked).alias("word"))
    known = F.array_compact(F.array(*(F.when(holds_word(F.col("fact"), w), F.lit(w)) for w in words)))
    covered = facts.where("is_active").select(F.explode(known).alias("word")).distinct()
    free = spark.createDataFrame([(w,) for w in words], "word string").join(covered, "word", "left_anti")
    # The rank is filtered at once, so that Spark keeps the first rows of a word before it shuffles them.
    ranked = said.join(F.broadcast(free), "word").withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("timestamp"), "id")))
    return ranked.where(F.col("n") <= limit).select("word", "id", F.substring("user_message", 1, chars).alias("snippet"))


def hashed_words(rows: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """(key, bucket, weight): the sparse hashed bag of words, of unit length.

    A token's 32-bit FNV-1a hash over its UTF-16 units adds one to a bucket and a half to another. Each distinct token
    is hashed once, whatever the number of its rows.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 2)
    counted = rows.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    point = lambda c: F.ascii(c).cast("long")
    units = lambda p: F.when(p > 0xFFFF, F.array(F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(1023)))).otherwise(F.array(p))
    codes = F.flatten(F.transform(F.split("token", ""), lambda c: units(point(c))))
    fnv = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    hashed = counted.select("token").distinct().withColumn("h", fnv)
    parts = F.array(F.struct((F.col("h") % dimensions).alias("bucket"), F.col("n").cast("double").alias("w")), F.struct((F.shiftright("h", 8) % dimensions).alias("bucket"), (F.col("n") * 0.5).alias("w")))
    sums = counted.join(hashed, "token").select(key, F.explode(parts).alias("p")).groupBy(key, F.col("p.bucket").alias("bucket")).agg(F.sum("p.w").alias("w"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, key).select(key, "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def spread(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spread from its first to its last."""
    w = Window.partitionBy(group).orderBy(*order)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.withColumn("_at", F.row_number().over(w).cast("long") - 1).join(sizes, group)
    step = (F.col("_n") - 1) / F.lit(max(1, most - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step + 0.5))
    return placed.where((F.col("_n") <= most) | F.array_contains(wanted, F.col("_at"))).drop("_at", "_n")


def top_in_scope(asked: DataFrame, facts: DataFrame, k: int, block: int = BLOCK, tile: int = BLOCK) -> DataFrame:
    """(qid, id, similarity): for each query (qid, scope, q) the ``k`` facts (id, scope, v) of its scope with the highest
    dot product, ties to lesser ids.

    A scope's queries are dealt into blocks and its facts into tiles; a task meets one block with one tile and hands on
    ``k`` rows a query.
    """
    return best_in_scope(asked, facts, ["scope"], k, block=block, tile=tile)
