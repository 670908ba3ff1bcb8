"""Batches of facts to classify, the categories and relations they may get, and candidates that evidence must back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.blocks import best_in_scope
from threadloom.operators.retrieval import dot
from threadloom.operators.storage import numbered

# Limits of a batch and of what is asked about a fact; the similarity that makes two facts candidates.
BATCH, CANDIDATES, ATTEMPTS, RELATED, TOP_RELATED = 50, 8, 3, 0.89, 2
MAX_CATEGORIES = 10_000


def relation_candidates(new: DataFrame, facts: DataFrame, scope: list[str], threshold: float = RELATED, k: int = TOP_RELATED) -> DataFrame:
    """(id, other, similarity): for each new fact (id, scope, v) the k nearest other active facts of its scope at or
    over the threshold. New facts and others meet block by block."""
    found = best_in_scope(new.select(F.col("id").alias("qid"), *scope, F.col("v").alias("q")), facts.where("is_active").select("id", *scope, "v"), scope, k, least=threshold, others=True)
    return found.select(F.col("qid").alias("id"), F.col("id").alias("other"), "similarity")


def classification_batches(pending: DataFrame, categories: DataFrame, outcome: Column, k: int = CANDIDATES) -> DataFrame:
    """(id, batch, candidates, result, attempts) for pending facts (id, v, attempts, ...) and category centres (category, v).

    Facts go to the model in batches of ``BATCH`` by id, each with its k nearest categories. ``outcome`` is what the
    model said: ok, failed or transient. A failure counts; after ``ATTEMPTS`` the fact is parked. Outages do not count.
    """
    # Every fact meets every category: a taxonomy is a table of short vectors that callers bound, and so is its size here.
    if categories.count() > MAX_CATEGORIES:
        raise ValueError(f"a taxonomy has {MAX_CATEGORIES} categories at most")
    near = pending.join(F.broadcast(categories.select("category", F.col("v").alias("_c"))), how="cross").select("id", "category", F.round(dot(F.col("v"), F.col("_c")), 9).alias("s"))
    top = near.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "category"))).where(F.col("_n") <= k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_n", "category"))).alias("c"))
    batches = numbered(pending.select("id"), ["id"], "_number").select("id", F.floor(F.col("_number") / BATCH).alias("batch"))
    after = F.col("attempts") + F.when(outcome == "failed", 1).otherwise(0)
    result = F.when(outcome == "ok", "classified").when(outcome == "transient", "held").when(after >= ATTEMPTS, "parked").otherwise("retry")
    judged = pending.select("id", result.alias("result"), after.alias("attempts"))
    return judged.join(batches, "id").join(top, "id", "left").select("id", "batch", F.transform("c", lambda x: x["category"]).alias("candidates"), "result", "attempts")


def check_observations(candidates: DataFrame, evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """(candidate_id, observation, signature, problem): incidents and validations that trusted evidence must back.

    ``candidates``: candidate_id, observation, summary, confidence, signature_text, repeat_flag; ``evidence``:
    candidate_id, n, source (human, tool), kind, ref, span; ``texts``: ref, body, learnable, is_error. Every piece of
    evidence must exist, be learnable and hold its span of 5 to 200 characters. An incident needs a test run, or a
    repeated signal that the user flagged; a validation needs a test that passed. A signature that no text holds gives
    way to the first span.
    """
    joined = evidence.join(texts, "ref", "left")
    sound = F.coalesce(F.col("learnable") & F.length("span").between(5, 200) & F.contains("body", F.col("span")), F.lit(False))
    test = (F.col("source") == "tool") & (F.col("kind") == "test_execution")
    per = joined.join(candidates.select("candidate_id", "signature_text"), "candidate_id").groupBy("candidate_id").agg(
        F.bool_and(sound).alias("sound"), F.count_if(test).alias("tests"), F.count_if(test & ~F.col("is_error")).alias("passed"),
        F.count_if((F.col("source") == "human") & (F.col("kind") == "repeated_signal")).alias("repeats"), F.min(F.struct("n", "span"))["span"].alias("first_span"),
        F.bool_or(F.coalesce(F.contains("body", F.col("signature_text")), F.lit(False))).alias("said"),
    )
    out, kind = candidates.join(per, "candidate_id", "left"), F.col("observation")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    signature = F.when(kind == "incident", F.when(F.coalesce("said", F.lit(False)) & (F.length(F.trim("signature_text")) > 0), F.trim("signature_text")).otherwise(F.col("first_span")))
    problem = F.coalesce(
        F.when(~F.coalesce(kind.isin("incident", "validated"), F.lit(False)), "kind"), F.when(F.length(F.trim(F.coalesce("summary", F.lit("")))) < 4, "summary"),
        F.when(~F.coalesce(F.col("confidence").between(0.7, 1.0), F.lit(False)), "confidence"), F.when(~F.coalesce("sound", F.lit(False)), "evidence"),
        F.when((kind == "incident") & (none("tests") == 0) & ~((none("repeats") > 0) & F.coalesce("repeat_flag", F.lit(False))), "unproven"),
        F.when((kind == "validated") & (none("passed") == 0), "not passed"), F.when((kind == "incident") & (F.length(signature) < 4), "signature"),
    )
    return out.select("candidate_id", "observation", F.when(problem.isNull(), signature).alias("signature"), problem.alias("problem"))
