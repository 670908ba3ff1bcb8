"""From raw documents to token digests: toxicity, near-duplicates, benchmark passages, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of ``documents``. Rows with a null id or text go through like
others; equal ids are decided alike, and near-duplicate classes keep one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, decontaminate, shingle_dedup, toxicity
from threadloom.llm.common import materialize, table
from threadloom.llm.queries import held_out, multilingual_bpe, public_pattern

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Scores are made where the rows lie and filter them there."""
    labels = table(spark, sf_dir, "labels")
    lexicon, curve = toxicity.fit(docs, labels, ~held_out())
    return toxicity.keep_clean(docs, (lexicon, curve))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least id. SimHash and pivot tables propose pairs, a
    search by rare shingles those that they lose, and the five-word Jaccard similarity (>= 0.8) decides."""
    return shingle_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminate.keep_free(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode_digests(docs, multilingual_bpe(), public_pattern())


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("byte-bpe", encode)]

#: A learned score, hash fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
