"""Searches over stored indexes: the rows of the scans that they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import placement, retrieval
from threadloom.operators.storage import scratch
from threadloom.operators.text_index import TrigramIndex, WordIndex, containing
from threadloom.operators.vector_cells import CellIndex
from threadloom.plans.base import ORACLE_SQL, query, table
from threadloom.plans.lane_queries import PROBES, top01_vector_top_k
from threadloom.plans.placement_queries import chr12_nearest_in_scope, placed
from threadloom.plans.search_queries import _BM25, PROBE, WORDS, ret01_filtered_knn, ret03_rarest_ladder

_BUILT: dict[tuple[str, str, type], WordIndex | TrigramIndex] = {}


def index(spark, sf_dir, kind):
    """The index of ``documents``, built once a session."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _BUILT:
        _BUILT[at] = kind.build(table(spark, sf_dir, "documents"), "doc_id", "text", scratch(spark, kind.__name__))
    return _BUILT[at]


@query(f"WITH {_BM25} SELECT doc_id, n_tokens, round(score, 6) AS score FROM scored")
def ret02_indexed_bm25(spark, sf_dir):
    return index(spark, sf_dir, WordIndex).bm25(WORDS, "doc_id")


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored WHERE n_tokens = {len(WORDS)} ORDER BY 2 DESC, doc_id LIMIT 20")
def top02_block_max_all(spark, sf_dir):
    return index(spark, sf_dir, WordIndex).top(WORDS, 20, "doc_id", all_words=True)[0]


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY 2 DESC, doc_id LIMIT 20")
def top02_block_max_any(spark, sf_dir):
    return index(spark, sf_dir, WordIndex).top(WORDS, 20, "doc_id")[0]


@query(ORACLE_SQL[ret03_rarest_ladder.__name__])
def ret03_indexed_ladder(spark, sf_dir):
    return retrieval.ladder_of(index(spark, sf_dir, WordIndex).hits(WORDS, "doc_id"), "doc_id", WORDS, 20)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ther and')")
def ret05_trigram_substring(spark, sf_dir):
    return index(spark, sf_dir, TrigramIndex).like(containing("Ther and"), "doc_id")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%in_ the%re and%'")
def ret05_trigram_wildcards(spark, sf_dir):
    return index(spark, sf_dir, TrigramIndex).like("%in_ the%re and%", "doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), '7b')")
def ret05_short_pattern(spark, sf_dir):
    """Two letters have no trigram: the stored texts are scanned."""
    return index(spark, sf_dir, TrigramIndex).like(containing("7B"), "doc_id")


def cells(spark, sf_dir):
    at = (spark.sparkContext.applicationId, sf_dir, CellIndex)
    if at not in _BUILT:
        _BUILT[at] = CellIndex.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scratch(spark, "cells"))
    return _BUILT[at]


@query(ORACLE_SQL[ret01_filtered_knn.__name__])
def ret01_cells_filtered_knn(spark, sf_dir):
    k = cells(spark, sf_dir).knn(PROBE, 15, F.col("label") % 2 == 0)[0]
    return k.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round(retrieval.conversation_similarity(F.col("distance")), 6).alias("conversation_score"), F.round(retrieval.fact_similarity(F.col("distance")), 6).alias("fact_score"))


@query(ORACLE_SQL[top01_vector_top_k.__name__])
def top01_cells_top_k(spark, sf_dir):
    return cells(spark, sf_dir).knn(PROBES[2], 25)[0].select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(ORACLE_SQL[chr12_nearest_in_scope.__name__].replace("similarity >= 0.1", "similarity >= 0.4"))
def chr12_close_in_scope(spark, sf_dir):
    f = placed(spark, sf_dir).where("is_active").select("id", F.coalesce("project_id", F.lit("-")).alias("project"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return placement.nearest_in_scope(f, v, ["project"], 0.4).drop("asked").withColumn("similarity", F.round("similarity", 6))
