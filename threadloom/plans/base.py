"""Registration of queries, and the tables of the archive model derived from the given ones.

``EXCHANGES`` and ``FACTS`` state in SQL what ``exchanges`` and ``facts`` build with DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.turns import assemble_turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL of its rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of ``conversations``: a conversation is a session, its number modulo 7 the project; clocks are made up
    from conversation and turn."""
    turns = assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    minute = F.col("conv_id") * 37 + F.col("line_start")
    ts = F.timestamp_seconds(F.lit(1704067200) + minute * 60)
    return turns.select(
        F.md5(F.concat(F.lit("mx:"), F.col("conv_id").cast("string"), F.lit(":u"), F.col("line_start").cast("string"))).alias("id"),
        F.col("conv_id").alias("session_id"), F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("project"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.'000Z'").alias("timestamp"), "user_message", "assistant_message", "line_start", "line_end",
        (F.col("conv_id") % 11 == 0).alias("is_sidechain"),
    )


EXCHANGES = """turns AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
grouped AS (SELECT conv_id, n, min(turn) AS line_start, max(turn) AS line_end, max(CASE WHEN role = 'user' THEN text END) AS user_message,
    string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) || chr(10) ORDER BY turn) AS assistant_message
    FROM turns WHERE n > 0 GROUP BY conv_id, n HAVING count(CASE WHEN role <> 'user' THEN 1 END) > 0),
exchanges AS (SELECT md5('mx:' || conv_id || ':u' || line_start) AS id, conv_id AS session_id, 'p' || (conv_id % 7) AS project,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 37 + line_start AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp,
    user_message, assistant_message, line_start, line_end, conv_id % 11 = 0 AS is_sidechain FROM grouped)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of ``documents``: the source is the project (every fifth fact is global), the language the category."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        d.alias("id"), F.col("text").alias("fact"), F.col("source").alias("project"), F.col("lang").alias("category"),
        F.when(d % 5 == 0, "global").otherwise("project").alias("scope_type"), (F.coalesce("quality", F.lit(1)) == 1).alias("is_active"),
        F.col("toxic").alias("flagged"), (d * 7 % 23).alias("confirmations"), (d * 13 % 120).alias("age_days"), "n_chars",
        F.element_at(F.array(F.lit("decision"), F.lit("human"), F.lit("tool"), F.lit("unknown")), (d % 4 + 1).cast("int")).alias("authority"),
    )


FACTS = """facts AS (SELECT d.doc_id AS id, d.text AS fact, d.source AS project, d.lang AS category,
    CASE WHEN d.doc_id % 5 = 0 THEN 'global' ELSE 'project' END AS scope_type, coalesce(l.quality, 1) = 1 AS is_active, l.toxic AS flagged,
    d.doc_id * 7 % 23 AS confirmations, d.doc_id * 13 % 120 AS age_days, d.n_chars,
    (['decision', 'human', 'tool', 'unknown'])[CAST(d.doc_id % 4 + 1 AS INTEGER)] AS authority FROM documents d LEFT JOIN labels l USING (doc_id))"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between parts and suppliers, one for each pair, from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    kinds = F.array(*map(F.lit, ("SUPPORTS", "RELATES", "CONTRADICTS", "SUPERSEDES")))
    pair = li.groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("created_at"))
    return pair.select((F.col("l_partkey") * 2).alias("source_id"), (F.col("l_suppkey") * 2 + 1).alias("target_id"), F.element_at(kinds, ((F.col("l_partkey") + F.col("l_suppkey")) % 4 + 1).cast("int")).alias("relation_type"), "created_at")


RELATIONS = """relations AS (SELECT l_partkey * 2 AS source_id, l_suppkey * 2 + 1 AS target_id,
    (['SUPPORTS', 'RELATES', 'CONTRADICTS', 'SUPERSEDES'])[CAST((l_partkey + l_suppkey) % 4 + 1 AS INTEGER)] AS relation_type, min(l_shipdate) AS created_at
    FROM lineitem GROUP BY l_partkey, l_suppkey)"""
