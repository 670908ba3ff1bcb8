"""Full text, vectors, hybrid retrieval, the gate and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import gate, graph, retrieval
from threadloom.plans.base import EXCHANGES, RELATIONS, exchanges, query, relations, table

WORDS = ["that", "with", "from", "thing"]
PROBE = [((i * 37) % 19 - 9) / 40.0 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(map(repr, PROBE)) + "]"
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_WORDS_SQL = "(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
_HITS = f"""toks AS (SELECT doc_id, {_TOKENS} AS t FROM documents), hit AS (SELECT doc_id, token, count(*) AS tf, max(n) AS doc_len FROM (SELECT doc_id, unnest(t) AS token, len(t) AS n FROM toks) WHERE token IN {_WORDS_SQL} GROUP BY 1, 2),
dfs AS (SELECT token, count(*) AS df FROM hit GROUP BY token)"""
_BM25 = f"""{_HITS}, sz AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks), scored AS (SELECT doc_id, count(*) AS n_tokens, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score FROM hit JOIN dfs USING (token), sz GROUP BY doc_id)"""


@query(f"WITH {_BM25} SELECT doc_id, n_tokens, round(score, 6) AS score FROM scored")
def ret02_bm25(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS).select("doc_id", "n_tokens", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored WHERE n_tokens = {len(WORDS)} ORDER BY 2 DESC, doc_id LIMIT 20")
def top02_ranked_and(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS, all_words=True).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH {_HITS}, rare AS (SELECT token, row_number() OVER (ORDER BY df, token) AS r FROM dfs), held AS (SELECT doc_id, list(r) AS rs FROM hit JOIN rare USING (token) GROUP BY doc_id),
rung AS (SELECT doc_id, CASE WHEN len(rs) = {len(WORDS)} THEN 0 WHEN list_has_all(rs, [1, 2, 3]) THEN 2 WHEN list_has_all(rs, [1, 2]) THEN 3 ELSE 4 END AS rung FROM held),
n AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY doc_id) AS pos FROM rung) SELECT doc_id, CAST(rung AS INTEGER) AS rung FROM n ORDER BY pos > 10, rung, pos LIMIT 20""")
def ret03_rarest_ladder(spark, sf_dir):
    return retrieval.ladder(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS, 20)


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'ther and') ORDER BY doc_id DESC LIMIT 50""")
def ret05_substring_fallback(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("ther and"))).orderBy(F.desc("doc_id")).limit(50).select("doc_id", "source")


_KNN = f"SELECT vec_id, label, sqrt(list_sum(list_transform(list_zip(embedding, {_PROBE_SQL}), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) AS distance FROM embeddings"


@query(f"WITH k AS ({_KNN} WHERE label % 2 = 0 ORDER BY distance, vec_id LIMIT 15) SELECT vec_id, label, round(distance, 6) AS distance, round(1 - distance, 6) AS conversation_score, round(1 - distance * distance / 2, 6) AS fact_score FROM k")
def ret01_filtered_knn(spark, sf_dir):
    k = retrieval.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", PROBE, 15, F.col("label") % 2 == 0)
    return k.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round(retrieval.conversation_similarity(F.col("distance")), 6).alias("conversation_score"), F.round(retrieval.fact_similarity(F.col("distance")), 6).alias("fact_score"))


@query(f"""WITH {_BM25}, v AS (SELECT vec_id AS doc_id, distance, 0 AS lane, row_number() OVER (ORDER BY distance, vec_id) AS pos FROM ({_KNN} ORDER BY distance, vec_id LIMIT 10)),
x AS (SELECT doc_id, 0.0 AS distance, 1 AS lane, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 10)), a AS (SELECT * FROM v UNION ALL SELECT * FROM x),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lane, pos) = 1) SELECT doc_id, CAST(lane AS INTEGER) AS lane, round(1 - distance, 6) AS similarity FROM f ORDER BY lane, pos LIMIT 15""")
def ret06_hybrid_merge(spark, sf_dir):
    v = retrieval.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", PROBE, 10).withColumnRenamed("vec_id", "doc_id")
    t = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS).orderBy(F.desc("score"), "doc_id").limit(10)
    return retrieval.hybrid(v, t, "doc_id", 15).select("doc_id", "lane", F.round("similarity", 6).alias("similarity"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS snippet FROM f""")
def ret07_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.snippet(F.col("text")).alias("snippet"))


@query(f"""WITH {_HITS} SELECT source, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS hits FROM hit GROUP BY doc_id HAVING count(*) = {len(WORDS)}) JOIN documents USING (doc_id) GROUP BY source""")
def set03_concepts_together(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    both = retrieval.matches(d, "doc_id", "text", WORDS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("tf").alias("hits")).where(F.col("k") == len(WORDS))
    return both.join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"))


@query("""WITH m AS (SELECT label, list_transform(range(1, 65), lambda i: i) AS idx FROM embeddings GROUP BY label), e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 5) AS mean FROM e GROUP BY label, i""")
def ret17_category_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("""WITH b AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS c FROM embeddings, b)
SELECT vec_id, round(c, 5) AS cosine, c >= 0.5 AS near FROM s""")
def ret23_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    c = retrieval.cosine(F.col("embedding"), F.col("q"))
    return e.join(F.broadcast(q), how="inner").select("vec_id", F.round(c, 5).alias("cosine"), (c >= 0.5).alias("near"))


@query(f"""WITH {EXCHANGES} SELECT id, 'User: ' || user_message || chr(10) || 'Assistant: ' || assistant_message AS text FROM exchanges""")
def ret20_exchange_text(spark, sf_dir):
    return exchanges(spark, sf_dir).select("id", F.concat(F.lit("User: "), "user_message", F.lit("\nAssistant: "), "assistant_message").alias("text"))


@query("""SELECT conv_id, turn, CAST(ceil((length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) * 0.25 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))) * 1.25) AS BIGINT) AS tokens FROM conversations""")
def gat11_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gate.token_estimate(F.col("text")).alias("tokens"))


_SEEDS = "(SELECT p_partkey * 2 AS id FROM part WHERE p_size = 7 AND p_brand = 'Brand#11')"
_FACTOR = "CASE WHEN relation_type IN ('SUPPORTS', 'INFLUENCES') THEN 1.0 ELSE 0.7 END"


_P = "CASE relation_type WHEN 'CONTRADICTS' THEN 0 WHEN 'SUPERSEDES' THEN 1 WHEN 'SUPPORTS' THEN 2 ELSE 3 END"
_SHOWN = "round(CAST(@ AS DOUBLE), 6) AS relevance, relation_type, f AS via"


# A hop takes its nodes in the order of the queue: seeds by id, then as they were found.
@query(f"""WITH {RELATIONS}, s AS {_SEEDS}, ways AS (SELECT source_id AS f, target_id AS t, 0 AS side, {_P} AS p, relation_type, created_at FROM relations UNION ALL SELECT target_id, source_id, 1, {_P}, relation_type, created_at FROM relations),
h1 AS (SELECT * FROM ways WHERE f IN (SELECT id FROM s) AND t NOT IN (SELECT id FROM s) QUALIFY row_number() OVER (PARTITION BY t ORDER BY f, side, p, created_at) = 1),
q AS (SELECT t AS node, row_number() OVER (ORDER BY f, side, p, created_at, t) AS place FROM h1),
h2 AS (SELECT ways.* FROM ways JOIN q ON node = f WHERE t NOT IN (SELECT id FROM s UNION ALL SELECT t FROM h1) QUALIFY row_number() OVER (PARTITION BY t ORDER BY place, side, p, created_at) = 1)
SELECT t AS id, CAST(1 AS INTEGER) AS hop, {_SHOWN.replace("@", _FACTOR)} FROM h1 UNION ALL SELECT t, CAST(2 AS INTEGER), {_SHOWN.replace("@", f"0.6 * {_FACTOR}")} FROM h2""")
def grf01_bounded_expansion(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").where("p_size = 7 and p_brand = 'Brand#11'").select((F.col("p_partkey") * 2).alias("id"))
    return graph.expand(relations(spark, sf_dir), seeds, 2).withColumn("relevance", F.round("relevance", 6))


@query(f"WITH {RELATIONS} SELECT source_id, target_id, relation_type FROM relations WHERE source_id = 20 OR target_id = 21 ORDER BY created_at DESC, source_id, target_id LIMIT 50")
def grf05_relations_of(spark, sf_dir):
    return relations(spark, sf_dir).where("source_id = 20 or target_id = 21").orderBy(F.desc("created_at"), "source_id", "target_id").limit(50).select("source_id", "target_id", "relation_type")


@query("""SELECT r_name AS domain, n_name AS category, count(*) OVER (PARTITION BY r_name, n_name) AS n_facts, s_name AS fact FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def grf06_taxonomy_tree(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.taxonomy(s.select(F.col("r_name").alias("domain"), F.col("n_name").alias("category"), F.col("s_name").alias("fact")))


@query(f"""WITH {RELATIONS}, n AS (SELECT p_partkey * 2 AS id FROM part WHERE p_size < 10 UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier WHERE s_acctbal > 0) SELECT source_id, target_id, relation_type FROM relations WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""")
def grf08_subgraph(spark, sf_dir):
    n = table(spark, sf_dir, "part").where("p_size < 10").select((F.col("p_partkey") * 2).alias("id")).unionByName(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") * 2 + 1).alias("id")))
    return graph.inside(relations(spark, sf_dir), n).select("source_id", "target_id", "relation_type")


@query(f"""WITH {RELATIONS}, n AS (SELECT p_partkey * 2 AS id, p_size % 3 AS g FROM part UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey % 3 FROM supplier) SELECT relation_type, count(*) AS refused FROM relations JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE a.g <> b.g GROUP BY 1""")
def grf04_cross_project_guard(spark, sf_dir):
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"), (F.col("p_size") % 3).alias("g")).unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), (F.col("s_nationkey") % 3).alias("g")))
    return graph.crossing(relations(spark, sf_dir), n, "g").groupBy("relation_type").agg(F.count(F.lit(1)).alias("refused"))
