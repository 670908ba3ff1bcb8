"""Facts by words, by vectors or by both, and what is decided over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import graph, lanes, retrieval, scope
from threadloom.plans.base import EXCHANGES, FACTS, RELATIONS, exchanges, facts, query, relations, table

PROBES = [[round(((n * 37 + i * 11) % 17 - 8) / 34, 6) for i in range(64)] for n in range(8)]
NAMED = ("ther", "ound", "une", "nicht")


def _zip(f: str, probe: list[float]) -> str:
    return f"list_sum(list_transform(list_zip(embedding, {probe}), lambda p: {f}))"


def _distance(probe: list[float]) -> str:
    return f"sqrt({_zip('(CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])', probe)})"


def _dot(probe: list[float]) -> str:
    return _zip("CAST(p[1] AS DOUBLE) * p[2]", probe)


def _word(column: str, word: str) -> str:
    return f"regexp_matches({column}, '(^|[^A-Za-z0-9_$]){word}([^A-Za-z0-9_$]|$)', 'i')"


def distances(spark, sf_dir, probe):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), retrieval.l2(F.col("embedding"), probe).alias("distance"))


def two_indexes(spark, sf_dir):
    """Every fact has a vector of its own and, as in another language, that of the next id."""
    first = distances(spark, sf_dir, PROBES[0])
    return lanes.nearest_of_two(first, first.withColumn("id", F.col("id") + 1), "id")


_TWO = f"d1 AS (SELECT vec_id AS id, {_distance(PROBES[0])} AS distance FROM embeddings), two AS (SELECT id, min(distance) AS distance FROM (SELECT * FROM d1 UNION ALL SELECT id + 1, distance FROM d1) GROUP BY id)"
_SEEN = "is_active AND (scope_type = 'global' OR project = 'src3')"
_SEMANTIC = f"sem AS (SELECT id, 1 - distance * distance / 2 AS similarity FROM facts JOIN two USING (id) WHERE {_SEEN} AND 1 - distance * distance / 2 >= -1.5 ORDER BY distance, id LIMIT 12)"
_LEXICAL = f"lex AS (SELECT id, 2 AS lexical_score FROM facts WHERE {_SEEN} AND ({_word('fact', NAMED[0])} OR {_word('fact', NAMED[2])}) ORDER BY id LIMIT 12)"
_COMBINED = f"""comb AS (SELECT id, CASE WHEN lexical_score IS NULL THEN 'semantic' WHEN similarity IS NULL THEN 'lexical' ELSE 'both' END AS lane, lexical_score, similarity
    FROM lex FULL JOIN sem USING (id) ORDER BY lexical_score DESC NULLS LAST, similarity DESC NULLS LAST, id LIMIT 15)"""


def semantic(spark, sf_dir):
    return lanes.scoped_knn(facts(spark, sf_dir), two_indexes(spark, sf_dir), scope.in_scope("project", "src3"), -1.5, 12)


def found(spark, sf_dir):
    words = lanes.lexical(facts(spark, sf_dir), "fact", "", [NAMED[0], NAMED[2]], scope.in_scope("project", "src3"), 12)
    return lanes.combined(words, semantic(spark, sf_dir).select("id", "distance"), 15)


@query(f"WITH {_TWO} SELECT id, round(distance, 6) AS distance FROM two")
def win07_nearest_of_two(spark, sf_dir):
    return two_indexes(spark, sf_dir).select("id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, round(distance, 6) AS distance FROM (SELECT *, {_distance(PROBES[2])} AS distance FROM embeddings) ORDER BY distance, vec_id LIMIT 25")
def top01_vector_top_k(spark, sf_dir):
    return retrieval.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", PROBES[2], 25).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {FACTS}, {_TWO}, {_SEMANTIC} SELECT id, round(similarity, 6) AS similarity FROM sem")
def ret09_scoped_fact_knn(spark, sf_dir):
    return semantic(spark, sf_dir).select("id", F.round(retrieval.fact_similarity(F.col("distance")), 6).alias("similarity"))


@query(f"""WITH {FACTS} (SELECT 'named' AS kind, id, 2 AS lexical_score FROM facts WHERE {_SEEN} AND ({_word('fact', NAMED[0])} OR {_word('fact', NAMED[3])}) ORDER BY id LIMIT 40)
UNION ALL (SELECT 'literal', id, 1 FROM facts WHERE is_active AND contains(lower(fact), 'the on') ORDER BY id LIMIT 40)""")
def ret10_lexical_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    named = lanes.lexical(f, "fact", "", [NAMED[0], NAMED[3]], scope.in_scope("project", "src3"), 40).select(F.lit("named").alias("kind"), "id", "lexical_score")
    return named.unionByName(lanes.lexical(f, "fact", "The on", [], scope.in_scope("all"), 40).select(F.lit("literal").alias("kind"), "id", "lexical_score"))


@query(f"WITH {FACTS}, {_TWO}, {_SEMANTIC}, {_LEXICAL}, {_COMBINED} SELECT id, lane, lexical_score, round(similarity, 6) AS similarity FROM comb")
def ret11_combined_facts(spark, sf_dir):
    return found(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {FACTS}, {_TWO}, {_SEMANTIC}, {_LEXICAL}, {_COMBINED} SELECT id, lane, row_number() OVER (ORDER BY coalesce(lexical_score, 0) > 0 DESC, coalesce(lexical_score, 0) DESC, similarity DESC NULLS LAST, id) AS pos FROM comb""")
def top07_two_lane_order(spark, sf_dir):
    order = Window.orderBy(F.desc_nulls_last("lexical_score"), F.desc_nulls_last("similarity"), "id")
    return found(spark, sf_dir).select("id", "lane", F.row_number().over(order).cast("long").alias("pos"))


@query(f"""WITH {FACTS}, {_TWO}, {_SEMANTIC}, {_LEXICAL}, {_COMBINED}, {RELATIONS}, e AS (SELECT source_id AS id, target_id AS other, relation_type FROM relations UNION ALL SELECT target_id, source_id, relation_type FROM relations)
SELECT c.id, c.lane, f.category, count(e.other) AS n_relations, count(CASE WHEN e.relation_type = 'CONTRADICTS' THEN 1 END) AS n_against FROM comb c JOIN facts f USING (id) LEFT JOIN e USING (id) GROUP BY ALL""")
def ret14_knowledge_context(spark, sf_dir):
    hits = found(spark, sf_dir).select("id", "lane")
    near = graph.both_ways(relations(spark, sf_dir)).select(F.col("from").alias("id"), "relation_type").join(hits.select("id"), "id", "left_semi")
    counts = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation_type") == "CONTRADICTS").alias("against"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return facts(spark, sf_dir).select("id", "category").join(hits, "id").join(counts, "id", "left").select("id", "lane", "category", zero(F.col("n")).alias("n_relations"), zero(F.col("against")).alias("n_against"))


@query(f"""WITH {FACTS}, {_TWO} SELECT project, count(*) AS n, round(max(1 - distance * distance / 2), 6) AS best, arg_min(id, (distance, id)) AS nearest FROM facts JOIN two USING (id)
WHERE is_active AND project <> 'src3' AND scope_type <> 'global' AND 1 - distance * distance / 2 >= -0.5 GROUP BY project""")
def ret15_cross_project(spark, sf_dir):
    near = facts(spark, sf_dir).where(F.col("is_active") & scope.in_scope("other-projects", "src3")).join(two_indexes(spark, sf_dir), "id").withColumn("s", retrieval.fact_similarity(F.col("distance"))).where("s >= -0.5")
    return near.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("s"), 6).alias("best"), F.min(F.struct("distance", "id"))["id"].alias("nearest"))


@query(f"WITH {FACTS} SELECT a.category, a.n AS elsewhere FROM (SELECT category, count(*) AS n FROM facts WHERE is_active AND project <> 'src3' AND scope_type <> 'global' GROUP BY 1) a ANTI JOIN (SELECT category FROM facts WHERE is_active AND project = 'src3' AND confirmations > 20) b USING (category)")
def set05_other_projects(spark, sf_dir):
    f = facts(spark, sf_dir).where("is_active")
    other = f.where(scope.in_scope("other-projects", "src3")).groupBy("category").agg(F.count(F.lit(1)).alias("elsewhere"))
    return other.join(f.where("project = 'src3' and confirmations > 20").select("category"), "category", "left_anti")


@query(f"SELECT vec_id, round(greatest(-1.0, {', '.join(map(_dot, PROBES))}), 6) AS baseline FROM embeddings")
def ret21_baseline(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(lanes.baseline(F.col("embedding"), PROBES), 6).alias("baseline"))


@query(f"""WITH g AS (SELECT vec_id, label, {_dot(PROBES[1])} - greatest({', '.join(map(_dot, PROBES[2:5]))}) AS gap, vec_id % 10 = 0 AS by_words FROM embeddings)
SELECT label, count(*) AS n, count(CASE WHEN by_words OR gap >= 0.045 THEN 1 END) AS kept, count(CASE WHEN NOT by_words AND gap >= 0.045 THEN 1 END) AS passed, round(max(CASE WHEN NOT by_words THEN gap END), 4) AS closest FROM g GROUP BY label""")
def ret22_margin_gate(spark, sf_dir):
    v = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("label", retrieval.dot(v, F.array(*map(F.lit, PROBES[1]))).alias("s"), F.greatest(*(retrieval.dot(v, F.array(*map(F.lit, p))) for p in PROBES[2:5])).alias("b"), F.when(F.col("vec_id") % 10 == 0, 2).alias("lexical_score"))
    rows = rows.withColumn("keep", lanes.clears_margin(F.col("s"), F.col("b"), F.col("lexical_score")))
    judged = F.col("lexical_score").isNull()
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"), F.count_if(judged & F.col("keep")).alias("passed"), F.round(F.max(F.when(judged, F.col("s") - F.col("b"))), 4).alias("closest"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 127) AS BIGINT))) AS BIGINT) AS int8_sum, round(list_max(list_transform(embedding, lambda x: abs(round(CAST(x AS DOUBLE) * 127) / 127 - CAST(x AS DOUBLE)))), 6) AS worst FROM embeddings")
def ret24_int8_scale(spark, sf_dir):
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 127))
    worst = F.array_max(F.zip_with(whole, F.col("embedding"), lambda q, x: F.abs(q / 127 - x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("int8_sum"), F.round(worst, 6).alias("worst"))


_CONCEPTS = " UNION ALL ".join(f"(SELECT label, vec_id, {n} AS concept, {_distance(PROBES[n])} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 40)" for n in range(3))


@query(f"""WITH near AS ({_CONCEPTS}), b AS (SELECT label, concept, min(distance) AS distance, arg_min(vec_id, (distance, vec_id)) AS vec_id FROM near GROUP BY 1, 2)
SELECT label, round(avg(distance), 6) AS mean_distance, min(CASE WHEN concept = 0 THEN vec_id END) AS representative FROM b GROUP BY label HAVING count(*) = 3 ORDER BY avg(distance), label LIMIT 8""")
def ret08_concepts_in_groups(spark, sf_dir):
    return lanes.concepts_together(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", PROBES[:3], 8).withColumn("mean_distance", F.round("mean_distance", 6))


def turn_rows(spark, sf_dir):
    return exchanges(spark, sf_dir).select("id", "session_id", "project", "timestamp", "user_message", "assistant_message", "line_start")


@query(f"""WITH {EXCHANGES}, d AS (SELECT vec_id AS session_id, {_distance(PROBES[3])} AS distance FROM embeddings), near AS (SELECT session_id AS sid, distance, 1 - distance * distance / 2 AS similarity FROM d ORDER BY distance, session_id LIMIT 90),
x AS (SELECT * FROM exchanges WHERE line_start = 0 AND project = 'p3')
SELECT sid AS session_id, substr(user_message, 1, 200) AS user_message, substr(array_to_string(list_filter(string_split(assistant_message, chr(10)), lambda l: length(trim(l)) > 10)[1:3], chr(10)), 1, 300) AS summary, round(similarity, 6) AS similarity
FROM near JOIN x ON x.session_id = sid WHERE similarity >= -2 ORDER BY near.similarity DESC, sid LIMIT 30""")
def ret13_repeats(spark, sf_dir):
    hits = distances(spark, sf_dir, PROBES[3]).withColumnRenamed("id", "session_id")
    return lanes.repeats(hits, turn_rows(spark, sf_dir).where("line_start = 0"), "session_id", "p3", 30, -2.0).withColumn("similarity", F.round("similarity", 6))


# Words of the given conversations; documents hold the last of them.
SAID = ("ndessh", "thanines", "wasererornd", "ther")


@query(f"""WITH {FACTS}, {EXCHANGES}, w AS (SELECT unnest({list(SAID)}) AS word), said AS (SELECT w.word, x.id, timestamp, user_message FROM exchanges x, w WHERE regexp_matches(user_message, '(^|[^A-Za-z0-9_$])' || word || '([^A-Za-z0-9_$]|$)', 'i')),
known AS (SELECT DISTINCT word FROM facts, w WHERE is_active AND regexp_matches(fact, '(^|[^A-Za-z0-9_$])' || word || '([^A-Za-z0-9_$]|$)', 'i'))
SELECT word, id, substr(user_message, 1, 160) AS snippet FROM said ANTI JOIN known USING (word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY timestamp DESC, id) <= 2""")
def ret12_uncovered_in_turns(spark, sf_dir):
    return lanes.uncovered_in_turns(turn_rows(spark, sf_dir), facts(spark, sf_dir), list(SAID))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS row_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2)) AS token FROM conversations),
h AS (SELECT row_id, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split(token, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM t),
s AS (SELECT row_id, bucket, sum(w) AS w FROM (SELECT row_id, h % 384 AS bucket, 1.0::DOUBLE AS w FROM h UNION ALL SELECT row_id, (h >> 8) % 384, 0.5::DOUBLE FROM h) GROUP BY 1, 2)
SELECT row_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM s""")
def ret19_hashed_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return lanes.hashed_words(rows, "row_id", "text").withColumn("weight", F.round("weight", 6))


@query("""WITH w AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, user_id FROM events)
SELECT user_id, event_id FROM w WHERE n <= 7 OR pos IN (SELECT floor(i * (n - 1) / 6 + 0.5) FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i))""")
def win10_even_spread(spark, sf_dir):
    return lanes.spread(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 7).select("user_id", "event_id")


@query("""WITH l AS (SELECT l_partkey * 2 AS s, l_suppkey * 2 + 1 AS t, (['SUPPORTS', 'RELATES', 'CONTRADICTS', 'SUPERSEDES'])[CAST(l_linenumber % 4 + 1 AS INTEGER)] AS relation_type, l_shipdate AS created_at FROM lineitem), e AS (SELECT s AS node, t AS neighbour, relation_type, created_at FROM l UNION ALL SELECT t, s, relation_type, created_at FROM l)
SELECT node, neighbour, relation_type FROM e QUALIFY row_number() OVER (PARTITION BY node, neighbour ORDER BY CASE relation_type WHEN 'CONTRADICTS' THEN 0 WHEN 'SUPERSEDES' THEN 1 WHEN 'SUPPORTS' THEN 2 ELSE 3 END, created_at, relation_type) = 1""")
def win03_edge_priority(spark, sf_dir):
    # Every line is an edge of its own, so a pair has several, of different types.
    kinds = F.array(*map(F.lit, ("SUPPORTS", "RELATES", "CONTRADICTS", "SUPERSEDES")))
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("source_id"), (F.col("l_suppkey") * 2 + 1).alias("target_id"), F.element_at(kinds, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("relation_type"), F.col("l_shipdate").alias("created_at"))
    return graph.edge_per_neighbour(edges)


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40")
def top08_last_of_each(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 40").select("user_id", "event_id", "ts")


@query(f"WITH {FACTS} SELECT id, age_days FROM facts WHERE is_active AND confirmations = 0 ORDER BY age_days DESC, id LIMIT 50")
def top09_pending_drain(spark, sf_dir):
    return facts(spark, sf_dir).where("is_active and confirmations = 0").orderBy(F.desc("age_days"), "id").limit(50).select("id", "age_days")


@query(f"WITH {EXCHANGES} SELECT id, session_id, timestamp FROM exchanges WHERE timestamp > '2024-01-03T00:00:00.000Z'")
def top10_new_since(spark, sf_dir):
    return exchanges(spark, sf_dir).where("timestamp > '2024-01-03T00:00:00.000Z'").select("id", "session_id", "timestamp")


@query("""WITH p AS (SELECT url AS raw, 'page' AS origin FROM pages UNION ALL SELECT 'https://' || source || '.net/', 'document' FROM documents) SELECT DISTINCT coalesce(regexp_extract(raw, '://([^/?#]*)', 1), '') AS host, origin FROM p""")
def set01_distinct_sources(spark, sf_dir):
    host = F.coalesce(F.regexp_extract("raw", "://([^/?#]*)", 1), F.lit("")).alias("host")
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("raw"), F.lit("page").alias("origin"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("https://"), "source", F.lit(".net/")).alias("raw"), F.lit("document").alias("origin"))
    return pages.unionByName(docs).select(host, "origin").distinct()


@query("""SELECT page_id, regexp_matches(url, '[A-Za-z0-9_$.-]+[\\\\/]+[A-Za-z0-9_$.-]+') OR regexp_matches(url, '^\\S*\\.[A-Za-z0-9]+$') AS named FROM pages""")
def flt24_names_exactly(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", lanes.names_exactly(F.col("url")).alias("named"))
