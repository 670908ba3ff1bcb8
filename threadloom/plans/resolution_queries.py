"""Scopes that callers state, slots on save, provenance, batches to classify, and joins of hits with what they hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import classification, history, resolution, retrieval
from threadloom.plans.base import EXCHANGES, FACTS, exchanges, facts, query, table

KINDS = ("project-id", "workspace-id", "workstream-id", "session-id", "global", "other-project-id", "everything")


def named(prefix: str, number):
    return F.concat(F.lit(prefix), number.cast("string"))


@query(f"""WITH r AS (SELECT o_orderkey AS request_id, ({list(KINDS)})[CAST(o_orderkey % 7 + 1 AS INTEGER)] AS type, CASE WHEN o_orderkey % 19 <> 0 THEN 'p' || (o_custkey % 25) END AS project_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'w' || (o_custkey % 50) END AS workspace_id, CASE WHEN o_orderkey % 23 <> 0 THEN 't' || (o_custkey % 40) END AS workstream_id, 's' || o_custkey AS session_id FROM orders),
w AS (SELECT 'w' || s_suppkey AS id, 'p' || (CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey ELSE s_suppkey % 25 END) AS project FROM supplier), t AS (SELECT 't' || p_partkey AS id, 'p' || (p_partkey % 25) AS project FROM part), s AS (SELECT 's' || c_custkey AS id, 'p' || (CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE c_custkey % 25 END) AS project FROM customer),
j AS (SELECT r.*, w.project AS wp, t.project AS tp, s.project AS sp FROM r LEFT JOIN w ON w.id = workspace_id LEFT JOIN t ON t.id = workstream_id LEFT JOIN s ON s.id = session_id)
SELECT request_id, CASE WHEN type = 'everything' THEN 'unknown scope' WHEN type <> 'global' AND project_id IS NULL THEN 'project_id is required'
WHEN type = 'workspace-id' AND workspace_id IS NULL THEN 'workspace_id is required' WHEN type = 'workspace-id' AND wp IS DISTINCT FROM project_id THEN 'workspace_id is outside the project'
WHEN type = 'workstream-id' AND workstream_id IS NULL THEN 'workstream_id is required' WHEN type = 'workstream-id' AND tp IS DISTINCT FROM project_id THEN 'workstream_id is outside the project'
WHEN type = 'session-id' AND sp IS DISTINCT FROM project_id THEN 'session_id is outside the project'
WHEN type = 'workstream-id' AND workspace_id IS NOT NULL AND wp IS DISTINCT FROM project_id THEN 'workspace_id is outside the project' END AS problem FROM j""")
def flt06_scope_validation(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    scopes = table(spark, sf_dir, "orders").select(
        o.alias("request_id"), F.element_at(F.array(*map(F.lit, KINDS)), (o % 7 + 1).cast("int")).alias("type"), F.when(o % 19 != 0, named("p", c % 25)).alias("project_id"),
        F.when(o % 3 != 0, named("w", c % 50)).alias("workspace_id"), F.when(o % 23 != 0, named("t", c % 40)).alias("workstream_id"), named("s", c).alias("session_id"),
    )
    k = F.col("s_suppkey")
    owners = table(spark, sf_dir, "supplier").select(F.lit("workspace_id").alias("kind"), named("w", k).alias("id"), named("p", F.when(k % 5 == 0, F.col("s_nationkey")).otherwise(k % 25)).alias("project_id"))
    owners = owners.unionByName(table(spark, sf_dir, "part").select(F.lit("workstream_id").alias("kind"), named("t", F.col("p_partkey")).alias("id"), named("p", F.col("p_partkey") % 25).alias("project_id")))
    k = F.col("c_custkey")
    owners = owners.unionByName(table(spark, sf_dir, "customer").select(F.lit("session_id").alias("kind"), named("s", k).alias("id"), named("p", F.when(k % 3 == 0, F.col("c_nationkey")).otherwise(k % 25)).alias("project_id")))
    return resolution.check_scopes(scopes, owners)


ASKED = ("project", "workspace", "workstream", "session", "global", "all", "team", None)


@query(f"""WITH pl AS (SELECT 's' || c_custkey AS session_id, 't' || (c_custkey % 300) AS workstream_id, 'w' || (c_custkey % 100) AS workspace_id, 'p' || (c_custkey % 25) AS project_id, '/w/' || (c_custkey % 100) AS path FROM customer),
a AS (SELECT o_orderkey AS request_id, ({str(list(ASKED)).replace('None', 'NULL')})[CAST(o_orderkey // 8 % 8 + 1 AS INTEGER)] AS scope, CASE WHEN o_orderkey % 5 = 1 THEN '/w/' || (o_custkey % 120) END AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_custkey % 26) END AS project_id,
    CASE WHEN o_orderkey % 7 < 2 THEN 'w' || ((o_custkey + o_orderkey % 2) % 100) END AS workspace_id, CASE WHEN o_orderkey % 11 < 4 THEN 't' || (o_custkey % 301) END AS workstream_id, CASE WHEN o_orderkey % 13 < 5 THEN 's' || (o_custkey + o_orderkey % 4 // 3 * 1000000) END AS session_id FROM orders),
w AS (SELECT workspace_id, min(project_id) AS wp FROM pl GROUP BY 1), t AS (SELECT workstream_id, min(project_id) AS tp, min(workspace_id) AS tw FROM pl GROUP BY 1), s AS (SELECT session_id, project_id AS sp, workspace_id AS sw, workstream_id AS st FROM pl),
pa AS (SELECT path, min(project_id) AS pp FROM pl GROUP BY 1), kn AS (SELECT DISTINCT project_id AS kp FROM pl),
j AS (SELECT a.*, coalesce(scope, 'project') AS sc, wp, tp, tw, sp, sw, st, pp, kp FROM a LEFT JOIN w USING (workspace_id) LEFT JOIN t USING (workstream_id) LEFT JOIN s USING (session_id) LEFT JOIN pa ON pa.path = a.project LEFT JOIN kn ON kp = a.project_id),
e AS (SELECT *, coalesce(project_id, pp) AS own, sc = 'project' AND project_id IS NULL AND pp IS NULL AS unmapped FROM j),
f AS (SELECT *, CASE WHEN sc NOT IN ('project', 'workspace', 'workstream', 'session', 'global', 'all') THEN 'unknown scope'
    WHEN sc IN ('global', 'all') THEN CASE WHEN coalesce(project, project_id, workspace_id, workstream_id, session_id) IS NOT NULL THEN 'scope cannot be combined with an identity' END
    WHEN sc <> 'project' AND project IS NOT NULL THEN 'a path cannot be combined with this scope'
    WHEN sc = 'session' THEN CASE WHEN session_id IS NULL THEN 'session_id is required' WHEN sp IS NULL THEN 'unknown session_id' WHEN project_id <> sp THEN 'session_id is outside project_id' WHEN workspace_id <> sw THEN 'session_id is outside workspace_id' WHEN workstream_id <> st THEN 'session_id is outside workstream_id' END
    WHEN sc = 'workstream' THEN CASE WHEN workstream_id IS NULL THEN 'workstream_id is required' WHEN tp IS NULL THEN 'unknown workstream_id' WHEN project_id <> tp THEN 'workstream_id is outside project_id' WHEN workspace_id <> tw THEN 'workstream_id is outside workspace_id' WHEN session_id IS NOT NULL AND st IS DISTINCT FROM workstream_id THEN 'session_id is outside workstream_id' END
    WHEN sc = 'workspace' THEN CASE WHEN workspace_id IS NULL THEN 'workspace_id is required' WHEN wp IS NULL THEN 'unknown workspace_id' WHEN project_id <> wp THEN 'workspace_id is outside project_id' WHEN workstream_id IS NOT NULL AND tw IS DISTINCT FROM workspace_id THEN 'workstream_id is outside workspace_id' WHEN session_id IS NOT NULL AND sw IS DISTINCT FROM workspace_id THEN 'session_id is outside workspace_id' END
    WHEN project_id IS NOT NULL AND project IS NOT NULL THEN 'project_id or path, not both' WHEN project_id IS NOT NULL AND kp IS NULL THEN 'unknown project_id' WHEN project_id IS NULL AND project IS NULL THEN 'project is required'
    WHEN unmapped THEN NULL WHEN workspace_id IS NOT NULL AND wp IS DISTINCT FROM own THEN 'workspace_id is outside project_id' WHEN workstream_id IS NOT NULL AND tp IS DISTINCT FROM own THEN 'workstream_id is outside project_id' WHEN session_id IS NOT NULL AND sp IS DISTINCT FROM own THEN 'session_id is outside project_id' END AS problem FROM e)
SELECT request_id, CASE WHEN problem IS NULL THEN CASE WHEN sc IN ('global', 'all') THEN sc WHEN unmapped THEN 'fact-ids' ELSE sc || '-id' END END AS type, CASE WHEN problem IS NULL THEN CASE sc WHEN 'session' THEN sp WHEN 'workstream' THEN tp WHEN 'workspace' THEN wp WHEN 'project' THEN own END END AS project_id, problem FROM f""")
def flt07_scope_resolution(spark, sf_dir):
    o, c, k = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(named("s", k).alias("session_id"), named("t", k % 300).alias("workstream_id"), named("w", k % 100).alias("workspace_id"), named("p", k % 25).alias("project_id"), named("/w/", k % 100).alias("path"), F.timestamp_seconds(k).alias("seen_at"))
    asked = table(spark, sf_dir, "orders").select(
        o.alias("request_id"), F.element_at(F.array(*(F.lit(x) if x else F.lit(None).cast("string") for x in ASKED)), (F.floor(o / 8) % 8 + 1).cast("int")).alias("scope"), F.when(o % 5 == 1, named("/w/", c % 120)).alias("project"), F.when(o % 3 == 0, named("p", c % 26)).alias("project_id"),
        F.when(o % 7 < 2, named("w", (c + o % 2) % 100)).alias("workspace_id"), F.when(o % 11 < 4, named("t", c % 301)).alias("workstream_id"), F.when(o % 13 < 5, named("s", c + F.when(o % 4 == 3, 1000000).otherwise(0))).alias("session_id"),
    )
    return resolution.resolve_scopes(asked, places)


@query(f"""WITH {FACTS}, p AS (SELECT s_suppkey AS request_id, '/a/src' || s_suppkey AS path FROM supplier WHERE s_suppkey < 6), f AS (SELECT *, '/a/' || project AS own FROM facts)
SELECT 'project' AS kind, request_id, id FROM f, p WHERE scope_type = 'global' OR own = path UNION ALL SELECT 'exact-project', request_id, id FROM f, p WHERE scope_type = 'project' AND own = path UNION ALL SELECT 'other-projects', request_id, id FROM f, p WHERE scope_type = 'project' AND own <> path""")
def flt08_legacy_paths(spark, sf_dir):
    f, own = facts(spark, sf_dir), F.concat(F.lit("/a/"), "project")
    paths = table(spark, sf_dir, "supplier").where("s_suppkey < 6").select(F.col("s_suppkey").alias("request_id"), named("/a/src", F.col("s_suppkey")).alias("path"))
    out = None
    for kind in ("project", "exact-project", "other-projects"):
        part = resolution.legacy_facts(f, paths, own, kind).select(F.lit(kind).alias("kind"), "request_id", "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH t0 AS (SELECT min(ts) AS t0 FROM events), h AS (SELECT s_suppkey AS u, CASE WHEN s_suppkey % 2 = 0 THEN 'click' ELSE 'view' END AS kind, 'h' || s_suppkey AS holder, 'k' || (s_suppkey % 5) AS text, t0 + to_hours(s_suppkey * 12) AS c_at, CAST(s_suppkey % 3 AS INTEGER) AS rank FROM supplier, t0),
c AS (SELECT event_id, user_id AS u, event_type AS kind, 'k' || (event_id % 5) AS text, ts AS c_at, (['decision', 'human', 'tool', 'unknown'])[CAST(event_id % 4 + 1 AS INTEGER)] AS authority, CASE event_id % 4 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS rank FROM events),
j AS (SELECT c.*, holder, h.text AS h_text, h.c_at AS h_at, CASE h.rank WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS h_rank, row_number() OVER w AS n, first(c.text) OVER w AS f_text, first(c.c_at) OVER w AS f_at, first(c.rank) OVER w AS f_rank FROM c LEFT JOIN h ON h.u = c.u AND h.kind = c.kind WINDOW w AS (PARTITION BY c.u, c.kind ORDER BY c.c_at, c.event_id)),
k AS (SELECT *, CASE WHEN holder IS NULL THEN f_text ELSE h_text END AS p_text, CASE WHEN holder IS NULL THEN f_at ELSE h_at END AS p_at, CASE WHEN holder IS NULL THEN f_rank ELSE h_rank END AS p_rank FROM j)
SELECT event_id AS candidate_id, holder, CASE WHEN holder IS NULL AND n = 1 THEN 'new' WHEN text = p_text THEN 'merge' WHEN c_at > p_at AND rank >= p_rank THEN 'change' WHEN c_at > p_at THEN 'contradicted' WHEN c_at < p_at THEN 'historical' ELSE 'contradicted' END AS outcome FROM k""")
def ext03_save_facts(spark, sf_dir):
    e, s = table(spark, sf_dir, "events"), F.col("s_suppkey")
    start = e.agg(F.min("ts").alias("t0"))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    held = table(spark, sf_dir, "supplier").join(F.broadcast(start), how="cross").select(s.alias("user_id"), F.when(s % 2 == 0, "click").otherwise("view").alias("event_type"), named("h", s).alias("id"), named("k", s % 5).alias("text"), (F.col("t0") + F.make_dt_interval(hours=(s * 12).cast("int"))).alias("effective_at"), pick(("decision", "human", "unknown"), s % 3).alias("authority"))
    k = F.col("event_id")
    candidates = e.select(k.alias("candidate_id"), "user_id", "event_type", named("k", k % 5).alias("text"), F.col("ts").alias("effective_at"), pick(("decision", "human", "tool", "unknown"), k % 4).alias("authority"))
    return resolution.save_facts(candidates, held, ["user_id", "event_type"])


@query(f"""WITH {FACTS}, f AS (SELECT id, unnest([id % 60, id * 3 % 190]) AS ref, id % 150 AS subject FROM facts WHERE flagged = 1), g AS (SELECT DISTINCT id, subject FROM f), s AS (SELECT conv_id AS ref, max(turn) AS "at" FROM conversations GROUP BY 1)
SELECT id, 'source' AS kind, ref, "at" FROM (SELECT DISTINCT id, ref FROM f) LEFT JOIN s USING (ref) UNION ALL SELECT id, 'revision', event_id, epoch(date_trunc('second', ts))::BIGINT FROM g JOIN events ON event_id % 1000 = id UNION ALL SELECT id, 'incident', event_id, epoch(date_trunc('second', ts))::BIGINT FROM g JOIN events ON user_id = subject AND event_type = 'error' UNION ALL SELECT id, 'hot', event_id, epoch(date_trunc('second', ts))::BIGINT FROM g JOIN events ON user_id = subject AND event_type = 'purchase'""")
def chr21_provenance_trace(spark, sf_dir):
    d, e = F.col("id"), table(spark, sf_dir, "events")
    chosen = facts(spark, sf_dir).where("flagged = 1").select("id", F.array_distinct(F.array(d % 60, d * 3 % 190)).alias("sources"), (d % 150).alias("subject"))
    sources = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("ref")).agg(F.max("turn").alias("at"))
    at = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp")).alias("at")
    by = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("subject"), F.col("event_id").alias("ref"), at)
    return resolution.trace(chosen, sources, e.select((F.col("event_id") % 1000).alias("id"), F.col("event_id").alias("ref"), at), by("error"), by("purchase"))


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(f"""WITH {FACTS}, v AS (SELECT id, category, is_active, confirmations, embedding AS v FROM facts JOIN embeddings ON vec_id = id), s AS (SELECT n.id, o.id AS other, round({_dot('o.v', 'n.v')}, 9) AS similarity FROM v n JOIN v o ON o.category = n.category AND o.id <> n.id AND o.is_active AND n.confirmations = 0)
SELECT id, other, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) <= 2""")
def grf09_relation_candidates(spark, sf_dir):
    v = facts(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    # The vectors given point in random directions, so the threshold is far below that of a trained encoder.
    return classification.relation_candidates(v.where("confirmations = 0"), v, ["category"], threshold=0.1).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label AS category, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id AS id, category, round({_dot('embedding', 'c')}, 9) AS s FROM embeddings, c), t AS (SELECT id, array_to_string(list(category ORDER BY s DESC, category), ',') AS candidates FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, category) <= 8) GROUP BY 1),
p AS (SELECT vec_id AS id, vec_id % 3 + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS attempts, (row_number() OVER (ORDER BY vec_id) - 1) // 50 AS batch FROM embeddings)
SELECT id, batch, candidates, CASE id % 5 WHEN 1 THEN 'held' WHEN 0 THEN CASE WHEN attempts >= 3 THEN 'parked' ELSE 'retry' END ELSE 'classified' END AS result, attempts FROM p JOIN t USING (id)""")
def grf10_classification_batches(spark, sf_dir):
    e, k = table(spark, sf_dir, "embeddings"), F.col("id")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy(F.col("label").alias("category")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("v"))
    pending = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 3).alias("attempts"))
    out = classification.classification_batches(pending, centres, F.when(k % 5 == 0, "failed").when(k % 5 == 1, "transient").otherwise("ok"))
    return out.withColumn("candidates", F.array_join("candidates", ","))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, turn, conv_id, text, substr(text, 1, 30) || CASE WHEN turn % 5 = 4 THEN '#' ELSE '' END AS span, CASE turn % 3 WHEN 0 THEN 'incident' WHEN 1 THEN 'validated' ELSE 'remark' END AS observation, CASE WHEN turn % 2 = 0 THEN 'test_execution' ELSE 'repeated_signal' END AS kind,
CASE WHEN conv_id % 2 = 0 THEN substr(text, 3, 20) ELSE 'paraphrased words' END AS said, (turn % 6) / 10.0 + 0.5 AS confidence FROM conversations),
j AS (SELECT *, coalesce(conv_id % 9 <> 0 AND length(span) BETWEEN 5 AND 200 AND contains(text, span), false) AS sound, trim(said, ' ') AS proposed FROM c),
k AS (SELECT *, CASE WHEN observation = 'incident' THEN CASE WHEN contains(text, said) AND proposed <> '' THEN proposed ELSE span END END AS signature FROM j)
SELECT id AS candidate_id, observation, CASE WHEN problem IS NULL THEN signature END AS signature, problem FROM (SELECT *, CASE WHEN observation = 'remark' THEN 'kind' WHEN length(trim(substr(text, 1, 20), ' ')) < 4 THEN 'summary' WHEN NOT confidence BETWEEN 0.7 AND 1.0 THEN 'confidence' WHEN NOT sound THEN 'evidence'
    WHEN observation = 'incident' AND kind <> 'test_execution' AND turn % 4 <> 3 THEN 'unproven' WHEN observation = 'validated' AND NOT (kind = 'test_execution' AND turn % 8 <> 4) THEN 'not passed' WHEN observation = 'incident' AND length(signature) < 4 THEN 'signature' END AS problem FROM k)""")
def dat10_check_observations(spark, sf_dir):
    c, t, k = table(spark, sf_dir, "conversations"), F.col("turn"), F.col("conv_id")
    c = c.withColumn("ref", k * 1000 + t)
    candidates = c.select(
        F.col("ref").alias("candidate_id"), F.when(t % 3 == 0, "incident").when(t % 3 == 1, "validated").otherwise("remark").alias("observation"), F.substring("text", 1, 20).alias("summary"), ((t % 6).cast("decimal(9,1)") / 10 + F.lit(0.5).cast("decimal(9,1)")).alias("confidence"),
        F.when(k % 2 == 0, F.substring("text", 3, 20)).otherwise("paraphrased words").alias("signature_text"), (t % 4 == 3).alias("repeat_flag"),
    )
    span = F.concat(F.substring("text", 1, 30), F.when(t % 5 == 4, "#").otherwise(""))
    evidence = c.select(F.col("ref").alias("candidate_id"), F.lit(1).alias("n"), F.when(t % 2 == 0, "tool").otherwise("human").alias("source"), F.when(t % 2 == 0, "test_execution").otherwise("repeated_signal").alias("kind"), "ref", span.alias("span"))
    texts = c.select("ref", F.col("text").alias("body"), (k % 9 != 0).alias("learnable"), (t % 8 == 4).alias("is_error"))
    return classification.check_observations(candidates, evidence, texts)


@query(f"""WITH {EXCHANGES}, h AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.05) * (CAST(x AS DOUBLE) - 0.05)))) AS d FROM embeddings ORDER BY d, vec_id LIMIT 40) SELECT x.id, h.vec_id AS session_id, round(d, 6) AS distance FROM exchanges x JOIN h ON vec_id = session_id""")
def join01_hits_and_content(spark, sf_dir):
    hits = retrieval.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [0.05] * 64, 40).select(F.col("vec_id").alias("session_id"), "distance")
    return exchanges(spark, sf_dir).select("id", "session_id").join(F.broadcast(hits), "session_id").select("id", "session_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {EXCHANGES} SELECT x.id, source, length(user_message) AS n FROM exchanges x JOIN documents ON doc_id = session_id WHERE lang = 'en' AND project <> 'p1' ORDER BY n DESC, x.id LIMIT 30""")
def join03_filtered_before_top_k(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("session_id"), "source")
    x = exchanges(spark, sf_dir).where("project <> 'p1'").select("id", "session_id", F.length("user_message").cast("long").alias("n"))
    return x.join(d, "session_id").orderBy(F.desc("n"), "id").limit(30).select("id", "source", "n")


@query("SELECT c_custkey, n_name AS category, r_name AS domain FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def join19_category_domain(spark, sf_dir):
    # The taxonomy is small: its rows are looked up where the facts are read.
    taxonomy = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("category"), F.col("r_name").alias("domain"))
    return table(spark, sf_dir, "customer").join(F.broadcast(taxonomy), "c_nationkey", "left").select("c_custkey", "category", "domain")


@query("""WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS rung, row_number() OVER (PARTITION BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END ORDER BY doc_id) AS n FROM documents) SELECT doc_id, CAST(rung AS INTEGER) AS rung FROM r ORDER BY n > 25, rung, n LIMIT 50""")
def win02_quota_fill(spark, sf_dir):
    rung = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return retrieval.quota_fill(table(spark, sf_dir, "documents").select("doc_id", rung.alias("rung")), "doc_id", 50)


@query("""WITH u AS (SELECT user_id, event_type AS x FROM events UNION ALL SELECT user_id, 'k' || (event_id % 7) FROM events WHERE value > 5) SELECT user_id, array_to_string(list_sort(list_distinct(list(x))), ',') AS sources, count(*) AS n FROM u GROUP BY 1""")
def set02_union_then_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = e.select("user_id", F.col("event_type").alias("x")).union(e.where("value > 5").select("user_id", named("k", F.col("event_id") % 7)))
    return u.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT doc_id, 0 AS lane, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20), t AS (SELECT doc_id, 1 AS lane, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents WHERE source <> 'src3' ORDER BY n_chars, doc_id LIMIT 20), o AS (SELECT doc_id, lane, n FROM (SELECT * FROM v UNION ALL SELECT * FROM t) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lane, n) = 1)
SELECT doc_id, CAST(lane AS INTEGER) AS lane, row_number() OVER (ORDER BY lane, n) AS pos FROM o""")
def set04_ordered_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    first = d.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    second = d.where("source <> 'src3'").orderBy("n_chars", "doc_id").limit(20)
    return retrieval.ordered_union([(first, [F.desc("n_chars"), "doc_id"]), (second, ["n_chars", "doc_id"])], "doc_id")


@query("""SELECT event_id, replace(replace(rtrim(to_base64(encode('{"effective_at":"' || strftime(ts, '%Y-%m-%d') || '","recorded_at":"' || event_type || '","seq":' || event_id || '}')), '='), '+', '-'), '/', '_') AS cursor, event_id AS seq, event_type AS recorded_at FROM events""")
def top05_timeline_cursor(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", history.encode_cursor(F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.col("event_id")).alias("cursor"))
    return e.withColumn("c", history.decode_cursor(F.col("cursor"))).select("event_id", "cursor", "c.seq", "c.recorded_at")


def _ordered(x: str) -> str:
    """A list without what it has already had, in order."""
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda p: list_position({x}, p[1]) = p[2]), lambda p: p[1])"


@query(f"""WITH r AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 30) ELSE 'API v2 ' || text || ' HTTP 404' END, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS raw FROM conversations), l AS (SELECT *, list_transform(raw, lambda t: lower(t)) AS low FROM r), w AS (SELECT *, {_ordered('low')} AS words FROM l),
k AS (SELECT *, list_transform(list_sort(list_transform(list_zip(words, range(1, len(words) + 1)), lambda p: {{'n': -length(p[1]), 'i': p[2], 'w': p[1]}}))[1:6], lambda x: x.w) AS longest, list_transform(list_filter(raw, lambda t: regexp_matches(t, '[0-9]') OR (length(t) BETWEEN 2 AND 4 AND regexp_matches(t, '^[\\p{{Lu}}0-9]*\\p{{Lu}}[\\p{{Lu}}0-9]*$'))), lambda t: lower(t)) AS marked FROM w), c AS (SELECT *, list_concat(longest, marked) AS both_ FROM k)
SELECT conv_id, turn, array_to_string(CASE WHEN len(words) <= 6 THEN words ELSE ({_ordered('both_')})[1:10] END, ',') AS tokens FROM c""")
def ret04_token_cap(spark, sf_dir):
    t = F.col("turn") % 4
    said = F.when(t == 0, F.col("text")).when(t == 1, F.substring("text", 1, 30)).otherwise(F.concat(F.lit("API v2 "), "text", F.lit(" HTTP 404")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(retrieval.capped_tokens(said), ",").alias("tokens"))
