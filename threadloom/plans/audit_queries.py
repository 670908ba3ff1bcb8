"""Audits, index checks, moves, purges, evaluation and status counters over the archive model."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import audit, identity, turns
from threadloom.plans.base import EXCHANGES, FACTS, RELATIONS, exchanges, facts, query, relations, table

STATES = ("legacy-project", "workstream", "workspace", "decision", "project-current", "workstream", None)
_CONV = "(SELECT DISTINCT conv_id FROM conversations)"
_AUDITED = f"""{FACTS}, {RELATIONS}, a AS (SELECT id, scope_type, is_active, CASE WHEN id % 13 <> 0 THEN project END AS project_id, CASE WHEN id % 4 <> 0 THEN 's' || (id % 9) END AS workspace_id, CASE WHEN id % 11 <> 0 THEN 'w' || (id % 6) END AS workstream_id,
    ({str(list(STATES)).replace('None', 'NULL')})[CAST(id % 7 + 1 AS INTEGER)] AS promotion_state, CASE WHEN id % 31 <> 0 THEN [id % 120, id * 6 % 126] END AS sources FROM facts),
x AS (SELECT conv_id AS ref, 'w' || (conv_id % 6) AS stream FROM {_CONV}), c AS (SELECT DISTINCT id, unnest(sources) AS ref FROM a), l AS (SELECT id, count(CASE WHEN x.ref IS NULL THEN 1 END) AS gone, count(DISTINCT stream) AS streams, min(stream) AS lo, max(stream) AS hi FROM c LEFT JOIN x ON x.ref = c.ref GROUP BY id),
k AS (SELECT a.*, gone, coalesce(streams, 0) AS streams, lo, hi, sources IS NOT NULL AS readable FROM a LEFT JOIN l USING (id)), live AS (SELECT id FROM a WHERE is_active), ctx AS (SELECT event_id % 1500 AS id, event_id % 130 AS ref FROM events WHERE event_type = 'signup')"""


@query(f"""WITH {_AUDITED}
SELECT 'privacy-resurrection' AS code, 'repairable' AS disposition, id FROM k WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
UNION ALL SELECT 'legacy-identity', 'review', id FROM k WHERE scope_type = 'project' AND (project_id IS NULL OR promotion_state IS NULL OR promotion_state = 'legacy-project' OR (promotion_state = 'workstream' AND workstream_id IS NULL) OR (promotion_state = 'workspace' AND workspace_id IS NULL))
UNION ALL SELECT 'missing-source', 'review', id FROM k WHERE NOT readable OR gone > 0
UNION ALL SELECT 'mixed-workstream-lineage', 'review', id FROM k WHERE readable AND streams > 1
UNION ALL SELECT 'foreign-workstream-lineage', 'review', id FROM k WHERE readable AND promotion_state = 'workstream' AND streams > 0 AND (lo IS DISTINCT FROM workstream_id OR hi IS DISTINCT FROM workstream_id)
UNION ALL SELECT 'unproven-promotion', 'review', id FROM k WHERE readable AND promotion_state IN ('decision', 'project-current') AND streams > 0 AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
UNION ALL SELECT 'semantic-revalidation-needed', 'review', id FROM k WHERE readable AND id IN (SELECT event_id % 1000 FROM events WHERE event_type = 'error' AND event_id % 3 <> 0)
UNION ALL SELECT 'orphan-vector', 'repairable', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM live)
UNION ALL SELECT 'orphan-relation', 'repairable', source_id * 100000 + target_id FROM relations WHERE source_id NOT IN (SELECT id FROM live) OR target_id NOT IN (SELECT id FROM live)
UNION ALL SELECT 'orphan-context', 'repairable', id FROM ctx WHERE id NOT IN (SELECT id FROM a) OR ref NOT IN (SELECT ref FROM x)""")
def chr17_integrity_audit(spark, sf_dir):
    d, e = F.col("id"), table(spark, sf_dir, "events")
    state = F.element_at(F.array(*(F.lit(s) if s else F.lit(None).cast("string") for s in STATES)), (d % 7 + 1).cast("int"))
    own = facts(spark, sf_dir).select(
        "id", "scope_type", "is_active", F.when(d % 13 != 0, F.col("project")).alias("project_id"), F.when(d % 4 != 0, F.concat(F.lit("s"), (d % 9).cast("string"))).alias("workspace_id"),
        F.when(d % 11 != 0, F.concat(F.lit("w"), (d % 6).cast("string"))).alias("workstream_id"), state.alias("promotion_state"), F.when(d % 31 != 0, F.array(d % 120, d * 6 % 126)).alias("sources"),
    )
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ref")).distinct().withColumn("workstream_id", F.concat(F.lit("w"), (F.col("ref") % 6).cast("string")))
    tombs = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.lit("source_conversation_excluded").alias("reason"))
    c = F.col("c_custkey")
    proved = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(c.alias("id"), F.explode(F.array(F.lit("decision"), F.lit("project-current"))).alias("promotion_state"))
    revisions = e.select((F.col("event_id") % 1000).alias("id"), F.when(F.col("event_type") == "error", "legacy").otherwise("human").alias("actor"), F.lit("CHANGED").alias("event_kind"), (F.col("event_id") % 3 == 0).alias("verified"))
    edges = relations(spark, sf_dir).select((F.col("source_id") * 100000 + F.col("target_id")).alias("id"), "source_id", "target_id")
    context = e.where("event_type = 'signup'").select((F.col("event_id") % 1500).alias("id"), (F.col("event_id") % 130).alias("ref"))
    return audit.integrity_findings(own, x, tombs, proved, revisions, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), edges, context)


@query("""WITH a AS (SELECT c_custkey AS k, TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 1500 AS INTEGER)) AS modified, c_acctbal > -500 AS readable FROM customer), i AS (SELECT o_custkey + CASE WHEN o_custkey % 9 = 0 THEN 1000000 ELSE 0 END AS k, max(o_orderdate) AS indexed_at FROM orders GROUP BY 1)
SELECT k AS c_custkey, CASE WHEN modified IS NULL THEN 'orphaned' WHEN NOT readable THEN 'corrupted' WHEN indexed_at IS NULL THEN 'missing' WHEN indexed_at < modified THEN 'outdated' ELSE 'current' END AS state FROM a FULL JOIN i USING (k)""")
def chr19_index_verification(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_custkey")
    start = F.lit("1994-01-01").cast("timestamp_ntz")
    archives = table(spark, sf_dir, "customer").select(k, (start + F.make_dt_interval(days=(k % 1500).cast("int"))).alias("modified"), (F.col("c_acctbal") > -500).alias("readable"))
    index = table(spark, sf_dir, "orders").groupBy((o + F.when(o % 9 == 0, 1000000).otherwise(0)).alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp_ntz").alias("indexed_at"))
    return audit.verify_index(archives, index, "c_custkey")


@query("""WITH p AS (SELECT page_id AS id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), r AS (SELECT id, CASE WHEN id % 3 = 0 THEN '/a/' || host || '/b' ELSE '-a-' || host END AS project, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a/' || host ELSE '/a/./' || host || '//x/../b/' END AS cwd, '/a/' || host || '/b' AS canonical FROM p)
SELECT id, CASE WHEN cwd IS NULL THEN 'no cwd' WHEN id % 5 = 1 THEN 'relative cwd' WHEN project = canonical THEN 'canonical' ELSE 'move' END AS outcome, project AS "from", CASE WHEN cwd IS NOT NULL AND id % 5 <> 1 AND project <> canonical THEN canonical END AS "to" FROM r""")
def chr20_migration_plan(spark, sf_dir):
    k, host = F.col("page_id"), F.regexp_extract("url", "://([^/?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("/a/"), host, F.lit("/b"))).otherwise(F.concat(F.lit("-a-"), host)).alias("project"), F.when(k % 5 == 1, F.concat(F.lit("a/"), host)).when(k % 5 != 0, F.concat(F.lit("/a/./"), host, F.lit("//x/../b/"))).alias("cwd"))
    return audit.migration_plan(rows, identity.canonical_path(F.col("cwd")))


@query(f"""WITH {FACTS}, {RELATIONS}, f AS (SELECT id, [id % 120, id * 6 % 126] AS sources FROM facts), r AS (SELECT event_id, event_id % 1000 AS id, [event_id % 97] AS sources FROM events), c AS (SELECT event_id % 1500 AS id, event_id % 130 AS ref FROM events WHERE event_type = 'signup'),
gone AS (SELECT DISTINCT conv_id AS ref FROM conversations WHERE conv_id % 40 = 3), cites AS (SELECT id, unnest(sources) AS ref FROM f UNION ALL SELECT id, unnest(sources) FROM r UNION ALL SELECT id, ref FROM c), doomed AS (SELECT DISTINCT id FROM cites WHERE ref IN (SELECT ref FROM gone))
SELECT 'facts' AS part, count(*) AS kept FROM f WHERE id NOT IN (SELECT id FROM doomed) UNION ALL SELECT 'revisions', count(*) FROM r WHERE id NOT IN (SELECT id FROM doomed) UNION ALL SELECT 'context', count(*) FROM c WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'relations', count(*) FROM relations WHERE source_id NOT IN (SELECT id FROM doomed) AND target_id NOT IN (SELECT id FROM doomed) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM doomed)""")
def src18_privacy_purge(spark, sf_dir):
    d, e, k = F.col("id"), table(spark, sf_dir, "events"), F.col("event_id")
    f = facts(spark, sf_dir).select("id", F.array(d % 120, d * 6 % 126).alias("sources"))
    r = e.select((k % 1000).alias("id"), F.array(k % 97).alias("sources"))
    c = e.where("event_type = 'signup'").select((k % 1500).alias("id"), (k % 130).alias("ref"))
    gone = table(spark, sf_dir, "conversations").where("conv_id % 40 = 3").select(F.col("conv_id").alias("ref"))
    tables = {"facts": (f, ["id"]), "revisions": (r, ["id"]), "context": (c, ["id"]), "relations": (relations(spark, sf_dir), ["source_id", "target_id"]), "vectors": (table(spark, sf_dir, "embeddings"), ["vec_id"])}
    out = None
    for name, df in audit.purge(tables, audit.doomed_facts(gone, f, r, c)).items():
        part = df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("part"), "kept")
        out = part if out is None else out.unionByName(part)
    return out


_AHEAD = ", ".join(f"CASE WHEN lead(event_type, {n}) OVER w = 'error' AND lead(event_id, {n}) OVER w % 3 = event_id % 3 THEN lead(event_id, {n}) OVER w END" for n in range(1, 6))


@query(f"""WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, CASE WHEN event_type = 'purchase' THEN coalesce({_AHEAD}) END AS result FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, line, '**' || event_type || '** ' || event_id || CASE WHEN result IS NOT NULL THEN chr(10) || '> ' || result ELSE '' END AS markdown FROM s WHERE line BETWEEN 3 AND 40""")
def src19_render_slice(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    own = audit.with_results(e, "user_id", "line", F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("event_id") % 3, F.col("event_id").cast("string"))
    shown = turns.lines_between(own, "line", 3, 40)
    return shown.select("user_id", "line", F.concat(F.lit("**"), "event_type", F.lit("** "), F.col("event_id").cast("string"), F.coalesce(F.concat(F.lit("\n> "), "result"), F.lit(""))).alias("markdown"))


TAGS = ("ratification", "verified_local", "exploration", "other")


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n, ({list(TAGS)})[CAST(conv_id % 4 + 1 AS INTEGER)] AS tag, conv_id % 17 = 5 AS failed, conv_id % 3 AS expected FROM conversations GROUP BY conv_id),
k AS (SELECT *, least(expected, n % 3) AS matched, least(expected, n % 3) + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS observed FROM c), p AS (SELECT *, matched = expected AND observed = matched AS passed, NOT failed AS ran FROM k)
SELECT count(*) AS case_count, count(CASE WHEN ran AND passed THEN 1 END) AS passed_cases, count(CASE WHEN ran AND NOT passed THEN 1 END) AS failed_cases, count(CASE WHEN failed THEN 1 END) AS execution_errors, CAST(sum(CASE WHEN ran THEN observed - matched END) AS BIGINT) AS false_positives,
round(sum(CASE WHEN ran THEN matched END) / nullif(sum(CASE WHEN ran THEN expected END), 0), 6) AS recall, round(sum(CASE WHEN ran THEN matched END) / nullif(sum(CASE WHEN ran THEN observed END), 0), 6) AS precision,
round(count(CASE WHEN ran AND expected = 0 AND observed = 0 THEN 1 END) / nullif(count(CASE WHEN ran AND expected = 0 THEN 1 END), 0), 6) AS no_fact_accuracy, round(count(CASE WHEN ran AND passed AND tag = 'ratification' THEN 1 END) / nullif(count(CASE WHEN ran AND tag = 'ratification' THEN 1 END), 0), 6) AS ratification,
round(count(CASE WHEN ran AND passed AND tag = 'verified_local' THEN 1 END) / nullif(count(CASE WHEN ran AND tag = 'verified_local' THEN 1 END), 0), 6) AS verified_local,
round(count(CASE WHEN ran AND expected = 0 AND observed > 0 AND tag = 'exploration' THEN 1 END) / nullif(count(CASE WHEN ran AND expected = 0 AND tag = 'exploration' THEN 1 END), 0), 6) AS exploration_false_positives FROM p""")
def agg23_eval_metrics(spark, sf_dir):
    k = F.col("conv_id")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("expected", k % 3)
    c = c.withColumn("matched", F.least("expected", F.col("n") % 3)).withColumn("observed", F.col("matched") + F.when(F.col("n") % 4 == 0, 1).otherwise(0))
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (k % 4 + 1).cast("int"))
    cases = c.select(k.alias("case_id"), F.array(tag).alias("tags"), ((F.col("matched") == F.col("expected")) & (F.col("observed") == F.col("matched"))).alias("passed"), "expected", "matched", "observed", (k % 17 == 5).alias("failed"))
    return audit.evaluation(cases)


METRICS = {
    "facts": {"facts": "true", "facts_active": "is_active", "facts_inactive": "not is_active", "facts_global": "is_active and scope_type = 'global'", "facts_project": "is_active and scope_type = 'project'", "facts_flagged": "flagged = 1", "facts_unreviewed": "flagged is null",
              "facts_unconfirmed": "is_active and confirmations = 0", "facts_confirmed": "is_active and confirmations >= 5", "facts_fresh": "age_days <= 7", "facts_stale": "age_days > 90", "facts_decided": "authority = 'decision'", "facts_unknown_authority": "authority = 'unknown'", "facts_long": "n_chars > 2000"},
    "exchanges": {"exchanges": "true", "exchanges_side": "is_sidechain", "exchanges_main": "not is_sidechain", "exchanges_long": "line_end - line_start > 1", "exchanges_late": "timestamp > '2024-01-03'"},
    "relations": {"relations": "true", "relations_contradict": "relation_type = 'CONTRADICTS'", "relations_supersede": "relation_type = 'SUPERSEDES'", "relations_support": "relation_type = 'SUPPORTS'"},
    "orders": {"jobs": "true", "jobs_open": "o_orderstatus = 'O'", "jobs_done": "o_orderstatus = 'F'", "jobs_partial": "o_orderstatus = 'P'", "jobs_urgent": "o_orderpriority = '1-URGENT'", "jobs_urgent_open": "o_orderpriority = '1-URGENT' and o_orderstatus = 'O'"},
    "events": {"signals": "true", "signals_error": "event_type = 'error'", "signals_purchase": "event_type = 'purchase'", "signals_large": "value > 40"},
    "busy": {"owners": "true", "owners_busy": "n >= 10", "owners_with_one": "n = 1"},
    "vectors": {"vectors": "true", "vectors_of_no_fact": "id is null"},
}
_COUNTED = " UNION ALL ".join(f"SELECT '{m}' AS metric, count(CASE WHEN {c} THEN 1 END) AS value FROM {t}" for t, own in METRICS.items() for m, c in own.items())


@query(f"WITH {FACTS}, {EXCHANGES}, {RELATIONS}, busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), vectors AS (SELECT vec_id, id FROM embeddings LEFT JOIN facts ON id = vec_id) {_COUNTED}")
def agg21_pipeline_status(spark, sf_dir):
    f = facts(spark, sf_dir)
    tables = {"facts": f, "exchanges": exchanges(spark, sf_dir), "relations": relations(spark, sf_dir)} | {t: table(spark, sf_dir, t) for t in ("orders", "events")}
    tables["busy"] = tables["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    tables["vectors"] = table(spark, sf_dir, "embeddings").select("vec_id").join(f.select("id"), F.col("vec_id") == F.col("id"), "left")
    return audit.counters(tables, METRICS)


STAGES = {
    "missing": {"embedding": "true"}, "facts": {"consolidation": "is_active and confirmations = 0", "classification": "is_active and flagged is null", "review": "is_active and flagged = 1", "tiering": "is_active and scope_type = 'project' and age_days > 90"},
    "exchanges": {"extraction": "not is_sidechain and session_id % 4 = 1", "summary": "not is_sidechain and line_start = 0"}, "jobs": {"retry": "o_orderstatus = 'P'", "queued": "o_orderstatus = 'O' and o_orderpriority = '1-URGENT'"},
}
_PENDING = " UNION ALL ".join(f"SELECT '{m}' AS stage, count(CASE WHEN {c} THEN 1 END) AS pending FROM {t}" for t, own in STAGES.items() for m, c in own.items())


@query(f"WITH {FACTS}, {EXCHANGES}, missing AS (SELECT id FROM facts WHERE is_active AND id NOT IN (SELECT vec_id FROM embeddings)), jobs AS (SELECT * FROM orders) {_PENDING}")
def agg22_backlog(spark, sf_dir):
    f = facts(spark, sf_dir)
    missing = f.where("is_active").select("id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")
    tables = {"missing": missing, "facts": f, "exchanges": exchanges(spark, sf_dir), "jobs": table(spark, sf_dir, "orders")}
    return audit.counters(tables, STAGES).withColumnsRenamed({"metric": "stage", "value": "pending"})


@query("""WITH c AS (SELECT user_id, date_trunc('day', ts) AS d, event_type AS tool, ts FROM events WHERE event_type <> 'view') SELECT a.tool AS first_tool, b.tool AS then_tool, count(*) AS n FROM c a JOIN c b ON a.user_id = b.user_id AND a.d = b.d AND a.ts < b.ts GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, 1, 2 LIMIT 5""")
def agg12_tool_bigrams(spark, sf_dir):
    calls = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("day", F.date_trunc("day", "ts"))
    return audit.tool_pairs(calls, ["user_id", "day"], "event_type", "ts")


@query(f"WITH {EXCHANGES} SELECT project, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id % 3) AS branches, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM exchanges GROUP BY 1")
def agg13_project_profile(spark, sf_dir):
    return audit.project_profiles(exchanges(spark, sf_dir).withColumn("branch", F.col("session_id") % 3))


@query("""SELECT source, count(*) AS files, count(l.doc_id) AS summarised FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def agg09_summary_coverage(spark, sf_dir):
    return audit.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "source")


@query("""WITH c AS (SELECT p_size % 5 AS domain, lower(p_brand) AS name, arg_min(p_partkey, (p_retailprice, p_partkey)) AS id FROM part WHERE p_size < 30 GROUP BY 1, 2), a AS (SELECT p_partkey AS request_id, p_size % 5 AS domain, lower(p_brand) AS name FROM part)
SELECT request_id, coalesce(CAST(id AS VARCHAR), 'new-' || substr(md5(domain || '|' || name), 1, 12)) AS category_id, id IS NULL AS created FROM a LEFT JOIN c USING (domain, name)""")
def dat07_resolve_category(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    domain = (F.col("p_size") % 5).alias("domain")
    held = p.where("p_size < 30").select(domain, F.col("p_brand").alias("name"), F.col("p_retailprice").alias("created_at"), F.col("p_partkey").alias("category_id"))
    return audit.resolve_categories(p.select(F.col("p_partkey").alias("request_id"), domain, F.concat(F.lit(" "), F.upper("p_brand")).alias("name")), held)


@query("""WITH n AS (SELECT o_orderstatus AS state, count(*) AS in_state FROM orders GROUP BY 1) SELECT o_orderkey AS job_id, o_orderpriority AS kind, o_orderstatus AS state, o_orderkey % 4 AS attempts, o_orderdate AS updated_at, in_state FROM orders JOIN n ON state = o_orderstatus WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 80""")
def job12_job_list(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 4).alias("attempts"), F.col("o_orderdate").alias("updated_at"))
    return audit.job_list(jobs, kind="2-HIGH", limit=80)
