"""Session state, imports, purges, projections, repairs and small joins of the archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import graph, ledger, upkeep
from threadloom.plans.base import EXCHANGES, FACTS, ORACLE_SQL, RELATIONS, exchanges, facts, query, relations, table
from threadloom.plans.placement_queries import _PLACED, placed
from threadloom.plans.revision_queries import src12_reconcile

NOW = "2024-01-20 00:00:00"


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 6 = 0 THEN ' # AGENTS.md ' || text ELSE text END AS t, CASE WHEN conv_id % 5 = 0 THEN 'p1' WHEN conv_id % 5 = 1 THEN ' ' END AS parent, CASE WHEN conv_id % 5 = 2 THEN 'a SubAgent' ELSE 'cli' END AS source FROM conversations)
SELECT conv_id, turn, starts_with(ltrim(t), '# AGENTS.md') AS internal, coalesce(trim(parent) <> '', false) OR source = 'a SubAgent' AS subthread FROM c""")
def src03_src06_thread_filters(spark, sf_dir):
    k = F.col("conv_id") % 5
    said = F.when(F.col("turn") % 6 == 0, F.concat(F.lit(" # AGENTS.md "), "text")).otherwise(F.col("text"))
    sub = upkeep.is_subthread(F.when(k == 0, "p1").when(k == 1, " "), F.when(k == 2, "a SubAgent").otherwise("cli"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", upkeep.internal_context(said).alias("internal"), sub.alias("subthread"))


@query("""SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(o.project, n.project) AS project, greatest(n.last_seen, o.last_seen) AS last_seen, o.user_id IS NULL AS created
FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS project, max(ts) AS last_seen FROM events WHERE user_id % 4 <> 0 GROUP BY 1) n FULL JOIN (SELECT user_id, min(event_type) AS project, min(ts) AS last_seen FROM events WHERE user_id % 3 <> 0 GROUP BY 1) o USING (user_id)""")
def idn09_ensure_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seen = e.where("user_id % 4 <> 0").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("project"), F.max("ts").alias("last_seen"))
    state = e.where("user_id % 3 <> 0").groupBy("user_id").agg(F.min("event_type").alias("project"), F.min("ts").alias("last_seen"))
    return upkeep.ensure_sessions(seen, state, "user_id")


@query("""SELECT l_orderkey, CASE WHEN count(*) = count(p) AND min(p) = max(p) THEN min(p) END AS project, CASE WHEN min(f) = max(f) THEN min(f) END AS stream FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 50 <> 0 THEN l_suppkey % 3 END AS p, l_returnflag AS f FROM lineitem) GROUP BY 1""")
def chr10_common_identity(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 50 != 0, F.col("l_suppkey") % 3).alias("project"), F.col("l_returnflag").alias("stream"))
    return upkeep.common_identity(s, "l_orderkey", ["project", "stream"])


@query("""WITH d AS (SELECT event_id, user_id, event_id % 97 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AS gone FROM events)
SELECT user_id, count(CASE WHEN gone THEN 1 END) AS purged, count(CASE WHEN NOT gone THEN 1 END) AS kept FROM d GROUP BY 1""")
def chr09_source_purge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.array(F.col("event_id") % 97, F.col("user_id")).alias("sources"))
    gone, kept = upkeep.purge_sources(e, table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("source")), "event_id", "sources", "source")
    marked = gone.select("user_id", F.lit(1).alias("g")).unionByName(kept.select("user_id", F.lit(0).alias("g")))
    return marked.groupBy("user_id").agg(F.count_if(F.col("g") == 1).alias("purged"), F.count_if(F.col("g") == 0).alias("kept"))


@query("""WITH p AS (SELECT 'k' || n_nationkey AS pk, n_nationkey AS project FROM nation WHERE n_regionkey <> 1) SELECT event_id, project FROM events JOIN p ON pk = 'k' || (user_id % 30) WHERE event_id NOT IN (SELECT s_suppkey FROM supplier)""")
def mrg05_event_import(spark, sf_dir):
    k = lambda c: F.concat(F.lit("k"), c.cast("string"))
    incoming = table(spark, sf_dir, "events").select("event_id", k(F.col("user_id") % 30).alias("portable_key"))
    projects = table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") != 1, k(F.col("n_nationkey"))).alias("portable_key"), F.col("n_nationkey").alias("project"))
    return upkeep.import_events(incoming, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("event_id")), projects, "event_id")


@query(f"SELECT action, count(*) AS n FROM ({ORACLE_SQL["src12_reconcile"]}) GROUP BY 1")
def mrg07_preview(spark, sf_dir):
    # The preview counts what the planner itself returns.
    return src12_reconcile(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, count(*) AS n, max(CASE WHEN r = 1 THEN props END) AS latest, string_agg(props, '|' ORDER BY r) AS items FROM n WHERE r <= 8 GROUP BY 1, 2""")
def str10_capsule(spark, sf_dir):
    return upkeep.capsule(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "props")


@query(f"""SELECT user_id, last_id, (NOT claimed OR seen_at <= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTES) AND last_id > coalesce(mark, -1) AS claimable FROM
(SELECT user_id, max(event_id) AS last_id, max(ts) AS seen_at, user_id % 2 = 0 AS claimed, max(CASE WHEN event_type = 'error' THEN event_id END) AS mark FROM events GROUP BY user_id)""")
def job08_claimable(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.max("ts").alias("at"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("mark"))
    state = F.when(F.col("user_id") % 2 == 0, "claimed").otherwise("free")
    return s.select("user_id", "last_id", upkeep.claimable(state, F.col("at"), F.lit(NOW).cast("timestamp"), F.col("mark"), F.col("last_id")).alias("claimable"))


@query("""WITH c AS (SELECT event_id, event_id % 13 = 0 AS handed, event_id % 2 = 0 AS provider, CASE WHEN event_id % 11 = 0 THEN 'config' WHEN event_id % 7 = 0 THEN 'deterministic' WHEN event_id % 5 = 0 THEN 'transient' ELSE 'unknown' END AS c FROM events),
k AS (SELECT event_id, CASE WHEN handed THEN 'handoff' WHEN c = 'config' THEN 'config' WHEN provider AND c = 'deterministic' THEN 'provider_deterministic' WHEN provider THEN 'provider_transient' ELSE 'internal' END AS kind FROM c) SELECT event_id, kind, kind IN ('provider_deterministic', 'internal') AS consumes FROM k""")
def dat11_failure_kind(spark, sf_dir):
    e = F.col("event_id")
    status = F.when(e % 7 == 0, 400).when(e % 5 == 0, 503)
    kind, consumes = upkeep.failure_kind(ledger.error_class(F.when(e % 11 == 0, "config").otherwise(""), status, F.lit("")), e % 13 == 0, e % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), consumes.alias("consumes"))


@query(f"WITH {FACTS}, {RELATIONS}, a AS (SELECT id FROM facts WHERE is_active) SELECT source_id, target_id FROM relations WHERE NOT (relation_type = 'RELATES' AND (source_id NOT IN (SELECT id FROM a) OR target_id NOT IN (SELECT id FROM a)))")
def dat05_apply_repairs(spark, sf_dir):
    # Only the selected repair is applied: orphaned edges of one kind.
    r, f = relations(spark, sf_dir), facts(spark, sf_dir).where("is_active")
    chosen = r.where("relation_type = 'RELATES'")
    return r.where("relation_type <> 'RELATES'").select("source_id", "target_id").unionByName(graph.inside(chosen, f).select("source_id", "target_id"))


@query(f"WITH {FACTS}, s AS (SELECT id, unnest([id % 700, id * 3 % 1100]) AS src FROM facts) SELECT id, sha256(fact) AS fact_hash FROM facts WHERE id IN (SELECT id FROM s LEFT JOIN embeddings ON vec_id = src GROUP BY id HAVING count(vec_id) = count(*))")
def ext08_evidence_receipts(spark, sf_dir):
    f = facts(spark, sf_dir)
    rows = f.select("id", F.array(F.col("id") % 700, F.col("id") * 3 % 1100).alias("sources"))
    sound = ledger.all_sources_resolve(rows, "id", "sources", table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src")), "src").where("repairable").select("id")
    return f.join(sound, "id", "left_semi").select("id", F.sha2("fact", 256).alias("fact_hash"))


@query(f"WITH {_PLACED} SELECT id, tier FROM placed WHERE (project_id = 'src3' AND tier IN ('workspace', 'decision')) OR scope_type = 'global'")
def flt09_browse_facts(spark, sf_dir):
    own = (F.col("project_id") == "src3") & F.col("tier").isin("workspace", "decision")
    return placed(spark, sf_dir).where(own | (F.col("scope_type") == "global")).select("id", "tier")


@query(f"WITH {EXCHANGES} SELECT id, project FROM exchanges WHERE project IN ('p2', 'p5')")
def flt10_browse_exchanges(spark, sf_dir):
    # Exchanges always belong to a project, so a global scope shows none.
    return exchanges(spark, sf_dir).where(F.col("project").isin("p2", "p5")).select("id", "project")


@query(f"WITH {EXCHANGES}, h AS (SELECT id, line_start FROM exchanges WHERE contains(user_message, 'the') ORDER BY length(user_message) DESC, id LIMIT 20) SELECT x.id, x.project, x.timestamp, length(assistant_message) AS n FROM exchanges x JOIN h USING (id)")
def join02_top_k_then_content(spark, sf_dir):
    # Twenty ids are chosen first; the wide rows are fetched for them alone.
    x = exchanges(spark, sf_dir)
    hits = x.where(F.contains("user_message", F.lit("the"))).select("id", F.length("user_message").alias("n")).orderBy(F.desc("n"), "id").limit(20)
    return x.join(F.broadcast(hits.select("id")), "id").select("id", "project", "timestamp", F.length("assistant_message").cast("long").alias("n"))


@query(f"WITH {RELATIONS}, s AS (SELECT DISTINCT source_id AS id FROM relations WHERE relation_type = 'CONTRADICTS'), e AS (SELECT source_id AS a, target_id AS b FROM relations UNION ALL SELECT target_id, source_id FROM relations) SELECT b AS neighbour, count(*) AS n FROM e JOIN s ON id = a GROUP BY 1")
def join12_both_directions(spark, sf_dir):
    r = relations(spark, sf_dir)
    seeds = r.where("relation_type = 'CONTRADICTS'").select(F.col("source_id").alias("from")).distinct()
    return graph.both_ways(r).join(seeds, "from").groupBy(F.col("to").alias("neighbour")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS}, {RELATIONS}, a AS (SELECT id FROM facts WHERE is_active) SELECT source_id, target_id, relation_type FROM relations WHERE source_id IN (SELECT id FROM a) AND target_id IN (SELECT id FROM a)")
def join14_both_ends(spark, sf_dir):
    return graph.inside(relations(spark, sf_dir), facts(spark, sf_dir).where("is_active")).select("source_id", "target_id", "relation_type")


@query("SELECT o_orderkey, c_nationkey AS project FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = o_orderkey % 100 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def join18_human_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 100).alias("s_suppkey"))
    state = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("project"))
    spaces = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("project"))
    excluded = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(excluded, "o_orderkey", "left_anti").join(state, "c_custkey").join(spaces, ["project", "s_suppkey"]).select("o_orderkey", "project")
