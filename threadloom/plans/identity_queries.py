"""Identity, extraction rules and windows, continuity."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import continuity, extraction, identity
from threadloom.operators.storage import settled
from threadloom.plans.base import EXCHANGES, FACTS, exchanges, facts, query, table

SEGMENTS = ("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE")
# What facts must not hold.
FORBIDDEN = {"fact": {"address": "[a-z0-9.]+@[a-z0-9]+\\.[a-z]+", "number": "[0-9]{3}-[0-9]{4}"}, "project": {"source": "^forum$"}}


@query("""WITH p AS (SELECT page_id, '/a/' || coalesce(regexp_extract(url, '://([^/]*)', 1), '') || '/./b/..//' || coalesce(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '') || '/../..' AS raw FROM pages),
l AS (SELECT page_id, list_filter(string_split(raw, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM p)
SELECT page_id, '/' || coalesce(array_to_string(list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(parts, lambda x: [x])),
    lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END), '/'), '') AS path FROM l""")
def idn08_canonical_path(spark, sf_dir):
    part = lambda p: F.coalesce(F.regexp_extract("url", p, 1), F.lit(""))
    raw = F.concat(F.lit("/a/"), part("://([^/]*)"), F.lit("/./b/..//"), part("://[^/]*/([^?#]*)"), F.lit("/../.."))
    return table(spark, sf_dir, "pages").select("page_id", identity.canonical_path(raw).alias("path"))


@query("""WITH r AS (SELECT c_custkey AS request_id, 'Supplier#' || lpad(CAST(c_custkey * 3 AS VARCHAR), 9, '0') AS path, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END AS explicit_id,
    CASE WHEN c_custkey % 8 = 1 THEN 'key-' || c_nationkey END AS portable_key, CASE WHEN c_custkey % 8 < 4 THEN c_custkey % 997 END AS common_dir, CASE WHEN c_custkey % 8 < 7 THEN c_custkey % 41 END AS remote FROM customer),
w AS (SELECT s_name AS path, s_nationkey AS project_id, s_suppkey * 7 % 1009 AS common_dir, s_suppkey % 43 AS remote, s_acctbal > 0 AS approved FROM supplier),
k AS (SELECT 'key-' || n_nationkey AS portable_key, n_nationkey AS by_key FROM nation WHERE n_regionkey <> 2),
bp AS (SELECT path, min(project_id) AS by_path FROM w GROUP BY 1),
bd AS (SELECT common_dir, count(DISTINCT project_id) AS nd, min(project_id) AS by_dir FROM w GROUP BY 1),
br AS (SELECT remote, count(DISTINCT project_id) AS nr, min(project_id) AS by_remote FROM w WHERE approved GROUP BY 1),
j AS (SELECT * FROM r LEFT JOIN bp USING (path) LEFT JOIN k USING (portable_key) LEFT JOIN bd USING (common_dir) LEFT JOIN br USING (remote)),
d AS (SELECT *, CASE WHEN by_path <> explicit_id OR by_key <> explicit_id THEN 'conflict' WHEN by_path IS NOT NULL THEN 'path' WHEN explicit_id IS NOT NULL THEN 'explicit' WHEN by_key IS NOT NULL THEN 'portable-key'
    WHEN nd > 1 THEN 'conflict' WHEN nd = 1 THEN 'common-dir' WHEN nr > 1 THEN 'conflict' WHEN nr = 1 THEN 'approved-remote' ELSE 'new' END AS reason FROM j)
SELECT request_id, CASE reason WHEN 'path' THEN by_path WHEN 'explicit' THEN explicit_id WHEN 'portable-key' THEN by_key WHEN 'common-dir' THEN by_dir WHEN 'approved-remote' THEN by_remote END AS project_id, reason FROM d""")
def idn01_resolve_project(spark, sf_dir):
    k = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.concat(F.lit("Supplier#"), F.lpad((k * 3).cast("string"), 9, "0")).alias("path"), F.when(k % 4 == 0, F.col("c_nationkey")).alias("explicit_id"),
        F.when(k % 8 == 1, F.concat(F.lit("key-"), F.col("c_nationkey").cast("string"))).alias("portable_key"), F.when(k % 8 < 4, k % 997).alias("common_dir"), F.when(k % 8 < 7, k % 41).alias("remote"),
    )
    s = F.col("s_suppkey")
    workspaces = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.col("s_nationkey").alias("project_id"), (s * 7 % 1009).alias("common_dir"), (s % 43).alias("remote"), (F.col("s_acctbal") > 0).alias("approved"))
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.when(F.col("n_regionkey") != 2, F.concat(F.lit("key-"), F.col("n_nationkey").cast("string"))).alias("portable_key"))
    return identity.resolve_projects(requests, workspaces, projects)


@query(f"""WITH s AS (SELECT o_orderkey AS session_id, o_custkey % 25 AS project, o_custkey % 50 AS workspace, CASE WHEN o_orderkey % 10 = 0 THEN 'c' || o_custkey END AS explicit,
    CASE WHEN o_orderkey % 3 <> 0 THEN ({list(SEGMENTS)})[CAST(o_orderkey % 5 + 1 AS INTEGER)] END AS branch, 'BUILDING' AS default_branch, CASE WHEN o_orderkey % 17 = 0 THEN 'c' || (o_custkey + 1) END AS old_stream FROM orders),
t AS (SELECT 'c' || c_custkey AS stream_id, c_nationkey AS project, c_custkey % 50 AS workspace, c_mktsegment AS branch, c_acctbal > 0 AS active FROM customer),
a AS (SELECT project, workspace, branch, min(stream_id) AS only_one FROM t WHERE active GROUP BY 1, 2, 3 HAVING count(*) = 1),
j AS (SELECT s.*, t.project AS explicit_project, only_one, CASE WHEN s.branch <> default_branch THEN s.branch END AS signal FROM s LEFT JOIN t ON t.stream_id = s.explicit LEFT JOIN a ON a.project = s.project AND a.workspace = s.workspace AND a.branch = s.branch),
d AS (SELECT *, CASE WHEN old_stream IS NOT NULL THEN 'resume-exact' WHEN explicit IS NOT NULL AND explicit_project = project THEN 'explicit' WHEN explicit IS NOT NULL THEN 'rejected' WHEN only_one IS NOT NULL THEN 'unique-workspace-branch'
    WHEN signal IS NOT NULL THEN 'workspace-branch' ELSE 'project-default' END AS reason FROM j)
SELECT session_id, CASE reason WHEN 'resume-exact' THEN old_stream WHEN 'explicit' THEN explicit WHEN 'rejected' THEN NULL WHEN 'unique-workspace-branch' THEN only_one
    ELSE 'ws-' || substr(sha256(CASE WHEN signal IS NULL THEN 'workstream-project-default-v1' || chr(0) || project || chr(0) ELSE 'workstream-branch-v1' || chr(0) || project || chr(0) || signal || chr(0) END), 1, 32) END AS stream, reason, CASE reason WHEN 'rejected' THEN NULL WHEN 'unique-workspace-branch' THEN CAST(0.9 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence FROM d""")
def idn02_bind_session(spark, sf_dir):
    o, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    branch = F.element_at(F.array(*map(F.lit, SEGMENTS)), (o % 5 + 1).cast("int"))
    sessions = orders.select(o.alias("session_id"), (cust % 25).alias("project"), (cust % 50).alias("workspace"), F.when(o % 10 == 0, F.concat(F.lit("c"), cust.cast("string"))).alias("explicit"), F.when(o % 3 != 0, branch).alias("branch"), F.lit("BUILDING").alias("default_branch"))
    bound = orders.where(o % 17 == 0).select(o.alias("session_id"), F.concat(F.lit("c"), (cust + 1).cast("string")).alias("old_stream"))
    c = F.col("c_custkey")
    streams = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c.cast("string")).alias("stream_id"), F.col("c_nationkey").cast("long").alias("project"), (c % 50).alias("workspace"), F.col("c_mktsegment").alias("branch"), (F.col("c_acctbal") > 0).alias("active"))
    return identity.bind_sessions(sessions, bound, streams)


_TOPIC_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_-]{2,}'))"


@query(f"""WITH u AS (SELECT conv_id, conv_id % 7 AS project, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_TOPIC_WORDS} AS w FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id AS session_id, project, w, CASE WHEN conv_id % 5 = 0 THEN 'feature' END AS branch FROM u WHERE n = 1), c AS (SELECT 'k' || conv_id AS stream_id, project, w FROM u WHERE n = 1 AND conv_id % 2 = 0),
j AS (SELECT session_id, stream_id, len(list_intersect(s.w, c.w)) / len(list_distinct(list_concat(s.w, c.w))) AS score FROM s JOIN c USING (project) WHERE len(list_intersect(s.w, c.w)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, stream_id) AS p FROM j), b AS (SELECT session_id, max(CASE WHEN p = 1 THEN stream_id END) AS topic, max(CASE WHEN p = 1 THEN score END) AS score, coalesce(max(CASE WHEN p = 2 THEN score END), 0) AS runner FROM r WHERE p <= 2 GROUP BY 1),
t AS (SELECT s.*, CASE WHEN branch IS NULL AND project <> 3 AND score >= 0.45 AND score - runner >= 0.15 THEN topic END AS topic, score FROM s LEFT JOIN b USING (session_id))
SELECT session_id, coalesce(topic, 'ws-' || substr(sha256(CASE WHEN branch IS NULL THEN 'workstream-project-default-v1' || chr(0) || project || chr(0) ELSE 'workstream-branch-v1' || chr(0) || project || chr(0) || branch || chr(0) END), 1, 32)) AS stream,
CASE WHEN topic IS NOT NULL THEN 'strong-topic-margin' WHEN branch IS NOT NULL THEN 'workspace-branch' ELSE 'project-default' END AS reason, CASE WHEN topic IS NOT NULL THEN round(score, 6) ELSE 1.0 END AS confidence FROM t""")
def idn02_topic_binding(spark, sf_dir):
    k = F.col("conv_id")
    first = settled(table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt")))
    nothing = F.lit(None).cast("string")
    sessions = first.select(k.alias("session_id"), (k % 7).alias("project"), nothing.alias("workspace"), nothing.alias("explicit"), F.when(k % 5 == 0, "feature").alias("branch"), nothing.alias("default_branch"), "prompt")
    capsules = first.where("conv_id % 2 = 0").select(F.concat(F.lit("k"), k.cast("string")).alias("stream_id"), (k % 7).alias("project"), F.col("prompt").alias("text"))
    # One project has its default stream already, so topics have no say there.
    streams = capsules.select("stream_id", "project").unionByName(first.select(identity.stream_id(F.lit(3), nothing).alias("stream_id"), F.lit(3).cast("long").alias("project")).distinct())
    streams = streams.select("stream_id", "project", nothing.alias("workspace"), nothing.alias("branch"), F.lit(True).alias("active"))
    bound = sessions.select("session_id", nothing.alias("old_stream")).limit(0)
    return identity.bind_sessions(sessions, bound, streams, identity.topic_streams(sessions, capsules)).withColumn("confidence", F.round("confidence", 6))


@query("""WITH m AS (SELECT user_id AS workspace, ts, event_type AS to_kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_kind FROM events)
SELECT workspace, from_kind, to_kind, min(ts) AS first_at, 'wsloc-' || substr(sha256(workspace || '|' || from_kind || '|' || to_kind), 1, 32) AS event_id FROM m WHERE from_kind <> to_kind GROUP BY 1, 2, 3""")
def idn05_location_changes(spark, sf_dir):
    return identity.location_changes(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""WITH p AS (SELECT l_suppkey AS project, count(DISTINCT l_partkey) % 11 AS revision FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY 1),
s AS (SELECT l_orderkey AS session_id, max(l_suppkey) AS project, count(*) AS seen FROM lineitem GROUP BY 1)
SELECT session_id, project, seen, coalesce(revision, 0) AS current, coalesce(revision, 0) > seen AS stale FROM s LEFT JOIN p USING (project)""")
def idn07_revision_state(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    projects = li.where("l_suppkey % 9 <> 0").groupBy(F.col("l_suppkey").alias("project")).agg((F.count_distinct("l_partkey") % 11).alias("revision"))
    sessions = li.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.max("l_suppkey").alias("project"), F.count(F.lit(1)).alias("seen"))
    return identity.revision_state(sessions, projects)


@query("""WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type <> 'error' AS ok, event_type IN ('purchase', 'signup') AS hit FROM events),
n AS (SELECT *, coalesce(lag(ok) OVER w, false) AS l, coalesce(lead(ok) OVER w, false) AS r FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
a AS (SELECT user_id, pos - CAST(l AS BIGINT) AS lo, pos + CAST(r AS BIGINT) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i FROM n WHERE ok AND hit),
g AS (SELECT user_id, i, lo AS first_pos, hi AS last_pos FROM a WHERE i = 1
    UNION ALL SELECT a.user_id, a.i, CASE WHEN a.lo <= g.last_pos + 1 AND a.hi - g.first_pos + 1 <= 5 THEN g.first_pos ELSE a.lo END, a.hi FROM g JOIN a ON a.user_id = g.user_id AND a.i = g.i + 1)
SELECT user_id, first_pos, max(last_pos) AS last_pos FROM g GROUP BY 1, 2""")
def win11_anchor_windows(spark, sf_dir):
    kind = F.col("event_type")
    return extraction.anchor_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind != "error", kind.isin("purchase", "signup"))


@query(f"""WITH {FACTS}, c AS (SELECT id, id // 10 AS batch, greatest(length(fact), length(project)) > 8000 AS too_long,
    list_sort(list_filter([CASE WHEN regexp_matches(fact, '{FORBIDDEN["fact"]["address"]}') THEN 'address' END, CASE WHEN regexp_matches(fact, '{FORBIDDEN["fact"]["number"]}') THEN 'number' END,
    CASE WHEN regexp_matches(project, '{FORBIDDEN["project"]["source"]}') THEN 'source' END], lambda x: x IS NOT NULL)) AS hits FROM facts),
h AS (SELECT *, bool_or(too_long) OVER (PARTITION BY batch) AS held FROM c)
SELECT id, CASE WHEN held THEN 'held' WHEN len(hits) > 0 THEN 'blocked' ELSE 'kept' END AS state, CASE WHEN NOT held AND len(hits) > 0 THEN array_to_string(hits, ',') ELSE '' END AS pattern_ids FROM h""")
def ext05_block_set(spark, sf_dir):
    items = facts(spark, sf_dir).select("id", F.floor(F.col("id") / 10).alias("batch"), "fact", "project")
    return extraction.block_set(items, "batch", FORBIDDEN).select("id", "state", "pattern_ids")


@query("""WITH r AS (SELECT CAST(NULL AS BIGINT) AS project, o_orderpriority AS rule_id, count(*) AS value FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2
    UNION ALL SELECT o_custkey, o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT q.o_orderkey AS session_id, q.o_custkey AS project, q.o_orderpriority AS rule_id, coalesce(p.value, g.value) AS value, CASE WHEN p.value IS NOT NULL THEN 'project' WHEN g.value IS NOT NULL THEN 'global' ELSE 'none' END AS origin
FROM orders q LEFT JOIN r p ON p.project = q.o_custkey AND p.rule_id = q.o_orderpriority LEFT JOIN r g ON g.project IS NULL AND g.rule_id = q.o_orderpriority""")
def ext06_resolve_rules(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    common = orders.where("o_orderpriority <> '5-LOW'").groupBy(F.lit(None).cast("long").alias("project"), F.col("o_orderpriority").alias("rule_id")).agg(F.count(F.lit(1)).alias("value"))
    own = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("rule_id")).agg(F.count(F.lit(1)).alias("value"))
    requests = orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("rule_id"))
    return extraction.resolve_rules(requests, common.unionByName(own))


@query("""WITH n AS (SELECT doc_id AS case_id, quality = 1 AS now FROM labels WHERE doc_id % 10 <> 3), w AS (SELECT doc_id AS case_id, toxic = 0 AND doc_id % 3 <> 0 AS was FROM labels WHERE doc_id % 10 <> 4)
SELECT case_id, CASE WHEN n.case_id IS NULL OR w.case_id IS NULL THEN 'incomparable' WHEN now IS NULL OR was IS NULL THEN 'unjudged' WHEN NOT was AND now THEN 'improved' WHEN was AND NOT now THEN 'regressed'
WHEN now THEN 'unchanged pass' ELSE 'unchanged failure' END AS change FROM n FULL JOIN w USING (case_id)""")
def ext07_report_diff(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    now = labels.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"))
    was = labels.where("doc_id % 10 <> 4").select(F.col("doc_id").alias("case_id"), ((F.col("toxic") == 0) & (F.col("doc_id") % 3 != 0)).alias("passed"))
    return extraction.compare_reports(now, was)


@query("""WITH r AS (SELECT l_orderkey AS session_id, l_partkey AS fact_id, max(l_linenumber) AS generation, CASE WHEN max(l_linenumber) % 2 = 0 THEN 'global' ELSE 'project' END AS scope FROM lineitem GROUP BY 1, 2),
f AS (SELECT p_partkey AS fact_id, p_size % 8 AS generation, CASE WHEN p_size % 4 < 2 THEN 'global' ELSE 'project' END AS scope FROM part WHERE p_partkey % 50 <> 7),
j AS (SELECT session_id, fact_id, CASE WHEN f.fact_id IS NULL THEN 'gone' WHEN f.scope <> r.scope THEN 'revoked' WHEN f.generation > r.generation THEN 'stale' END AS correction FROM r LEFT JOIN f USING (fact_id))
SELECT * FROM j WHERE correction IS NOT NULL""")
def str07_resident_corrections(spark, sf_dir):
    resident = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("fact_id")).agg(F.max("l_linenumber").alias("generation"))
    resident = resident.withColumn("scope", F.when(F.col("generation") % 2 == 0, "global").otherwise("project"))
    now = table(spark, sf_dir, "part").where("p_partkey % 50 <> 7").select(F.col("p_partkey").alias("fact_id"), (F.col("p_size") % 8).alias("generation"), F.when(F.col("p_size") % 4 < 2, "global").otherwise("project").alias("scope"))
    return continuity.resident_corrections(resident, now)


@query("""WITH e AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS item, min(ts) AS first_at FROM events GROUP BY 1, 2, 3)
SELECT *, first_at + INTERVAL 14 DAYS AS expires_at FROM e WHERE first_at <= TIMESTAMP '2024-01-20 00:00:00' AND first_at + INTERVAL 14 DAYS > TIMESTAMP '2024-01-20 00:00:00'""")
def str08_live_evidence(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("item", F.floor("value").cast("long"))
    return continuity.live_evidence(events, ["user_id", "event_type", "item"], "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"))


def clip_sql(text: str, chars: int = continuity.LINE_CHARS) -> str:
    flat = f"trim(regexp_replace({text}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
    head = f"substr({flat}, 1, {chars - 1})"
    whole = f"regexp_extract({head}, '(?s)^(.*) ', 1)"
    return f"CASE WHEN length({flat}) <= {chars} THEN {flat} ELSE CASE WHEN length({whole}) >= {chars // 2} THEN {whole} ELSE {head} END || '…' END"


@query(f"""WITH {EXCHANGES}, t AS (SELECT session_id, line_start, {clip_sql("coalesce(user_message, '')")} AS line, row_number() OVER (PARTITION BY session_id ORDER BY line_start DESC) AS k FROM exchanges)
SELECT session_id, count(*) AS n_turns, string_agg(line, chr(10) ORDER BY line_start) AS baton FROM t WHERE k <= 8 GROUP BY 1""")
def str12_tail_baton(spark, sf_dir):
    return continuity.tail_baton(exchanges(spark, sf_dir), "session_id", "line_start", "user_message")


_FLAT = "trim(regexp_replace(@, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
_ASK = _FLAT.replace("@", "ask")


@query(f"""WITH {EXCHANGES}, u AS (SELECT session_id, arg_max(trim(user_message), line_start) AS ask FROM exchanges WHERE trim(user_message) <> '' GROUP BY 1),
c AS (SELECT session_id, CASE WHEN length({_ASK}) <= 500 THEN {_ASK} WHEN regexp_extract(substr({_ASK}, 1, 500), '(?s)^(.*[.!?])\\s', 1) <> '' THEN regexp_extract(substr({_ASK}, 1, 500), '(?s)^(.*[.!?])\\s', 1)
    WHEN regexp_extract(substr({_ASK}, 1, 500), '(?s)^(.*\\S)\\s', 1) <> '' THEN regexp_extract(substr({_ASK}, 1, 500), '(?s)^(.*\\S)\\s', 1) ELSE substr({_ASK}, 1, 500) END AS ask FROM u),
l AS (SELECT conv_id AS session_id, 'ran tests/t' || (turn % 5) || '.py on src/m' || (conv_id % 9) || '/a' || (turn % 7) || '.py' || chr(10) || text AS result, (conv_id + turn) % 3 = 0 AS is_error, turn % 4 < 3 AS is_test, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
    FROM conversations WHERE role = 'assistant' QUALIFY n <= 12),
p AS (SELECT session_id, n, unnest(x) AS path, generate_subscripts(x, 1) AS i FROM (SELECT session_id, n, regexp_extract_all(result, '(?:^|\\s)([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)', 1) AS x FROM l)),
f AS (SELECT session_id, path, min(n * 1000000 + i) AS first FROM p GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS k FROM f), t AS (SELECT session_id, string_agg(path, ', ' ORDER BY k) AS touched FROM k WHERE k <= 5 GROUP BY 1),
e AS (SELECT session_id, arg_min(result, n) FILTER (WHERE is_test AND NOT is_error) AS test, arg_min(result, n) FILTER (WHERE is_error) AS error FROM l GROUP BY 1)
SELECT session_id, substr(concat_ws(chr(10), '[WORK NOW — DETERMINISTIC TAIL BATON]', 'Status: context-only', 'Request: ' || ask, 'Touched: ' || touched, 'Observed test evidence (verify): ' || substr({_FLAT.replace("@", "test")}, 1, 300), 'Observed error (verification pending): ' || substr({_FLAT.replace("@", "error")}, 1, 300)), 1, 1200) AS baton
FROM c LEFT JOIN t USING (session_id) LEFT JOIN e USING (session_id)""")
def str12_work_baton(spark, sf_dir):
    k, t, text = F.col("conv_id"), F.col("turn"), lambda c: c.cast("string")
    result = F.concat(F.lit("ran tests/t"), text(t % 5), F.lit(".py on src/m"), text(k % 9), F.lit("/a"), text(t % 7), F.lit(".py\n"), "text")
    tools = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(k.alias("session_id"), t.alias("at"), result.alias("result"), ((k + t) % 3 == 0).alias("is_error"), (t % 4 < 3).alias("is_test"))
    return continuity.work_baton(exchanges(spark, sf_dir), tools)


@query(f"""WITH {EXCHANGES}, c AS (SELECT l_orderkey % 90 AS session_id, l_partkey AS fact_id, max(l_linenumber) AS generation FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), f AS (SELECT p_partkey AS fact_id, p_size % 8 AS generation, p_size % 5 <> 0 AS is_active, p_name AS fact FROM part WHERE p_partkey % 50 <> 7),
t AS (SELECT session_id, line_start, {clip_sql("coalesce(user_message, '')")} AS line, row_number() OVER (PARTITION BY session_id ORDER BY line_start DESC) AS k FROM exchanges)
SELECT session_id, CASE WHEN NOT is_active OR f.generation <> c.generation THEN 'correction' ELSE 'fact' END AS section, fact_id AS rank, CASE WHEN NOT is_active THEN 'No longer active: ' WHEN f.generation <> c.generation THEN 'Updated (supersedes earlier context): ' ELSE '' END || fact AS text FROM c JOIN f USING (fact_id)
UNION ALL SELECT session_id, 'tail', line_start, line FROM t WHERE k <= 8 UNION ALL SELECT user_id, 'hot', event_id, props FROM events WHERE event_type = 'error'""")
def str13_rehydration(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    carry = li.groupBy((F.col("l_orderkey") % 90).alias("session_id"), F.col("l_partkey").alias("fact_id")).agg(F.max("l_linenumber").alias("generation"))
    now = table(spark, sf_dir, "part").where("p_partkey % 50 <> 7").select(F.col("p_partkey").alias("fact_id"), (F.col("p_size") % 8).alias("generation"), (F.col("p_size") % 5 != 0).alias("is_active"), F.col("p_name").alias("fact"))
    hot = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ref"), F.col("props").alias("text"))
    return continuity.rehydration_items(carry, now, exchanges(spark, sf_dir), hot)


SECTIONS = {"decision": ("[Decisions]", 3), "human": ("[Stated]", 4), "tool": ("[Observed]", 2)}


@query(f"""WITH RECURSIVE {FACTS}, k AS (SELECT project, CASE authority WHEN 'decision' THEN 0 WHEN 'human' THEN 1 WHEN 'tool' THEN 2 END AS s, id, '- ' || {clip_sql("fact")} AS line,
    row_number() OVER (PARTITION BY project, authority ORDER BY confirmations DESC, id) AS r FROM facts WHERE authority <> 'unknown'),
o AS (SELECT project, s, r, line, ([3, 4, 2])[s + 1] AS most, (['[Decisions]', '[Stated]', '[Observed]'])[s + 1] AS head, row_number() OVER (PARTITION BY project ORDER BY s, r) AS i FROM k WHERE r <= 5),
b AS (SELECT DISTINCT project, CAST(0 AS BIGINT) AS i, '' AS bundle, CAST(0 AS BIGINT) AS n_lines, -1 AS open, -1 AS closed, false AS truncated FROM o
    UNION ALL SELECT project, i, CASE WHEN skip OR over THEN bundle ELSE grown END, CASE WHEN skip OR over THEN n_lines ELSE n_lines + 1 END, CASE WHEN skip OR over THEN open ELSE s END, CASE WHEN NOT skip AND over THEN s ELSE closed END, truncated OR (NOT skip AND over)
    FROM (SELECT *, closed = s AS skip, r > most OR length(grown) > 1000 OR (open = s AND length(grown) > 700 AND length(line) > 80) AS over
        FROM (SELECT b.project, o.i, b.bundle, b.n_lines, b.open, b.closed, b.truncated, o.s, o.r, o.most, o.line,
            b.bundle || CASE WHEN b.open <> o.s THEN CASE WHEN b.bundle = '' THEN '' ELSE chr(10) || chr(10) END || o.head || chr(10) ELSE chr(10) END || o.line AS grown FROM b JOIN o ON o.project = b.project AND o.i = b.i + 1)))
SELECT project, arg_max(bundle, i) AS bundle, max(n_lines) AS n_lines, bool_or(truncated) AS truncated FROM b GROUP BY 1""")
def gat09_bundle(spark, sf_dir):
    return continuity.render_bundle(facts(spark, sf_dir), "project", "authority", [F.desc("confirmations"), "id"], "fact", SECTIONS)


@query("""WITH w AS (SELECT s_suppkey AS workspace_id, s_nationkey AS project_id, CASE WHEN s_acctbal > 2000 THEN s_suppkey % 25 END AS target FROM supplier),
m AS (SELECT *, target IS NOT NULL AND target <> project_id AS moved FROM w), e AS (SELECT *, count(*) FILTER (WHERE NOT moved) OVER (PARTITION BY project_id) AS stay FROM m)
SELECT workspace_id, coalesce(target, project_id) AS project_id, moved, CASE WHEN moved AND stay = 0 THEN project_id END AS emptied FROM e""")
def idn03_link_workspaces(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    links = supplier.where("s_acctbal > 2000").select(F.col("s_suppkey").alias("workspace_id"), (F.col("s_suppkey") % 25).alias("target"))
    return identity.link_workspaces(supplier.select(F.col("s_suppkey").alias("workspace_id"), F.col("s_nationkey").cast("long").alias("project_id")), links)


@query("""WITH b AS (SELECT o_orderkey AS session_id, o_custkey % 25 AS project, o_custkey AS stream, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + o_orderkey % 4 * 25 END AS wish FROM orders),
t AS (SELECT c_custkey AS sid, c_custkey % 25 + CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS goal_project, c_acctbal > 0 AS active FROM customer),
d AS (SELECT *, CASE WHEN wish IS NULL OR wish = stream THEN 'unchanged' WHEN goal_project IS NULL THEN 'unknown stream' WHEN goal_project <> project THEN 'other project' WHEN NOT active THEN 'inactive' ELSE 'moved' END AS outcome FROM b LEFT JOIN t ON sid = wish)
SELECT session_id, CASE WHEN outcome = 'moved' THEN wish ELSE stream END AS stream, outcome FROM d""")
def idn04_rebind_sessions(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    bindings = orders.select(o.alias("session_id"), (c % 25).alias("project"), c.alias("stream"))
    k = F.col("c_custkey")
    streams = table(spark, sf_dir, "customer").select(k.alias("stream_id"), (k % 25 + (F.col("c_nationkey") == 3).cast("int")).alias("project"), (F.col("c_acctbal") > 0).alias("active"))
    return identity.rebind_sessions(bindings, orders.where("o_orderkey % 3 = 0").select(o.alias("session_id"), (c + o % 4 * 25).alias("stream")), streams)


@query("""WITH d AS (SELECT doc_id AS fact_id, source AS project, CASE WHEN doc_id % 13 = 0 THEN 'X ' ELSE 'slot.' END || (doc_id % 60) AS subject, (['decision', 'project-current', 'workspace', 'workstream'])[CAST(doc_id % 4 + 1 AS INTEGER)] AS state,
    (['explicit-decision', 'merged', 'validated', 'experimental', 'no-branch-signal'])[CAST(doc_id % 4 + 1 + (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS INTEGER)] AS evidence,
    CASE WHEN doc_id % 4 = 2 AND doc_id % 9 <> 0 THEN lang END AS workspace, CASE WHEN doc_id % 4 = 3 AND doc_id % 9 <> 0 THEN lang END AS workstream, n_chars % 5 = 0 AS active FROM documents),
j AS (SELECT *, CASE WHEN NOT regexp_matches(subject, '^[a-z][a-z0-9_.-]{2,160}$') THEN 'bad name'
    WHEN (state = 'decision' AND evidence <> 'explicit-decision') OR (state = 'project-current' AND evidence NOT IN ('merged', 'validated', 'no-branch-signal')) OR (state = 'workstream' AND evidence <> 'experimental') THEN 'bad evidence'
    WHEN (state = 'workspace' AND workspace IS NULL) OR (state = 'workstream' AND workstream IS NULL) OR (state IN ('decision', 'project-current') AND NOT (workspace IS NULL AND workstream IS NULL)) OR (state = 'workspace' AND workstream IS NOT NULL) THEN 'bad scope' END AS wrong FROM d)
SELECT fact_id, CASE WHEN wrong IS NOT NULL THEN wrong
    WHEN EXISTS (SELECT 1 FROM d f WHERE f.active AND f.fact_id <> j.fact_id AND f.project = j.project AND f.subject = j.subject AND f.state = j.state AND f.workspace IS NOT DISTINCT FROM j.workspace AND f.workstream IS NOT DISTINCT FROM j.workstream) THEN 'slot taken'
    WHEN EXISTS (SELECT 1 FROM j o WHERE o.wrong IS NULL AND o.fact_id < j.fact_id AND o.project = j.project AND o.subject = j.subject AND o.state = j.state AND o.workspace IS NOT DISTINCT FROM j.workspace AND o.workstream IS NOT DISTINCT FROM j.workstream) THEN 'later wish' ELSE 'assigned' END AS outcome FROM j""")
def idn06_assign_slots(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        d.alias("fact_id"), F.col("source").alias("project"), F.concat(F.when(d % 13 == 0, "X ").otherwise("slot."), (d % 60).cast("string")).alias("subject"),
        pick(("decision", "project-current", "workspace", "workstream"), d % 4 + 1).alias("state"), pick(("explicit-decision", "merged", "validated", "experimental", "no-branch-signal"), d % 4 + 1 + (d % 7 == 0).cast("int")).alias("evidence"),
        F.when((d % 4 == 2) & (d % 9 != 0), F.col("lang")).alias("workspace"), F.when((d % 4 == 3) & (d % 9 != 0), F.col("lang")).alias("workstream"), (F.col("n_chars") % 5 == 0).alias("active"),
    )
    return identity.assign_slots(rows.drop("active"), rows.drop("evidence"))


@query("""WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN floor(value) END AS marker FROM events),
k AS (SELECT *, marker IS NOT NULL AND row_number() OVER (PARTITION BY user_id, marker ORDER BY ts, event_id) = 1 AS new FROM m)
SELECT event_id, user_id, CAST(sum(CAST(new AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM k""")
def str06_context_epochs(spark, sf_dir):
    return continuity.context_epochs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.floor("value")).select("event_id", "user_id", "epoch")
