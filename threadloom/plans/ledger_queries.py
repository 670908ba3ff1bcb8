"""Jobs, fences, receipts, repairs and the joins between ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import ledger
from threadloom.plans.base import EXCHANGES, FACTS, RELATIONS, exchanges, facts, query, relations, table

NOW = "2024-01-20 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")


@query("SELECT o_custkey, o_orderdate, count(*) AS n, min(o_orderpriority) AS target, min(o_orderpriority) <> max(o_orderpriority) AS conflict FROM orders GROUP BY 1, 2")
def job01_outbox(spark, sf_dir):
    return ledger.outbox(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "target"), ["o_custkey", "o_orderdate"], "target")


@query(f"""SELECT event_id, event_type = 'click' AND user_id % 5 = event_id % 5 AND event_id % 3 = user_id % 3 AND ts + INTERVAL 6 DAYS > {_NOW} AS may_complete FROM events""")
def job02_fenced_completion(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    state = F.when(F.col("event_type") == "click", "running").otherwise("pending")
    return table(spark, sf_dir, "events").select("event_id", ledger.may_complete(state, u % 5, e % 5, e % 3, u % 3, F.col("ts") + F.expr("INTERVAL 6 DAYS"), now()).alias("may_complete"))


@query("SELECT l_orderkey, l_linenumber, o_custkey % 5 AS requeue_for FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 5 <> o_custkey % 5")
def job06_superseded(spark, sf_dir):
    jobs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("generation"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("generation"))
    return ledger.superseded(jobs, targets, "l_orderkey", "generation").select("l_orderkey", "l_linenumber", F.col("now").alias("requeue_for"))


@query("""WITH c AS (SELECT user_id, event_id, CAST(round(value * 20) AS BIGINT) AS size, event_type = 'purchase' AS boundary FROM events), l AS (SELECT user_id, max(event_id) AS last FROM c WHERE boundary GROUP BY 1)
SELECT user_id, count(*) AS boundaries, CAST(sum(greatest(size, 0)) AS BIGINT) AS bytes, count(*) >= 6 OR sum(greatest(size, 0)) >= 8192 AS due FROM c LEFT JOIN l USING (user_id) WHERE last IS NULL OR event_id > last GROUP BY 1""")
def job10_coalesced(spark, sf_dir):
    c = table(spark, sf_dir, "events").withColumn("size", F.round(F.col("value") * 20).cast("long"))
    return ledger.coalesced(c, "user_id", "event_id", F.col("size"), F.col("event_type") == "purchase")


@query("""WITH s AS (SELECT *, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(CASE WHEN b = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS total FROM r) SELECT event_id, total, (total - 1) % 3 + 1 AS consecutive, total % 3 = 0 AS forced FROM t""")
def str18_starvation(spark, sf_dir):
    return ledger.starvation(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "total", "consecutive", "forced")


@query(f"SELECT event_type, count(*) AS n, arg_min(event_id, (ts, event_id)) AS oldest FROM events WHERE ts > {_NOW} - INTERVAL 12 DAYS GROUP BY 1")
def str19_gap_markers(spark, sf_dir):
    return ledger.gap_report(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", now(), 12)


@query("SELECT l_partkey AS exchange, arg_max(l_linenumber, (l_linenumber, l_suppkey)) AS line_end, arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS generation, count(*) - 1 AS ignored FROM lineitem GROUP BY 1")
def str02_monotone_input(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("exchange"), F.col("l_linenumber").alias("line_end"), F.col("l_suppkey").alias("generation"))
    return ledger.monotone(rows, "exchange", ["line_end", "generation"])


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= o_custkey % 5 + 1 AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber AND p.l_returnflag = 'R')")
def str15_fenced_targets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    fixed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5 + 1).alias("l_linenumber"))
    return ledger.fence(li.select("l_orderkey", "l_linenumber"), li.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], "l_linenumber", fixed, "l_orderkey")


_PAGE = "WITH j AS (SELECT l_orderkey, l_partkey % 2 = p_size % 2 AS same FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 45)"


@query(f"{_PAGE} SELECT l_orderkey, count(*) AS n, count(CASE WHEN same THEN 1 END) AS current, count(*) = count(CASE WHEN same THEN 1 END) AS commit FROM j GROUP BY 1")
def str16_page_commit(spark, sf_dir):
    page = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_partkey") % 2).alias("generation"))
    have = table(spark, sf_dir, "part").where("p_size < 45").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 2).alias("generation"))
    return ledger.page_current(page, have, "l_orderkey", "l_partkey", "generation")


@query(f"{_PAGE}, g AS (SELECT l_orderkey, count(*) AS n, count(CASE WHEN same THEN 1 END) AS c FROM j GROUP BY 1) SELECT o_orderstatus, count(*) AS pages, count(CASE WHEN n = c THEN 1 END) AS committed FROM g JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def join16_row_count_guard(spark, sf_dir):
    pages = str16_page_commit(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return pages.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("pages"), F.count_if("commit").alias("committed"))


@query("""SELECT l_suppkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS failed, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS recovered, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS dismissed,
CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) + 1 ELSE 0 END) AS BIGINT) AS open_items FROM lineitem GROUP BY 1""")
def str17_failed_ranges(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "recovered").otherwise("dismissed")
    first = F.col("l_linenumber").cast("long")
    ranges = table(spark, sf_dir, "lineitem").select("l_suppkey", state.alias("state"), first.alias("first_pos"), (first + F.col("l_quantity").cast("long")).alias("last_pos"))
    return ledger.failed_ranges(ranges, "l_suppkey")


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'config' WHEN event_id % 11 = 1 THEN 'input-limit' END AS code, CASE WHEN event_id % 7 = 0 THEN 400 + event_id % 120 END AS status,
CASE event_id % 6 WHEN 0 THEN 'Status code: ' || (400 + user_id % 110) WHEN 1 THEN 'prompt Too Long' WHEN 2 THEN 'read TIMEOUT' WHEN 3 THEN event_type WHEN 4 THEN 'rate limit' ELSE (['API Error: 503 x', 'http error 422', 'retry after 400 ms', 'stream closed', 'invalid api key', 'connect ENOTFOUND', 'response 400 ms timeout'])[CAST(user_id % 7 + 1 AS INTEGER)] END AS message FROM events),
c AS (SELECT *, coalesce(status, try_cast(nullif(regexp_extract(lower(message), 'status code: ([0-9]{3})', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(lower(message), '(?:api|http) error:? ([0-9]{3})', 1), '') AS BIGINT)) AS s FROM m)
SELECT event_id, CASE WHEN code = 'config' THEN 'config' WHEN code IS NOT NULL THEN 'deterministic' WHEN s IN (401, 403, 404, 429) OR s >= 500 THEN 'transient' WHEN s IN (400, 413, 422) THEN 'deterministic' WHEN s IS NOT NULL THEN 'unknown'
WHEN message = 'prompt Too Long' THEN 'deterministic' WHEN message IN ('read TIMEOUT', 'rate limit', 'stream closed', 'invalid api key', 'connect ENOTFOUND', 'response 400 ms timeout') THEN 'transient' ELSE 'unknown' END AS error_class FROM c""")
def ext09_error_class(spark, sf_dir):
    e, k = F.col("event_id"), F.col("event_id") % 6
    code = F.when(e % 11 == 0, "config").when(e % 11 == 1, "input-limit")
    message = F.when(k == 0, F.concat(F.lit("Status code: "), (F.col("user_id") % 110 + 400).cast("string"))).when(k == 1, "prompt Too Long").when(k == 2, "read TIMEOUT").when(k == 3, F.col("event_type")).when(k == 4, "rate limit")
    said = F.array(*map(F.lit, ("API Error: 503 x", "http error 422", "retry after 400 ms", "stream closed", "invalid api key", "connect ENOTFOUND", "response 400 ms timeout")))
    message = message.otherwise(F.element_at(said, (F.col("user_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", ledger.error_class(F.coalesce(code, F.lit("")), F.when(e % 7 == 0, e % 120 + 400), message).alias("error_class"))


@query("SELECT user_id % 500 * 10 + event_id % 10 AS receipt, CASE WHEN bool_or(event_type = 'purchase') THEN 'emitted' ELSE 'prepared' END AS status, min(ts) AS first_at FROM events GROUP BY 1")
def mrg06_receipts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 500 * 10 + F.col("event_id") % 10).alias("receipt"), F.when(F.col("event_type") == "purchase", "emitted").otherwise("prepared").alias("status"), F.col("ts").alias("created_at"))
    return ledger.receipts(rows, "receipt")


@query(f"WITH {FACTS}, {RELATIONS}, a AS (SELECT id FROM facts WHERE is_active) SELECT 'orphan-vector' AS code, vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM a) UNION ALL SELECT 'orphan-relation', source_id FROM relations WHERE source_id NOT IN (SELECT id FROM a)")
def join07_orphans(spark, sf_dir):
    f = facts(spark, sf_dir).select("id", "is_active")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"))
    return ledger.orphans(vectors, f, "key", "orphan-vector").unionByName(ledger.orphans(relations(spark, sf_dir).select(F.col("source_id").alias("key")), f, "key", "orphan-relation"))


@query(f"WITH {FACTS}, s AS (SELECT id, unnest([id % 700, id * 3 % 1100]) AS src FROM facts) SELECT id, count(*) AS n_sources, count(CASE WHEN vec_id IS NULL THEN 1 END) AS missing, count(CASE WHEN vec_id IS NULL THEN 1 END) = 0 AS repairable FROM s LEFT JOIN embeddings ON vec_id = src GROUP BY id")
def flt18_missing_evidence(spark, sf_dir):
    rows = facts(spark, sf_dir).select("id", F.array(F.col("id") % 700, F.col("id") * 3 % 1100).alias("sources"))
    return ledger.all_sources_resolve(rows, "id", "sources", table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src")), "src")


@query("""WITH f AS (SELECT user_id, max(ts) AS fixed_at FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, count(CASE WHEN ts <= fixed_at THEN 1 END) AS closed, count(CASE WHEN fixed_at IS NULL OR ts > fixed_at THEN 1 END) AS still_open FROM events LEFT JOIN f USING (user_id) WHERE event_type = 'error' GROUP BY 1""")
def inc04_remediation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ledger.remediate(e.where("event_type = 'error'").select("user_id", F.col("ts").alias("at")), e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("fixed_at")), ["user_id"])


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def inc06_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "ts")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, count(CASE WHEN r <= 8 THEN 1 END) AS kept, count(CASE WHEN r > 8 THEN 1 END) AS dropped, count(CASE WHEN r <= 8 AND length(text) > 500 THEN 1 END) AS clamped,
CAST(sum(CASE WHEN r <= 8 THEN least(length(text), 500) ELSE 0 END) AS BIGINT) AS chars FROM n GROUP BY 1""")
def str11_capped_items(spark, sf_dir):
    return ledger.capped(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], "text")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_partkey, l_suppkey) FROM lineitem WHERE l_linestatus = 'F')")
def join08_not_yet_appended(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    li = table(spark, sf_dir, "lineitem")
    return li.select(*keys).join(li.where("l_linestatus = 'F'").select(*keys), keys, "left_anti")


@query("""SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) OR event_id % 100 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)""")
def join09_cited_in_scope(spark, sf_dir):
    cited = F.from_json(F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), (F.col("event_id") % 100).cast("string"), F.lit("]")), "array<bigint>")
    inside = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("cited"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(cited).alias("cited")).join(inside, "cited", "left_semi").select("event_id").distinct()


@query("SELECT DISTINCT o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def join10_sessions_in_scope(spark, sf_dir):
    inside = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(inside, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 AND s_suppkey IS NOT NULL)")
def join11_not_excluded(spark, sf_dir):
    # A null among the excluded keys excludes nothing here; NOT IN would drop every row.
    excluded = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey")).alias("user_id"), F.col("s_suppkey").alias("real"))
    kept = table(spark, sf_dir, "events").select("event_id", "user_id").join(excluded.select("user_id"), "user_id", "left_anti")
    return kept.join(excluded.where("user_id is null").select(F.col("real").alias("user_id")), "user_id", "left_anti").select("event_id")


@query(f"WITH {EXCHANGES} SELECT session_id, arg_min(substr(user_message, 1, 80), line_start) AS title, count(*) AS n FROM exchanges GROUP BY 1")
def join15_session_title(spark, sf_dir):
    return exchanges(spark, sf_dir).groupBy("session_id").agg(F.min_by(F.substring("user_message", 1, 80), "line_start").alias("title"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS}, c AS (SELECT DISTINCT category, md5(category) AS category_id, CASE WHEN category < 'f' THEN 'first' ELSE 'second' END AS domain FROM facts) SELECT domain, count(DISTINCT category_id) AS categories, count(*) AS n FROM facts JOIN c USING (category) WHERE is_active GROUP BY 1")
def join05_star(spark, sf_dir):
    f = facts(spark, sf_dir)
    categories = f.select("category", F.md5("category").alias("category_id"), F.when(F.col("category") < "f", "first").otherwise("second").alias("domain")).distinct()
    return f.where("is_active").select("category").join(categories, "category").groupBy("domain").agg(F.count_distinct("category_id").alias("categories"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, o_orderstatus, coalesce(c_mktsegment, 'none') AS segment, o_orderkey IS NULL AS unbound FROM events LEFT JOIN orders ON o_orderkey = event_id * 3 LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def join06_job_chain(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 3).alias("o_orderkey"))
    targets = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("_there"))
    checkpoints = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    joined = jobs.join(targets, "o_orderkey", "left").join(checkpoints, "c_custkey", "left")
    return joined.select("event_id", "o_orderstatus", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), F.col("_there").isNull().alias("unbound"))


@query(f"WITH {RELATIONS} SELECT CASE WHEN source_id = 40 THEN target_id ELSE source_id END AS other, relation_type FROM relations WHERE source_id = 40 OR target_id = 41")
def join13_other_end(spark, sf_dir):
    here = (F.col("source_id") == 40) | (F.col("target_id") == 41)
    return relations(spark, sf_dir).where(here).select(F.when(F.col("source_id") == 40, F.col("target_id")).otherwise(F.col("source_id")).alias("other"), "relation_type")


@query(r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 1 THEN ' !. ' WHEN 2 THEN '...' WHEN 3 THEN '。 ' ELSE '' END AS text FROM documents) SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[.!。]+$', ''), ' ')) AS normal FROM t""")
def ext04_normal_text(spark, sf_dir):
    k = F.col("doc_id") % 4
    end = F.when(k == 1, " !. ").when(k == 2, "...").when(k == 3, "。 ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized_fact(F.concat("text", end))).alias("normal"))


@query("""WITH p AS (SELECT conv_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^가-힣]', '', 'g')) AS hangul FROM conversations WHERE role = 'user') SELECT conv_id, CASE WHEN sum(hangul) * 2.5 > sum(latin) THEN 'ko' WHEN sum(latin) > sum(hangul) * 2.5 THEN 'en' END AS language, CAST(sum(latin) AS BIGINT) AS latin FROM p GROUP BY 1""")
def ext01_window_language(spark, sf_dir):
    p = text.prose(F.col("text"))
    counts = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.length(F.regexp_replace(p, r"[^\x{AC00}-\x{D7A3}]", "")).alias("hangul"), F.length(F.regexp_replace(p, "[^A-Za-z]", "")).alias("latin"))
    sums = counts.groupBy("conv_id").agg(F.sum("hangul").alias("h"), F.sum("latin").alias("latin"))
    return sums.select("conv_id", F.when(F.col("h") * 2.5 > F.col("latin"), "ko").when(F.col("latin") > F.col("h") * 2.5, "en").alias("language"), "latin")


@query("""SELECT doc_id, md5('["' || source || '","' || lang || '",' || n_chars || ']') AS conflict_key FROM documents""")
def mrg02_conflict_key(spark, sf_dir):
    fields = F.concat(F.lit('["'), "source", F.lit('","'), "lang", F.lit('",'), F.col("n_chars").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fields).alias("conflict_key"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS injected, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def dat08_recall_ledger(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    return seen.select("user_id", F.array_join("s", ",").alias("injected"), F.size("s").cast("long").alias("n"))


@query("SELECT l_suppkey AS device, l_shipdate AS generation FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) <= 2")
def dat13_kept_generations(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device"), F.col("l_shipdate").alias("generation")).distinct()
    return g.withColumn("n", F.row_number().over(Window.partitionBy("device").orderBy(F.desc("generation")))).where("n <= 2").drop("n")


@query("SELECT d.doc_id, md5(d.text) = md5(d.text || CASE WHEN d.doc_id % 9 = 0 THEN '!' ELSE '' END) AS unchanged FROM documents d JOIN embeddings ON vec_id = doc_id")
def dat14_reembed_commit(spark, sf_dir):
    # The hash taken when the vector was asked for against the one of the text at commit.
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("before"), F.md5(F.concat("text", F.when(F.col("doc_id") % 9 == 0, "!").otherwise(""))).alias("now"))
    return d.join(vectors, "doc_id", "left_semi").select("doc_id", (F.col("before") == F.col("now")).alias("unchanged"))


@query("""SELECT event_type, user_id, count(*) AS episodes, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2""")
def agg25_signature_recount(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("episodes"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


_DOMAIN = "CASE WHEN category IN ('en', 'de') THEN 'germanic' WHEN category IN ('fr', 'es') THEN 'romance' END"


@query(f"WITH {FACTS}, {RELATIONS}, n AS (SELECT id FROM facts WHERE is_active) SELECT 'category' AS kind, category AS name, count(*) AS n FROM facts WHERE is_active GROUP BY 2 UNION ALL SELECT 'domain', {_DOMAIN}, count(*) FROM facts WHERE is_active GROUP BY 2 UNION ALL SELECT 'relation', relation_type, count(*) FROM relations WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) GROUP BY 2")
def agg10_graph_stats(spark, sf_dir):
    from threadloom.operators.graph import stats

    f = facts(spark, sf_dir).where("is_active").select("id", "category", F.expr(_DOMAIN).alias("domain"))
    return stats(f, relations(spark, sf_dir))
