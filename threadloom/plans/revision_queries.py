"""Replication, graph and taxonomy edits, evidence, gate and source plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import gate, graph, history, retrieval, revisions
from threadloom.operators.storage import settled
from threadloom.plans.base import FACTS, RELATIONS, facts, query, relations, table

def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(f"""SELECT a.vec_id, CASE WHEN b.vec_id IS NULL THEN 'retrieve' WHEN {_dot('a.embedding', 'b.embedding')} / (sqrt({_dot('a.embedding', 'a.embedding')}) * sqrt({_dot('b.embedding', 'b.embedding')})) - 0.05 >= 0.08 THEN 'skip' ELSE 'retrieve' END AS action
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND b.label % 5 <> 0""")
def gat06_ambiguity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    topic = e.where("label % 5 <> 0").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("topic"))
    similarity = retrieval.cosine(F.col("embedding"), F.col("topic"))
    return e.join(topic, "vec_id", "left").select("vec_id", gate.resolve_ambiguous(F.lit("ambiguous"), similarity, F.lit(0.05)).alias("action"))


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 240) AS head FROM documents), c AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?])\\s', 1) AS s, regexp_extract(head, '(?s)^(.*\\S)\\s', 1) AS w FROM h)
SELECT doc_id, CASE WHEN length(text) <= 240 THEN text WHEN s <> '' THEN s WHEN w <> '' THEN w ELSE head END AS cut FROM c""")
def gat10_sentence_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gate.sentence_cut(F.col("text"), 240).alias("cut"))


@query("""SELECT page_id, md5(replace(replace(replace(CAST(to_json(url || '<b>&"q"') AS VARCHAR), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')) AS envelope FROM pages WHERE url IS NOT NULL""")
def gat12_envelope(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.md5(gate.envelope(F.concat("url", F.lit('<b>&"q"')))).alias("envelope"))


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS answer FROM events""")
def ext10_first_json(spark, sf_dir):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("Here: "), "props", F.lit(" so"))).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("no: "), F.substring("props", 1, 4)))
    return table(spark, sf_dir, "events").select("event_id", text.first_json(said).alias("answer"))


@query("""WITH c AS (SELECT conv_id + CASE WHEN turn = 3 THEN 100000 ELSE 0 END AS conv_id, turn, CASE turn % 4 WHEN 0 THEN substr(text, 3, 20) WHEN 1 THEN substr(text, 1, 3) WHEN 2 THEN substr(text, 3, 20) || '#' ELSE substr(text, 5, 30) END AS span FROM conversations)
SELECT c.conv_id, c.turn, CASE WHEN t.text IS NULL THEN 'no turn' WHEN length(span) NOT BETWEEN 5 AND 200 THEN 'bounds' WHEN NOT contains(t.text, span) THEN 'span' END AS reason FROM c LEFT JOIN conversations t USING (conv_id, turn)""")
def ext02_candidates(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("turn") % 4
    span = F.when(k == 0, F.substring("text", 3, 20)).when(k == 1, F.substring("text", 1, 3)).when(k == 2, F.concat(F.substring("text", 3, 20), F.lit("#"))).otherwise(F.substring("text", 5, 30))
    asked = c.select((F.col("conv_id") + F.when(F.col("turn") == 3, 100000).otherwise(0)).alias("conv_id"), "turn", span.alias("span"))
    return revisions.check_candidates(asked, c, ["conv_id", "turn"], "span", "text")


@query("""SELECT i.event_id, CASE WHEN s_suppkey IS NOT NULL THEN 'tombstoned' WHEN l.event_id IS NULL THEN 'insert' WHEN l.event_type = i.event_type THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM (SELECT event_id + CASE WHEN event_id % 10 = 7 THEN 1000000000 ELSE 0 END AS event_id, CASE WHEN event_id % 6 = 1 THEN 'view' ELSE event_type END AS event_type FROM events) i LEFT JOIN events l USING (event_id) LEFT JOIN supplier ON s_suppkey = i.event_id""")
def chr03_replicated_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    incoming = e.select((k + F.when(k % 10 == 7, 1000000000).otherwise(0)).alias("event_id"), F.when(k % 6 == 1, "view").otherwise(F.col("event_type")).alias("event_type"))
    return revisions.replicate(incoming, e, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("event_id")), "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, bool_or(event_type IN ('click', 'purchase') AND event_id % 70 = 0) AS decided, bool_or(event_type IN ('click', 'purchase') AND event_id % 70 < 2) AS said, bool_or(event_type = 'error') AS tool FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN decided THEN 'human-decision' WHEN said THEN 'human' WHEN tool THEN 'trusted-tool' ELSE 'unknown' END AS authority FROM e""")
def chr06_authority(spark, sf_dir):
    k = F.col("event_id")
    human = F.col("event_type").isin("click", "purchase") & (k % 70 < 2)
    source = F.when(human, "human").when(F.col("event_type") == "error", "tool").otherwise("other")
    kind = F.when(k % 140 == 0, "correction").when(k % 70 == 0, "decision").otherwise("note")
    # Kinds of evidence are few, so a set of them is bounded.
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.struct(source.alias("source"), kind.alias("kind"))).alias("evidence"))
    return per.select("user_id", revisions.authority(F.col("evidence")).alias("authority"))


@query("WITH p AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS applied, max(ts) AS source_at FROM events GROUP BY 1) SELECT user_id, coalesce(applied, source_at) AS effective_at, applied IS NULL AS inferred FROM p")
def chr07_effective_time(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("applied"), F.max("ts").alias("source_at"))
    return p.select("user_id", F.coalesce("applied", "source_at").alias("effective_at"), F.col("applied").isNull().alias("inferred"))


@query(f"WITH {FACTS} SELECT category, id // 3 AS slot, CASE WHEN count(DISTINCT age_days % 2) > 1 THEN 'blocked' WHEN count(DISTINCT project) > 1 THEN 'promote' ELSE 'stay' END AS move FROM facts WHERE is_active GROUP BY 1, 2")
def chr15_tier_moves(spark, sf_dir):
    f = facts(spark, sf_dir).where("is_active").select("category", F.floor(F.col("id") / 3).alias("slot"), (F.col("age_days") % 2).alias("said"), "project")
    return revisions.tier_moves(f, ["category", "slot"], "said", "project")


@query("SELECT user_id, count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END) AS revision FROM events GROUP BY 1")
def chr16_project_revision(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("purchase", "signup")).alias("revision"))


@query("SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN sha256(d.source || '|' || d.text || '|' || e.label) END AS snapshot FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id * 2")
def chr18_source_snapshot(spark, sf_dir):
    tools = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "label")
    d = table(spark, sf_dir, "documents")
    snapshot = F.sha2(F.concat_ws("|", "source", "text", F.col("label").cast("string")), 256)
    return d.join(tools, tools["vec_id"] == d["doc_id"] * 2, "left").select("doc_id", F.when(F.col("vec_id").isNotNull(), snapshot).alias("snapshot"))


_MORE = "w AS (SELECT DISTINCT l_partkey * 2 AS source_id, l_suppkey * 2 + 1 AS target_id, CASE WHEN l_linenumber % 2 = 0 THEN 'SUPPORTS' ELSE 'RELATES' END AS relation_type FROM lineitem WHERE l_quantity > 40)"


@query(f"WITH {FACTS}, {RELATIONS}, {_MORE}, n AS (SELECT id FROM facts WHERE is_active) SELECT source_id, target_id, relation_type FROM w ANTI JOIN relations USING (source_id, target_id, relation_type) WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def grf03_new_relations(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "SUPPORTS").otherwise("RELATES")
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select((F.col("l_partkey") * 2).alias("source_id"), (F.col("l_suppkey") * 2 + 1).alias("target_id"), kind.alias("relation_type"))
    return revisions.new_relations(wanted, relations(spark, sf_dir), facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT category, id, confirmations FROM facts WHERE is_active QUALIFY row_number() OVER (PARTITION BY category ORDER BY confirmations DESC, id) <= 25")
def grf07_facts_by_category(spark, sf_dir):
    w = Window.partitionBy("category").orderBy(F.desc("confirmations"), "id")
    return facts(spark, sf_dir).where("is_active").withColumn("n", F.row_number().over(w)).where("n <= 25").select("category", "id", "confirmations")


@query(f"WITH {FACTS} SELECT CASE WHEN category = 'fr' THEN 'EN' ELSE category END AS category, count(*) AS n FROM facts GROUP BY 1")
def grf11_rename_category(spark, sf_dir):
    return revisions.rename_category(facts(spark, sf_dir), "FR", "en", "EN").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS} SELECT w.k AS id, w.v AS value, coalesce(f.confirmations = w.g AND w.e = 1, false) AS done FROM (SELECT doc_id * 2 AS k, lang AS v, doc_id * 14 % 23 AS g, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS e FROM documents) w LEFT JOIN facts f ON f.id = w.k")
def grf12_compare_and_set(spark, sf_dir):
    d = F.col("doc_id")
    wanted = table(spark, sf_dir, "documents").select((d * 2).alias("id"), F.col("lang").alias("value"), (d * 14 % 23).alias("generation"), F.when(d % 5 == 0, 0).otherwise(1).alias("epoch"))
    return revisions.compare_and_set(facts(spark, sf_dir).select("id", F.col("confirmations").alias("generation")), wanted, 1)


@query("""SELECT coalesce(d.l_orderkey, p.l_orderkey) AS l_orderkey, coalesce(d.l_linenumber, p.l_linenumber) AS l_linenumber, CASE WHEN d.l_orderkey IS NULL THEN 'delete' WHEN p.l_orderkey IS NULL THEN 'insert' WHEN d.c <> p.c THEN 'update' ELSE 'keep' END AS action
FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS c FROM lineitem WHERE l_suppkey % 7 <> 0) d FULL JOIN (SELECT l_orderkey, l_linenumber, l_suppkey + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS c FROM lineitem WHERE l_partkey % 5 <> 0) p ON d.l_orderkey = p.l_orderkey AND d.l_linenumber = p.l_linenumber""")
def src12_reconcile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    desired = li.where("l_suppkey % 7 <> 0").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("c"))
    present = li.where("l_partkey % 5 <> 0").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)).alias("c"))
    return revisions.reconcile(desired, present, ["l_orderkey", "l_linenumber"], "c")


@query("SELECT d.doc_id, CASE WHEN p.page_id IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id WHERE p.page_id IS NULL OR d.n_chars > length(p.url) * 40")
def src15_newer_copies(spark, sf_dir):
    source = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("clock"))
    copies = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), (F.length("url") * 40).cast("long").alias("clock"))
    return revisions.newer_copies(source, copies, "doc_id", "clock")


@query("""WITH f AS (SELECT l_suppkey AS device, l_shipmode AS name, count(*) AS n_rows, sha256('' || sum(l_partkey)) AS h FROM (SELECT *, 'part-' || (l_linenumber % 4) AS l_shipmode FROM lineitem) GROUP BY 1, 2),
m AS (SELECT device, name, n_rows + CASE WHEN device % 9 = 0 AND name = 'part-1' THEN 1 ELSE 0 END AS want_rows, CASE WHEN device % 7 = 0 AND name = 'part-2' THEN 'x' ELSE h END AS want, device % 11 = 0 AND name = 'part-3' AS lost, n_rows, h FROM f)
SELECT device, min(CASE WHEN lost THEN 'missing file' WHEN n_rows <> want_rows THEN 'row count' WHEN h <> want THEN 'sha256' END) AS reason FROM m GROUP BY 1""")
def src23_validate_generations(spark, sf_dir):
    name = F.concat(F.lit("part-"), (F.col("l_linenumber") % 4).cast("string"))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("device"), name.alias("name")).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.sum("l_partkey").cast("string"), 256).alias("sha256"))
    wrong = lambda m, n: (F.col("device") % m == 0) & (F.col("name") == n)
    manifest = files.select("device", "name", (F.col("n_rows") + F.when(wrong(9, "part-1"), 1).otherwise(0)).alias("want_rows"), F.when(wrong(7, "part-2"), "x").otherwise(F.col("sha256")).alias("want_sha256"))
    return revisions.validate_generations(files.where(~wrong(11, "part-3")), manifest)


_SIGNATURE = "lower(coalesce(text, ''))"
for _pattern, _name in history.SIGNATURE:
    _SIGNATURE = f"regexp_replace({_SIGNATURE}, '{_pattern}', '{_name}', 'g')"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(text, '[^a-z0-9_]+'), lambda w: length(w) >= 3))"


@query(f"""WITH d AS (SELECT doc_id, substr(trim(regexp_replace({_SIGNATURE}, '{history.WHITE}+', ' ', 'g'), ' '), 1, 240) AS text FROM documents), s AS (SELECT substr(sha256(text), 1, 24) AS key, text, count(*) AS episodes, max(doc_id) AS last_at FROM d GROUP BY text), n AS (SELECT *, {_WORDS} AS sw FROM s ORDER BY last_at DESC, key LIMIT 500),
p AS (SELECT doc_id AS probe_id, text AS p, {_WORDS} AS pw FROM d), j AS (SELECT probe_id, key, episodes, CASE WHEN length(text) >= 20 AND contains(p, text) THEN 1.0 WHEN len(sw) > 0 THEN len(list_intersect(sw, pw)) / len(list_distinct(list_concat(sw, pw))) ELSE 0.0 END AS score FROM p, n)
SELECT probe_id, key, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY j.score DESC, episodes DESC, key) AS INTEGER) AS place FROM j WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY j.score DESC, episodes DESC, key) <= 5""")
def inc05_pattern_match(spark, sf_dir):
    d = settled(table(spark, sf_dir, "documents").select("doc_id", history.signature(F.col("text")).alias("text")))
    known = d.groupBy("text").agg(F.count(F.lit(1)).alias("episodes"), F.max("doc_id").alias("last_at")).select(F.substring(F.sha2("text", 256), 1, 24).alias("key"), "text", "episodes", "last_at")
    return revisions.match_patterns(known, d.withColumnRenamed("doc_id", "probe_id")).withColumn("score", F.round("score", 6))


@query("SELECT c.event_id AS call_id, r.event_id AS result_id, r.event_id IS NULL AS interrupted FROM (SELECT event_id, user_id FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'purchase') r ON r.event_id = c.event_id + 1")
def join17_call_result(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    results = e.where("event_type = 'purchase'").select(F.col("event_id").alias("result_id"), (F.col("event_id") - 1).alias("call_id"))
    return e.where("event_type = 'click'").select(F.col("event_id").alias("call_id")).join(results, "call_id", "left").withColumn("interrupted", F.col("result_id").isNull())


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'view' AND (value < 20 OR (value = 20 AND event_id > 100)) ORDER BY value DESC, event_id LIMIT 60")
def top06_mixed_keyset(spark, sf_dir):
    after = (F.col("value") < 20) | ((F.col("value") == 20) & (F.col("event_id") > 100))
    return table(spark, sf_dir, "events").where((F.col("event_type") == "view") & after).orderBy(F.desc("value"), "event_id").limit(60).select("event_id", "ts", "value")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_id FROM conversations")
def win05_running_turn(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("turn_id"))


@query(f"WITH {FACTS} SELECT id, is_active AND id % 4 <> 0 AS is_active, confirmations + CASE WHEN is_active AND id % 4 = 0 THEN 1 ELSE 0 END AS generation, vec_id IS NOT NULL AND is_active AND id % 4 <> 0 AS has_vector FROM facts LEFT JOIN embeddings ON vec_id = id")
def dat01_deactivate(spark, sf_dir):
    f = facts(spark, sf_dir).select("id", "is_active", "confirmations")
    off = F.col("is_active") & (F.col("id") % 4 == 0)
    after = f.select("id", (F.col("is_active") & ~off).alias("is_active"), (F.col("confirmations") + F.when(off, 1).otherwise(0)).alias("generation"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("_vector"))
    return after.join(vectors, "id", "left").select("id", "is_active", "generation", (F.col("_vector").isNotNull() & F.col("is_active")).alias("has_vector"))


@query("SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END AS fact_id, l_orderkey AS exchange_id, l_returnflag AS kind FROM lineitem")
def dat02_dependencies(spark, sf_dir):
    # What a retired fact depends on is copied to its survivor; equal rows stay once.
    fact = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select(fact.alias("fact_id"), F.col("l_orderkey").alias("exchange_id"), F.col("l_returnflag").alias("kind")).dropDuplicates()


@query("SELECT user_id, event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE WHEN event_id % 4 = 0 THEN props END, 'none') AS reason FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def dat03_revision_view(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    reason = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.when(F.col("event_id") % 4 == 0, F.col("props")), F.lit("none"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 30").select("user_id", "event_id", reason.alias("reason"))


@query(f"WITH {FACTS} SELECT f.id, coalesce(r.g = f.confirmations AND r.h = sha256(f.fact), false) AS evident FROM facts f LEFT JOIN (SELECT doc_id AS id, doc_id * 7 % 23 + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS g, sha256(text || CASE WHEN doc_id % 9 = 0 THEN '?' ELSE '' END) AS h FROM documents WHERE doc_id % 5 <> 0) r USING (id)")
def dat04_meaning_evidence(spark, sf_dir):
    d = F.col("doc_id")
    receipt = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(d.alias("id"), (d * 7 % 23 + F.when(d % 8 == 0, 1).otherwise(0)).alias("g"), F.sha2(F.concat("text", F.when(d % 9 == 0, "?").otherwise("")), 256).alias("h"))
    same = (F.col("g") == F.col("confirmations")) & (F.col("h") == F.sha2("fact", 256))
    return facts(spark, sf_dir).select("id", "confirmations", "fact").join(receipt, "id", "left").select("id", F.coalesce(same, F.lit(False)).alias("evident"))


@query(f"WITH {FACTS} SELECT id, CASE WHEN category = 'en' THEN category WHEN confirmations >= 3 THEN 'fallback' END AS category, category <> 'en' AND confirmations >= 3 AS parked FROM facts WHERE is_active")
def dat06_park(spark, sf_dir):
    open_, tired = F.col("category") != "en", F.col("confirmations") >= 3
    return facts(spark, sf_dir).where("is_active").select("id", F.when(~open_, F.col("category")).when(tired, "fallback").alias("category"), (open_ & tired).alias("parked"))


@query(f"WITH {RELATIONS}, s AS (SELECT CAST(unnest([20, 40, 60]) AS BIGINT) AS seed), n AS (SELECT seed, target_id AS id, created_at FROM relations JOIN s ON source_id = seed), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY created_at, id) AS pos FROM n) SELECT min(seed) AS seed, id FROM r WHERE pos <= 20 GROUP BY id")
def grf02_explore(spark, sf_dir):
    # Twenty neighbours for each seed, then each found node once, under its first seed.
    near = graph.both_ways(relations(spark, sf_dir)).where(F.col("from").isin(20, 40, 60))
    w = Window.partitionBy("from").orderBy("created_at", "to")
    return near.withColumn("n", F.row_number().over(w)).where("n <= 20").groupBy(F.col("to").alias("id")).agg(F.min("from").alias("seed"))
