"""Transcripts, turns, scopes and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import scope, turns
from threadloom.plans.base import EXCHANGES, FACTS, exchanges, facts, query, table


@query(f"WITH {EXCHANGES} SELECT * FROM exchanges")
def src05_turn_assembly(spark, sf_dir):
    return exchanges(spark, sf_dir)


@query("""SELECT conv_id, min_by(role, turn) AS first_role, min_by(text, turn) AS first_text, count(*) AS n_lines FROM conversations GROUP BY conv_id""")
def src02_header_peek(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.min_by("text", "turn").alias("first_text"), F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT url, CASE WHEN regexp_extract(url, '.*/([^/?#]+)', 1) = '' THEN NULL ELSE regexp_extract(url, '.*/([^/?#]+)', 1) END AS last_part FROM pages""")
def src04_id_from_path(spark, sf_dir):
    part = F.regexp_extract("url", ".*/([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select("url", F.when(part != "", part).alias("last_part"))


@query("""SELECT conv_id, turn, role, bytes_through FROM (SELECT *, CAST(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS bytes_through FROM conversations) WHERE bytes_through <= 2000""")
def src07_byte_prefix(spark, sf_dir):
    return turns.byte_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "role", "bytes_through")


@query("""WITH versions AS (SELECT doc_id % 97 AS key, doc_id % 5 AS generation, n_chars AS line_end, doc_id FROM documents)
SELECT key, generation, line_end, doc_id FROM versions QUALIFY row_number() OVER (PARTITION BY key ORDER BY generation DESC, line_end DESC, doc_id) = 1""")
def src13_monotone_ingest(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("key"), (F.col("doc_id") % 5).alias("generation"), F.col("n_chars").alias("line_end"), "doc_id")
    best = v.groupBy("key").agg(F.max(F.struct("generation", "line_end", (-F.col("doc_id")).alias("d"))).alias("m"))
    return best.select("key", "m.generation", "m.line_end", (-F.col("m.d")).alias("doc_id"))


@query("""SELECT d.doc_id, CASE WHEN d.source IN ('src1', 'src2') THEN 'excluded-project' WHEN contains(d.text, 'token =') THEN 'user-marker' WHEN l.toxic = 1 THEN 'flagged' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def src16_eligibility(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", scope.eligible([("excluded-project", F.col("source").isin("src1", "src2")), ("user-marker", F.contains("text", F.lit("token ="))), ("flagged", F.col("toxic") == 1)]).alias("reason"))


@query("""SELECT conv_id, bool_or(role = 'user' AND contains(text, '###')) AS excluded FROM conversations GROUP BY conv_id""")
def src17_exclusion_scan(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or((F.col("role") == "user") & F.contains("text", F.lit("###"))).alias("excluded"))


@query(f"WITH {EXCHANGES} SELECT id, project, timestamp FROM exchanges WHERE project = 'p3' AND timestamp >= '2024-01-02' AND timestamp <= '2024-01-05'")
def flt01_search_filters(spark, sf_dir):
    return exchanges(spark, sf_dir).where(scope.search_filters("p3", "2024-01-02", "2024-01-05")).select("id", "project", "timestamp")


@query(f"""WITH {FACTS} SELECT 'project' AS scope, id FROM facts WHERE scope_type = 'global' OR project = 'src3'
UNION ALL SELECT 'other-projects', id FROM facts WHERE scope_type <> 'global' AND project <> 'src3' UNION ALL SELECT 'global', id FROM facts WHERE scope_type = 'global'""")
def flt02_read_scope(spark, sf_dir):
    f = facts(spark, sf_dir)
    # One pass over the facts: each row names the scopes that show it.
    kinds = F.array_compact(F.array(*(F.when(scope.in_scope(k, "src3"), F.lit(k)) for k in ("project", "other-projects", "global"))))
    return f.select("id", F.explode(kinds).alias("scope")).select("scope", "id")


@query(f"WITH {FACTS} SELECT id, project, category, confirmations FROM facts WHERE is_active AND (scope_type = 'global' OR project = 'src4')")
def flt03_list_facts(spark, sf_dir):
    return facts(spark, sf_dir).where(F.col("is_active") & scope.in_scope("project", "src4")).select("id", "project", "category", "confirmations")


@query(f"WITH {FACTS} SELECT id, category FROM facts WHERE is_active AND category = 'en' AND contains(lower(fact), 'thinger')")
def flt11_fact_filters(spark, sf_dir):
    return facts(spark, sf_dir).where(F.col("is_active") & (F.col("category") == "en") & scope.contains_text(F.col("fact"), "thinger")).select("id", "category")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages) SELECT page_id FROM p WHERE path = '/ththre.example.com' OR starts_with(path, '/ththre.example.com/') OR path = '/blog.tionble.example.com/en' OR starts_with(path, '/blog.tionble.example.com/en/')""")
def flt13_path_boundary(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").where(scope.path_within(path, ["/ththre.example.com", "/blog.tionble.example.com/en"])).select("page_id")


@query("""SELECT event_id, event_type = 'click' AND ts > TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 30 MINUTE AS fresh FROM events""")
def flt14_fresh_lease(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "click", "claimed").otherwise("pending")
    return e.select("event_id", scope.fresh_lease(state, F.col("ts").cast("string"), F.lit("2024-01-02 12:00:00").cast("timestamp")).alias("fresh"))


@query(f"""WITH {EXCHANGES}, done AS (SELECT DISTINCT conv_id FROM conversations WHERE text LIKE '%la%' AND turn = 0)
SELECT session_id, count(*) AS n FROM exchanges WHERE NOT is_sidechain AND session_id NOT IN (SELECT conv_id FROM done WHERE conv_id IS NOT NULL) GROUP BY session_id HAVING count(*) >= 2""")
def flt15_pending_sessions(spark, sf_dir):
    done = table(spark, sf_dir, "conversations").where((F.col("turn") == 0) & F.col("text").like("%la%")).select(F.col("conv_id").alias("session_id"))
    return exchanges(spark, sf_dir).where("not is_sidechain").join(done, "session_id", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 1)""")
def flt16_reembed_backlog(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") % 2).alias("embedding_version"))
    return scope.backlog(table(spark, sf_dir, "documents"), v, "doc_id", 1).select("doc_id", "lang")


@query("""SELECT event_id FROM events WHERE value / 50 BETWEEN 0.7 AND 1.0""")
def flt21_confidence(spark, sf_dir):
    return table(spark, sf_dir, "events").where(scope.confident(F.col("value") / 50)).select("event_id")


@query(f"""WITH {FACTS} SELECT scope_type AS tier, count(*) AS hidden FROM facts WHERE NOT (is_active AND confirmations >= 3) GROUP BY scope_type""")
def flt25_hidden_by_tier(spark, sf_dir):
    shown = F.col("is_active") & (F.col("confirmations") >= 3)
    return facts(spark, sf_dir).where(~shown).groupBy(F.col("scope_type").alias("tier")).agg(F.count(F.lit(1)).alias("hidden"))


@query("""SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS workspace_id FROM documents""")
def flt26_tolerant_columns(spark, sf_dir):
    return scope.tolerant_select(table(spark, sf_dir, "documents"), ["doc_id", "lang", "workspace_id"])


@query(f"""WITH {EXCHANGES} SELECT session_id, md5(string_agg(id || ':' || line_end, ',' ORDER BY line_start)) AS content_hash, count(*) AS n FROM exchanges GROUP BY session_id""")
def job09_session_hash(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("line_start", F.concat("id", F.lit(":"), F.col("line_end").cast("string")).alias("x"))))
    return exchanges(spark, sf_dir).groupBy("session_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["x"]), ",")).alias("content_hash"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EXCHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY timestamp, id) AS rn, sum(length(user_message) + length(assistant_message)) OVER (PARTITION BY project ORDER BY timestamp, id) AS used FROM exchanges)
SELECT project, id, rn, CAST(used AS BIGINT) AS used FROM r WHERE rn <= 8 AND (used <= 24000 OR rn = 1)""")
def win09_character_budget(spark, sf_dir):
    w = Window.partitionBy("project").orderBy("timestamp", "id")
    e = exchanges(spark, sf_dir).withColumns({"rn": F.row_number().over(w).cast("long"), "used": F.sum(F.length("user_message") + F.length("assistant_message")).over(w)})
    return e.where("rn <= 8 and (used <= 24000 or rn = 1)").select("project", "id", "rn", "used")


@query("""SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, max(turn) - min(turn) + 1 = count(*) AS contiguous FROM conversations GROUP BY conv_id""")
def win06_contiguous(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.max("turn") - F.min("turn") + 1 == F.count(F.lit(1))).alias("contiguous"))


@query(f"""WITH {EXCHANGES} SELECT a.id, count(b.id) AS n_before, max(b.line_start) AS nearest FROM exchanges a LEFT JOIN exchanges b ON a.session_id = b.session_id AND b.line_start BETWEEN a.line_start - 30 AND a.line_start - 1 GROUP BY a.id""")
def win12_referents_before(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("line_start").rangeBetween(-30, -1)
    return exchanges(spark, sf_dir).select("id", F.count("id").over(w).alias("n_before"), F.max("line_start").over(w).alias("nearest"))
