"""Bitemporal history, incidents, replica merge, audits and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import history, scope
from threadloom.plans.base import FACTS, facts, query, table
from threadloom.streaming import windows

_EVENTS = "ev AS (SELECT event_id AS seq, user_id AS fact_id, event_type AS kind, ts AS effective_at, ts + to_minutes(CAST(event_id % 90 AS BIGINT)) AS recorded_at, value, (['decision', 'human', 'tool', 'unknown'])[CAST(event_id % 4 + 1 AS INTEGER)] AS authority FROM events)"


def chronicle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("decision", "human", "tool", "unknown")))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("fact_id"), F.col("event_type").alias("kind"), F.col("ts").alias("effective_at"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("recorded_at"), "value", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("authority"))


@query(f"WITH {_EVENTS} SELECT seq, fact_id, kind, effective_at, recorded_at FROM ev WHERE kind IN ('click', 'error') AND fact_id < 40 AND (effective_at, recorded_at, seq) > (TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-02 00:00:00', 0) ORDER BY effective_at, recorded_at, seq LIMIT 51")
def chr01_timeline_page(spark, sf_dir):
    start = F.lit("2024-01-02 00:00:00").cast("timestamp")
    after = F.struct("effective_at", "recorded_at", "seq") > F.struct(start.alias("effective_at"), start.alias("recorded_at"), F.lit(0).cast("long").alias("seq"))
    page = chronicle(spark, sf_dir).where(F.col("kind").isin("click", "error") & (F.col("fact_id") < 40) & after)
    return page.orderBy("effective_at", "recorded_at", "seq").limit(51).select("seq", "fact_id", "kind", "effective_at", "recorded_at")


@query(f"WITH {_EVENTS}, p AS (SELECT *, lag(authority) OVER w AS pa, lag(recorded_at) OVER w AS pr, CASE authority WHEN 'decision' THEN 3 WHEN 'human' THEN 2 WHEN 'tool' THEN 2 ELSE 1 END AS r, CASE lag(authority) OVER w WHEN 'decision' THEN 3 WHEN 'human' THEN 2 WHEN 'tool' THEN 2 ELSE 1 END AS q FROM ev WINDOW w AS (PARTITION BY fact_id ORDER BY effective_at, seq)) SELECT seq, CASE WHEN pa IS NULL THEN 'apply' WHEN recorded_at > pr AND r >= q THEN 'apply' WHEN recorded_at > pr THEN 'contradicted' WHEN recorded_at < pr THEN 'historical' ELSE 'contradicted' END AS verdict FROM p")
def chr05_competing_evidence(spark, sf_dir):
    w = Window.partitionBy("fact_id").orderBy("effective_at", "seq")
    p = chronicle(spark, sf_dir).withColumns({"pa": F.lag("authority").over(w), "pr": F.lag("recorded_at").over(w)})
    v = history.verdict(F.col("pa").isNotNull(), F.col("recorded_at") > F.col("pr"), F.col("recorded_at") < F.col("pr"), history.authority_rank(F.col("authority")), history.authority_rank(F.col("pa")))
    return p.select("seq", v.alias("verdict"))


@query(f"WITH {_EVENTS} SELECT fact_id, seq, kind, effective_at FROM ev WHERE kind <> 'view' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY effective_at DESC, recorded_at DESC, seq DESC) = 1")
def win04_current_revision(spark, sf_dir):
    return history.latest(chronicle(spark, sf_dir).where("kind <> 'view'"), "fact_id", ["effective_at", "recorded_at", "seq"], ["seq", "kind", "effective_at"])


@query("""SELECT c.conv_id, c.turn, d.doc_id FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE contains(d.text, substr(c.text, 1, 3))""")
def chr04_grounding(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("text", "span")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return c.join(d, c["conv_id"] == d["doc_id"]).where(F.contains("text", F.substring("span", 1, 3))).select("conv_id", "turn", "doc_id")


@query(f"WITH {_EVENTS} SELECT md5('[' || fact_id || ',' || kind || ',' || seq % 50 || ']') AS event_key, count(*) AS copies, count(DISTINCT kind || ':' || CAST(value > 10 AS INTEGER)) > 1 AS conflict FROM ev GROUP BY 1")
def chr02_event_identity(spark, sf_dir):
    e = chronicle(spark, sf_dir)
    key = F.md5(F.concat(F.lit("["), F.col("fact_id").cast("string"), F.lit(","), "kind", F.lit(","), (F.col("seq") % 50).cast("string"), F.lit("]")))
    return e.groupBy(key.alias("event_key")).agg(F.count(F.lit(1)).alias("copies"), (F.count_distinct(F.concat("kind", F.lit(":"), (F.col("value") > 10).cast("int").cast("string"))) > 1).alias("conflict"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events WHERE event_type = 'error'),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS episode FROM e)
SELECT user_id, event_type, CAST(episode AS BIGINT) AS episode, min(ts) AS started, max(ts) AS ended, count(*) AS retries FROM n GROUP BY 1, 2, 3""")
def inc02_episodes(spark, sf_dir):
    return history.episodes(table(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id", "event_type"], "ts")


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events), n AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS episode FROM e)
SELECT event_type, CAST(sum(episodes) AS BIGINT) AS episodes, count(CASE WHEN episodes >= 2 THEN 1 END) AS patterns, max(last_at) AS last_at FROM (SELECT user_id, event_type, max(episode) AS episodes, max(ts) AS last_at FROM n GROUP BY 1, 2) GROUP BY event_type""")
def inc03_patterns(spark, sf_dir):
    e = history.episodes(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")
    per = e.groupBy("user_id", "event_type").agg(F.max("episode").alias("episodes"), F.max("ended").alias("last_at"))
    return per.groupBy("event_type").agg(F.sum("episodes").alias("episodes"), F.count_if(F.col("episodes") >= 2).alias("patterns"), F.max("last_at").alias("last_at"))


_RAW = "event_type || ' at ' || CAST(ts AS VARCHAR) || ' in /srv/app/' || user_id || '/x.py: 0x' || to_hex(event_id) || ' took ' || (event_id % 7) || '.5s, ref ' || md5(CAST(event_id AS VARCHAR)) || chr(10) || props"
_SIGNATURE = f"lower(regexp_replace({_RAW}, '{history.ANSI}', '', 'g'))"
for _pattern, _name in history.SIGNATURE:
    _SIGNATURE = f"regexp_replace({_SIGNATURE}, '{_pattern}', '{_name}', 'g')"


@query(f"""WITH s AS (SELECT event_id, substr(trim(regexp_replace({_SIGNATURE}, '{history.WHITE}+', ' ', 'g')), 1, 240) AS signature FROM events)
SELECT signature, substr(sha256(signature), 1, 24) AS signature_key, count(*) AS n FROM s GROUP BY 1, 2""")
def inc01_signatures(spark, sf_dir):
    k = F.col("event_id")
    parts = ("event_type", F.lit(" at "), F.col("ts").cast("string"), F.lit(" in /srv/app/"), F.col("user_id").cast("string"), F.lit("/x.py: 0x"), F.hex(k), F.lit(" took "), (k % 7).cast("string"), F.lit(".5s, ref "), F.md5(k.cast("string")), F.lit("\n"), "props")
    text = F.concat(*parts)
    return table(spark, sf_dir, "events").groupBy(history.signature(text).alias("signature"), history.signature_key(text).alias("signature_key")).agg(F.count(F.lit(1)).alias("n"))


_REPLICAS = f"""{FACTS}, reps AS (SELECT id % 200 AS id, fact, n_chars AS meaning_clock, age_days AS active_clock, is_active, [project] AS sources, confirmations FROM facts)"""


def replicas(spark, sf_dir):
    return facts(spark, sf_dir).select((F.col("id") % 200).alias("id"), "fact", F.col("n_chars").alias("meaning_clock"), F.col("age_days").alias("active_clock"), "is_active", F.array("project").alias("sources"), "confirmations")


@query(f"""WITH {_REPLICAS}, m AS (SELECT id, fact, meaning_clock FROM reps QUALIFY row_number() OVER (PARTITION BY id ORDER BY meaning_clock DESC, fact DESC) = 1), a AS (SELECT id, is_active FROM reps QUALIFY row_number() OVER (PARTITION BY id ORDER BY active_clock DESC, is_active) = 1),
s AS (SELECT id, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS sources, max(confirmations) AS confirmations FROM reps GROUP BY id) SELECT id, md5(fact) AS fact_md5, meaning_clock, is_active, sources, confirmations FROM m JOIN a USING (id) JOIN s USING (id)""")
def mrg01_three_axis_merge(spark, sf_dir):
    m = history.merge_facts(replicas(spark, sf_dir))
    return m.select("id", F.md5("fact").alias("fact_md5"), "meaning_clock", "is_active", F.array_join("sources", ",").alias("sources"), "confirmations")


@query(f"""WITH {_REPLICAS} SELECT id, count(DISTINCT fact) AS versions FROM reps GROUP BY id HAVING count(DISTINCT fact) > 1""")
def mrg04_conflict_report(spark, sf_dir):
    return replicas(spark, sf_dir).groupBy("id").agg(F.count_distinct("fact").alias("versions")).where("versions > 1")


@query("""SELECT user_id AS id, max(ts) AS deleted_at, CASE WHEN bool_or(event_type = 'error' AND event_id % 40 = 0) THEN 'privacy' ELSE arg_max(event_type, (ts, event_type)) END AS reason FROM events GROUP BY user_id""")
def mrg03_tombstones(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("deleted_at"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), "privacy").otherwise(F.col("event_type")).alias("reason"))
    return history.merge_tombstones(t)


@query("""WITH g AS (SELECT l_orderkey AS generation, bool_and(l_quantity > 0 AND l_discount <= 0.1 AND l_tax <= 0.0799) AS valid, count(*) AS n_rows FROM lineitem GROUP BY 1) SELECT generation, n_rows FROM g WHERE valid""")
def mrg08_strict_generations(spark, sf_dir):
    # An order is a generation, its lines the rows; one bad row refuses them all.
    sound = (F.col("l_quantity") > 0) & (F.col("l_discount") <= 0.1) & (F.col("l_tax") <= 0.0799)
    return history.strict(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "generation"), "generation", sound)


@query("""WITH r AS (SELECT source, substr(md5(text), 1, 3) AS range, count(*) AS n, sha256(string_agg(md5(text), '' ORDER BY md5(text))) AS r FROM documents GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(r, '' ORDER BY range)) AS sha256 FROM r GROUP BY source""")
def src21_export_manifest(spark, sf_dir):
    return history.manifest(table(spark, sf_dir, "documents"), "source", "text")


@query("""SELECT sha256(concat_ws('|', (SELECT count(*) FROM documents), (SELECT max(doc_id) FROM documents), (SELECT count(*) FROM labels), (SELECT max(doc_id) FROM labels))) AS gate""")
def src22_change_gate(spark, sf_dir):
    both = [table(spark, sf_dir, t).agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.max("doc_id").cast("string")).alias(t)) for t in ("documents", "labels")]
    return both[0].join(both[1], how="inner").select(F.sha2(F.concat_ws("|", "documents", "labels"), 256).alias("gate"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def str_tumbling_window(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""WITH s AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM s GROUP BY 1, 2""")
def str_sliding_window(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), n AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, s""")
def str_session_window(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 14 DAY GROUP BY 1, 2""")
def str08_ttl_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") > F.lit("2023-12-22 00:00:00").cast("timestamp"))
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""SELECT conv_id, turn, CAST(i AS INTEGER) AS part, substr(text, CAST(i * 300 + 1 AS BIGINT), 300) AS piece FROM (SELECT conv_id, turn, text, unnest(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil(length(text) / 300.0) AS BIGINT) END)) AS i FROM conversations WHERE length(text) > 800)
UNION ALL SELECT conv_id, turn, 0, text FROM conversations WHERE length(text) <= 800""")
def str03_evidence_parts(spark, sf_dir):
    n = F.length("text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), F.when(n <= 800, 0).otherwise(F.ceil(n / 300) - 1).cast("int"))).alias("part"))
    return c.select("conv_id", "turn", "part", F.when(n <= 800, F.col("text")).otherwise(F.substring("text", F.col("part") * 300 + 1, F.lit(300))).alias("piece"))


@query("""SELECT doc_id FROM documents WHERE (lang, doc_id) > ('en', 500) ORDER BY lang, doc_id LIMIT 26""")
def top04_keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(scope.keyset_after(["lang", "doc_id"], ["en", 500])).orderBy("lang", "doc_id").limit(26).select("doc_id")
