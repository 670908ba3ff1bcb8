"""Session state over a stream, generations published and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators.storage import scratch
from threadloom.plans.base import query, table
from threadloom.sources.generations import GenerationSource
from threadloom.streaming import session_state

TTL_DAYS = 9


def actions(events):
    """Events as a session's actions: sign-ups compact or clear its context, purchases bring facts in, errors are
    evidence, views read what is alive."""
    kind, v = F.col("event_type"), F.floor("value")
    reset = kind == "signup"
    action = F.when(reset, F.when(v % 3 == 0, "clear").otherwise("compact")).when(kind == "purchase", "resident").when(kind == "error", "evidence").when(kind == "view", "read").otherwise("other")
    return events.select(
        F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), action.alias("action"), F.when(reset, v).alias("marker"), F.when(reset, v % 7).alias("token"),
        F.when(kind.isin("purchase", "error"), v).alias("item"), (F.col("event_id") % 5).alias("generation"),
    )


LOG = f"""a AS (SELECT CAST(user_id AS VARCHAR) AS session, epoch_us(ts) AS at_us, event_id AS seq, CAST(floor(value) AS BIGINT) AS v, event_id % 5 AS generation,
    CASE event_type WHEN 'signup' THEN 'reset' WHEN 'purchase' THEN 'resident' WHEN 'error' THEN 'evidence' WHEN 'view' THEN 'read' ELSE 'other' END AS action FROM events),
f AS (SELECT *, action = 'reset' AND row_number() OVER (PARTITION BY session, action, v ORDER BY at_us, seq) = 1 AS first FROM a),
t AS (SELECT *, first AND coalesce(v % 7 <> last_value(CASE WHEN first THEN v % 7 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY at_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM f),
e AS (SELECT *, CAST(sum(CAST(new AS BIGINT)) OVER (PARTITION BY session ORDER BY at_us, seq) AS BIGINT) AS epoch FROM t),
h AS (SELECT *, max(CASE WHEN action = 'resident' THEN generation END) OVER (PARTITION BY session, epoch, action, v ORDER BY at_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
    sum(CASE WHEN action = 'evidence' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY at_us, seq) AS total,
    sum(CASE WHEN action = 'evidence' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY at_us RANGE BETWEEN UNBOUNDED PRECEDING AND {TTL_DAYS * session_state.DAY_US} PRECEDING) AS dead FROM e),
r AS (SELECT *, total - coalesce(max(CASE WHEN action = 'read' THEN total END) OVER (PARTITION BY session, epoch ORDER BY at_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM h),
log AS (SELECT session, at_us, seq, CASE WHEN action = 'reset' THEN CASE WHEN new THEN 'epoch' ELSE 'repeat' END WHEN action = 'resident' THEN CASE WHEN held >= generation THEN 'held' ELSE 'resident' END ELSE action END AS what,
    CASE WHEN action IN ('resident', 'evidence') THEN CAST(v AS VARCHAR) END AS item, epoch, CAST(CASE action WHEN 'resident' THEN generation WHEN 'read' THEN least(since, total - coalesce(dead, 0)) ELSE 0 END AS BIGINT) AS n FROM r WHERE action <> 'other')"""


@query(f"""WITH {LOG} SELECT session, make_timestamp(at_us) AS at, seq, what, item, epoch, n FROM log UNION ALL SELECT session, make_timestamp(at_us + {TTL_DAYS * session_state.DAY_US}), seq, 'expired', item, epoch, n FROM log
    WHERE what = 'evidence' AND (at_us + {TTL_DAYS * session_state.DAY_US}) // 1000 <= ((SELECT max(at_us) FROM log_end) - 600000000) // 1000""".replace("log_end", "a"))
def str06_session_stream(spark, sf_dir):
    """Run as a stream over the table's files, up to their end, with its state in a checkpoint."""
    given = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(given.schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern: a table may be one file
    log = session_state.drain(session_state.session_log(actions(stream), TTL_DAYS), scratch(spark, "session-log"), scratch(spark, "session-state"))
    return log.select("session", F.col("at").cast("timestamp_ntz").alias("at"), "seq", "what", "item", "epoch", "n")


@query(f"""WITH {LOG}, now AS (SELECT session, max(epoch) AS epoch FROM log GROUP BY 1) SELECT session, item, epoch, max(n) AS generation FROM log JOIN now USING (session, epoch) WHERE what = 'resident' GROUP BY 1, 2, 3""")
def str07_session_residents(spark, sf_dir):
    return session_state.residents(session_state.session_log(actions(table(spark, sf_dir, "events")), TTL_DAYS)).select("session", "item", "epoch", "generation")


@query("""SELECT doc_id, md5(text) AS said, lang, coalesce(quality, 0) AS quality, 'laptop' AS _device FROM documents LEFT JOIN labels USING (doc_id)""")
def src21_published_generation(spark, sf_dir):
    """Two generations of one device; the second one is what its pointer names."""
    spark.dataSource.register(GenerationSource)
    root = scratch(spark, "generations")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("said"), "lang")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(0)))
    for generation in (rows.where("quality = 1"), rows):
        generation.write.format("generations").option("path", root).option("device", "laptop").mode("append").save()
    return spark.read.format("generations").option("path", root).load().drop("_generation")
