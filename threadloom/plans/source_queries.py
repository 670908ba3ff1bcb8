"""Transcripts written from the given conversations and read back; archives, sidecars, generations, journals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators.storage import scratch
from threadloom.operators.turns import lines_between
from threadloom.plans.base import query, table
from threadloom.sources import transcripts
from threadloom.sources.transcript_source import TranscriptSource

LINES = """said AS (SELECT conv_id, turn, role, text, role = 'assistant' AND (conv_id + turn) % 4 = 1 AS is_call FROM conversations),
lines AS (SELECT DISTINCT conv_id, -1 AS turn, 0 AS k, 'meta' AS kind, NULL AS text FROM conversations UNION ALL SELECT conv_id, turn, 0, CASE WHEN role = 'user' THEN 'user' WHEN is_call THEN 'call' WHEN role = 'assistant' THEN 'reply' ELSE 'note' END, CASE WHEN NOT is_call THEN text END FROM said
    UNION ALL SELECT conv_id, turn, 1, 'output', NULL FROM said WHERE is_call AND (conv_id + turn) % 3 <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS line_no FROM lines)"""


def rollouts(spark, sf_dir):
    """Lines of transcripts, many sessions a file, read through the source: some replies are tool calls, some calls never
    get an output."""
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") + F.col("turn")
    line = lambda payload, kind="response_item": F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    call = (F.col("role") == "assistant") & (k % 4 == 1)
    name = F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id")
    own = F.when(call, line(F.struct(F.lit("function_call").alias("type"), F.lit("run").alias("name"), name, F.lit("{}").alias("arguments")))).otherwise(line(F.struct(F.lit("message").alias("type"), "role", F.col("text").alias("content"))))
    output = F.when(call & (k % 3 != 0), line(F.struct(F.lit("function_call_output").alias("type"), name, F.lit("ok").alias("output"))))
    session = F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id")
    head = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("at"), line(F.struct(session, F.concat(F.lit("/p"), (F.col("conv_id") % 7).cast("string")).alias("cwd"), F.when(F.col("conv_id") % 11 == 0, "subagent").alias("source")), "session_meta").alias("value"))
    body = c.select("conv_id", "turn", F.posexplode(F.array_compact(F.array(own, output))).alias("at", "value"))
    path = scratch(spark, "rollouts")
    # A session's lines stand together in one file, its header first; a file holds the sessions of one task.
    head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "at").select("value").write.text(path)
    spark.dataSource.register(TranscriptSource)
    return transcripts.sections(spark.read.format("transcripts").option("path", path).option("pattern", "part-*").load())


@query(f"WITH {LINES} SELECT 'conv-' || conv_id AS session_id, '/p' || (conv_id % 7) AS cwd, conv_id % 11 = 0 AS is_subthread, count(*) AS n_lines FROM numbered GROUP BY ALL")
def src01_discovery(spark, sf_dir):
    lines = rollouts(spark, sf_dir)
    sizes = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))
    return transcripts.headers(transcripts.parse(lines)).join(sizes, "path").select("session_id", "cwd", "is_subthread", "n_lines")


@query(f"""WITH {LINES}, t AS (SELECT *, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line_no) AS t FROM numbered WHERE kind NOT IN ('meta', 'note')),
g AS (SELECT conv_id, t, min(line_no) AS line_start, max(line_no) AS line_end, max(CASE WHEN kind = 'user' THEN text END) AS u, coalesce(string_agg(CASE WHEN kind = 'reply' THEN text END, chr(10) || chr(10) ORDER BY line_no), '') AS a,
    count(CASE WHEN kind = 'reply' THEN 1 END) AS n_replies, count(CASE WHEN kind = 'call' THEN 1 END) AS n_tools, count(CASE WHEN kind = 'call' THEN 1 END) - count(CASE WHEN kind = 'output' THEN 1 END) AS n_open FROM t WHERE t > 0 GROUP BY 1, 2),
k AS (SELECT *, max(t) OVER (PARTITION BY conv_id) AS last_t FROM g)
SELECT md5('mx:conv-' || conv_id || ':u' || line_start) AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t) AS INTEGER) AS seq, line_start, line_end, md5(CASE WHEN u = '' THEN '(tool calls only)' ELSE u END || chr(10) || a) AS said, CASE WHEN t = last_t AND n_open > 0 THEN 'interrupted' ELSE 'closed' END AS closure_state, n_tools, n_open
FROM k WHERE n_replies + n_tools > 0 AND conv_id % 11 <> 0 AND conv_id % 4 <> 0""")
def src14_index_unprocessed(spark, sf_dir):
    # Discover, leave out sub-threads and what is indexed already, assemble the turns.
    records = transcripts.parse(rollouts(spark, sf_dir))
    heads = transcripts.headers(records).where("not is_subthread")
    done = table(spark, sf_dir, "conversations").where("conv_id % 4 = 0").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id")).distinct()
    wanted = transcripts.unprocessed(heads, done, "session_id").select("path")
    x = transcripts.exchanges(records.join(wanted, "path", "left_semi"))
    return x.select("id", "seq", "line_start", "line_end", F.md5(F.concat_ws("\n", "user_message", "assistant_message")).alias("said"), "closure_state", "n_tools", "n_open")


@query("""WITH f AS (SELECT user_id, ts, event_id % 2 = 1 AS compressed, 'a' || event_id || CASE WHEN event_id % 2 = 1 THEN '.jsonl.zst' ELSE '.jsonl' END AS path, event_type <> 'error' AS readable FROM events)
SELECT user_id, path, compressed FROM f WHERE readable QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, compressed, path DESC) = 1""")
def src08_newest_archive(spark, sf_dir):
    k = F.col("event_id")
    path = F.concat(F.lit("a"), k.cast("string"), F.when(k % 2 == 1, ".jsonl.zst").otherwise(".jsonl"))
    return transcripts.newest_readable(table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("modified"), path.alias("path"), (F.col("event_type") != "error").alias("readable")), "user_id")


@query("""SELECT o_orderkey, coalesce(s.at < o_orderdate, true) AS refresh FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) - INTERVAL 60 DAY AS at FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) s ON l_orderkey = o_orderkey""")
def src11_sidecar_freshness(spark, sf_dir):
    summaries = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_shipdate") - F.expr("INTERVAL 60 DAY")).alias("modified"))
    return transcripts.stale_sidecars(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified")), summaries, "o_orderkey")


@query("""WITH g AS (SELECT l_suppkey AS device, l_orderkey % 200 AS generation, l_linenumber % 4 AS part, count(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT s_suppkey AS device, s_suppkey * 7 % 200 AS generation FROM supplier)
SELECT device, generation, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM g JOIN p USING (device, generation) GROUP BY 1, 2 HAVING count(*) = 4""")
def src24_committed_generations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = li.groupBy(F.col("l_suppkey").alias("device"), (F.col("l_orderkey") % 200).alias("generation"), (F.col("l_linenumber") % 4).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    return transcripts.committed(parts, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device"), (F.col("s_suppkey") * 7 % 200).alias("generation")), 4)


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT *, n // 25 AS file_id, n * 100 - CASE WHEN event_id % 13 = 0 THEN 250 WHEN event_id % 7 = 0 THEN 100 ELSE 0 END AS size FROM n), h AS (SELECT *, size - size % 64 AS complete, md5(user_id || ':' || CASE WHEN event_id % 7 = 0 THEN event_id ELSE n END) AS whole FROM s),
b AS (SELECT *, lag(size) OVER w AS b_size, lag(file_id) OVER w AS b_file, lag(whole) OVER w AS b_whole, lag(complete) OVER w AS b_complete FROM h WINDOW w AS (PARTITION BY user_id ORDER BY n)),
r AS (SELECT *, CASE WHEN b_size IS NULL THEN 'first' WHEN b_file <> file_id THEN 'replaced' WHEN size < b_size THEN 'rewound' WHEN size = b_size AND b_whole <> whole THEN 'rewritten' WHEN event_id % 29 = 0 THEN 'damaged' ELSE 'grown' END AS reason FROM b)
SELECT user_id, n, sum(CASE WHEN reason <> 'grown' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n)::BIGINT AS epoch, CASE WHEN reason = 'grown' THEN b_complete ELSE 0 END AS from_byte, complete AS to_byte, reason FROM r""")
def src26_journal_capture(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    w = Window.partitionBy("user_id").orderBy("n")
    looks = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    looks = looks.withColumns({"file_id": F.floor(F.col("n") / 25), "size": F.col("n") * 100 - F.when(k % 13 == 0, 250).when(k % 7 == 0, 100).otherwise(0), "whole": F.md5(F.concat(u, F.lit(":"), F.when(k % 7 == 0, k).otherwise(F.col("n")).cast("string")))})
    looks = looks.withColumns({"complete": F.col("size") - F.col("size") % 64, "head": F.when(k % 29 == 0, "x").otherwise(F.lag("whole").over(w))})
    return transcripts.captured(looks, "user_id", "n")


@query(f"WITH {LINES} SELECT 'conv-' || conv_id AS session_id, line_no, CASE kind WHEN 'user' THEN 'message:user' WHEN 'reply' THEN 'message:assistant' WHEN 'note' THEN 'message:system' WHEN 'call' THEN 'function_call' ELSE 'function_call_output' END AS kind, md5(text) AS text FROM numbered WHERE line_no BETWEEN 2 AND 9")
def src09_read_slice(spark, sf_dir):
    # An inclusive slice of lines of every transcript, streamed from the files.
    lines = rollouts(spark, sf_dir)
    heads = transcripts.headers(transcripts.parse(lines)).select("path", "session_id")
    shown = transcripts.parse(lines_between(lines, "line_no", 2, 9))
    kind = F.concat_ws(":", F.col("p.type"), F.col("p.role"))
    return shown.join(heads, "path").select("session_id", "line_no", kind.alias("kind"), F.md5(transcripts.message_text(F.col("p.content"))).alias("text"))
