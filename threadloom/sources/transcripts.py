"""JSONL transcripts: discovery, headers, eligibility, turns; and replica generations as a sink and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: Only these two record types matter; content is a string or a list of typed parts, so it stays JSON.
SCHEMA = "type string, timestamp string, payload struct<type string, id string, session_id string, cwd string, source string, thread_source string, parent_thread_id string, role string, content string, name string, call_id string, input string, arguments string, output string, result string, is_error boolean>"


def read_lines(spark: SparkSession, root: str, pattern: str = "rollout-*.jsonl") -> DataFrame:
    """(path, line_no, line) of every transcript below ``root``; compressed files are read by their extension.

    Lines are numbered file by file, so a transcript, which one session writes, is numbered in one task.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    own = raw.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") * F.lit(1 << 20)).alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    n = F.row_number().over(Window.partitionBy("path").orderBy("block", "id"))
    return own.select("path", n.cast("long").alias("line_no"), "line")


def sections(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) of lines (path, epoch, at, line) as the source ``transcripts`` gives them: a header begins a
    section of its file, which stands for a transcript of its own (``file#n``). A file's last epoch counts."""
    last = F.col("epoch") == F.max("epoch").over(Window.partitionBy("path"))
    own = lines.withColumn("_last", last).where("_last") if "epoch" in lines.columns else lines
    head = (F.get_json_object("line", "$.type") == "session_meta").cast("int")
    cut = own.withColumn("section", F.sum(F.coalesce(head, F.lit(0))).over(Window.partitionBy("path").orderBy("at")))
    n = F.row_number().over(Window.partitionBy("path", "section").orderBy("at"))
    return cut.select(F.concat_ws("#", "path", F.col("section").cast("string")).alias("path"), n.cast("long").alias("line_no"), "line")


def session_of_path(path) -> Column:
    """The last UUID in the base name."""
    return F.element_at(F.regexp_extract_all(F.lower(F.element_at(F.split(path, "/"), -1)), F.lit(f"({_UUID})"), F.lit(1)), -1)


def parse(lines: DataFrame) -> DataFrame:
    """Records of known types; malformed lines are skipped, a missing clock takes the last one seen."""
    r = lines.withColumn("r", F.from_json("line", SCHEMA)).where(F.col("r.type").isin("session_meta", "response_item"))
    clock = F.last(F.col("r.timestamp"), ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no"))
    return r.select("path", "line_no", F.col("r.type").alias("type"), clock.alias("timestamp"), F.col("r.payload").alias("p"))


def headers(records: DataFrame) -> DataFrame:
    """(path, session_id, cwd, is_subthread) from each file's first header."""
    first = records.where("type = 'session_meta'").groupBy("path").agg(F.min_by("p", "line_no").alias("p"))
    sub = (F.coalesce("p.parent_thread_id", F.lit("")) != "") | F.coalesce(F.concat_ws(" ", "p.source", "p.thread_source"), F.lit("")).rlike("(?i)sub-?agent")
    return first.select("path", F.coalesce("p.id", "p.session_id", session_of_path(F.col("path"))).alias("session_id"), F.col("p.cwd").alias("cwd"), sub.alias("is_subthread"))


def message_text(content) -> Column:
    """A string, or the texts of a list of parts."""
    parts = F.from_json(content, "array<struct<type string, text string>>")
    return F.when(content.startswith("["), F.coalesce(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), content)).otherwise(content)


def exchanges(records: DataFrame) -> DataFrame:
    """(path, seq, id, timestamp, user_message, assistant_message, line_start, line_end, closure_state, n_tools, n_open)
    of each file's turns.

    A user message that is no internal context opens a turn; assistant messages, tool calls and the outputs of its own
    calls extend it. A turn without any of them is dropped; one with calls and no text stands for itself. A file's last
    turn is interrupted if a call never got its output. Ids hang on session and line, so they are the same anywhere.
    """
    p, at = F.col("p"), F.col("line_no")
    said = message_text(F.col("p.content"))
    internal = F.coalesce(said.startswith("<environment_context>") | said.startswith("<user_instructions>"), F.lit(False))
    kind = (
        F.when((p["type"] == "message") & (p["role"] == "user"), F.when(~internal, "user")).when((p["type"] == "message") & (p["role"] == "assistant"), "reply")
        .when(p["type"].isin("function_call", "custom_tool_call"), "call").when(p["type"].isin("function_call_output", "custom_tool_call_output"), "output")
    )
    w = Window.partitionBy("path").orderBy("line_no")
    own = records.where("type = 'response_item'").select("path", "line_no", "timestamp", "p", kind.alias("kind"), said.alias("text")).where("kind is not null")
    own = own.withColumn("turn", F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).over(w)).where("turn > 0")
    is_ = lambda k: F.col("kind") == k
    call_id = F.coalesce(F.col("p.call_id"), F.col("p.id"), F.concat(F.lit("#"), at.cast("string")))
    per_call = own.where(is_("call") | is_("output")).groupBy("path", "turn", call_id.alias("call_id")).agg(F.count_if(is_("call")).alias("n"), F.min(F.when(is_("call"), at)).alias("first"), F.max(F.when(is_("call"), at)).alias("last"), F.max(F.when(is_("output"), at)).alias("out"))
    answered = F.coalesce(F.col("out") > F.col("first"), F.lit(False))
    tools = per_call.where("n > 0").groupBy("path", "turn").agg(F.sum("n").alias("n_tools"), F.sum(F.col("n") - answered.cast("int")).alias("n_open"), F.max(F.greatest("last", F.when(answered, F.col("out")))).alias("tool_end"))
    texts = own.where(is_("user") | is_("reply")).groupBy("path", "turn").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("text_end"), F.max(F.when(is_("user"), F.col("text"))).alias("user_message"), F.max(F.when(is_("user"), F.col("timestamp"))).alias("timestamp"),
        F.array_sort(F.collect_list(F.when(is_("reply"), F.struct(at.alias("l"), F.col("text").alias("t"))))).alias("replies"),
    )
    last = own.groupBy("path").agg(F.max("turn").alias("last_turn"))
    whole = texts.join(tools, ["path", "turn"], "left").join(last, "path").fillna(0, ["n_tools", "n_open"]).where((F.size("replies") > 0) | (F.col("n_tools") > 0))
    whole = whole.join(headers(records).select("path", "session_id"), "path", "left")
    message = F.when(F.coalesce("user_message", F.lit("")) == "", "(tool calls only)").otherwise(F.col("user_message"))
    line = F.col("line_start").cast("string")
    name = F.when(F.coalesce("session_id", F.lit("")) != "", F.concat(F.lit("mx:"), "session_id", F.lit(":u"), line)).otherwise(F.concat(F.lit("mx:u"), line, F.lit(":"), F.coalesce("user_message", F.lit(""))))
    closure = F.when((F.col("turn") == F.col("last_turn")) & (F.col("n_open") > 0), "interrupted").otherwise("closed")
    seq = F.row_number().over(Window.partitionBy("path").orderBy("turn"))
    return whole.select(
        "path", seq.alias("seq"), F.md5(name).alias("id"), "timestamp", message.alias("user_message"), F.array_join(F.transform("replies", lambda r: r["t"]), "\n\n").alias("assistant_message"),
        "line_start", F.greatest("text_end", "tool_end").alias("line_end"), closure.alias("closure_state"), "n_tools", "n_open",
    )


def newest_readable(files: DataFrame, key: str) -> DataFrame:
    """(key, path, compressed) of the newest readable archive of each transcript among files (key, path, modified,
    readable); of equally new ones the plain file."""
    zipped = F.col("path").endswith(".zst")
    best = F.max(F.struct("modified", (~zipped).alias("plain"), "path"))
    return files.where("readable").groupBy(key).agg(best.alias("b")).select(key, "b.path", (~F.col("b.plain")).alias("compressed"))


def stale_sidecars(archives: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """(key, refresh): archives (key, modified) whose summary (key, modified) is missing or older than they are."""
    s = summaries.select(key, F.col("modified").alias("_summary"))
    return archives.join(s, key, "left").select(key, F.coalesce(F.col("_summary") < F.col("modified"), F.lit(True)).alias("refresh"))


def unprocessed(found: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """What was discovered and has not been indexed yet."""
    return found.join(processed.select(key), key, "left_anti")


def committed(generations: DataFrame, pointers: DataFrame, parts: int) -> DataFrame:
    """(device, generation, n_rows): the generation that each device's pointer names, if all its parts are there.

    ``generations`` has a row for each part (device, generation, part, n_rows); other generations do not count.
    """
    whole = generations.join(pointers, ["device", "generation"], "left_semi").groupBy("device", "generation")
    return whole.agg(F.count_distinct("part").alias("_parts"), F.sum("n_rows").alias("n_rows")).where(F.col("_parts") == parts).drop("_parts")


def captured(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, epoch, from_byte, to_byte, reason): what each look at a growing journal adds.

    ``snapshots`` has key, order, file_id, size, complete (bytes up to the last line end), head (hash of the bytes that
    the last look had taken, as they are now), whole (hash of the bytes up to ``complete``). A file that was replaced,
    got shorter, was rewritten at the same size, or no longer begins as it did starts a new epoch from its first byte.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    reason = (
        F.when(before("size").isNull(), "first").when(before("file_id") != F.col("file_id"), "replaced").when(F.col("size") < before("size"), "rewound")
        .when((F.col("size") == before("size")) & (before("whole") != F.col("whole")), "rewritten").when(before("whole") != F.col("head"), "damaged").otherwise("grown")
    )
    steps = snapshots.withColumns({"reason": reason, "_taken": before("complete")})
    epoch = F.sum(F.when(F.col("reason") != "grown", 1).otherwise(0)).over(w)
    return steps.select(key, order, epoch.alias("epoch"), F.when(F.col("reason") == "grown", F.col("_taken")).otherwise(0).alias("from_byte"), F.col("complete").alias("to_byte"), "reason")


def write_generation(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines and return their manifest (file, n_rows, sha256 of the sorted lines' hashes)."""
    from threadloom.operators.history import manifest

    df.write.json(path)
    lines = df.sparkSession.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("line"))
    return manifest(lines, "file", "line")


def read_generation(spark: SparkSession, path: str, expected: DataFrame, schema) -> DataFrame:
    """The rows, if every file is as its manifest says; otherwise none: a generation counts whole or not at all."""
    from threadloom.operators.history import manifest

    lines = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("line"))
    found = manifest(lines, "file", "line")
    told = expected.select("file", F.col("n_rows").alias("_rows"), F.col("sha256").alias("_sha256"))
    both = found.join(told, "file", "full")
    wrong = both.where(~(F.col("n_rows").eqNullSafe(F.col("_rows")) & F.col("sha256").eqNullSafe(F.col("_sha256"))))
    rows = spark.read.schema(schema).json(path)
    return rows if wrong.isEmpty() else rows.limit(0)
