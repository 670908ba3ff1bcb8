"""What a session carries on: resident facts, living evidence, the tail of its turns, the rendered bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import let
from threadloom.operators.gate import MOST_TOKENS, sentence_cut, token_estimate, wrapped

TTL_DAYS = 14
TAIL_TURNS = 8
LINE_CHARS, TARGET_CHARS, HARD_CHARS = 160, 700, 1_000
SPACE = "[ \\t\\n\\f\\r]+"
HEAD_CHARS = 1_000  # of a text, which a line is made of; over any ``chars``


def resident_corrections(resident: DataFrame, facts: DataFrame) -> DataFrame:
    """(session_id, fact_id, correction) of residents that are gone, stale by generation, or revoked in scope."""
    now = facts.select("fact_id", F.col("generation").alias("now_generation"), F.col("scope").alias("now_scope"))
    gone = F.col("now_generation").isNull()
    kind = F.when(gone, "gone").when(F.col("now_scope") != F.col("scope"), "revoked").when(F.col("now_generation") > F.col("generation"), "stale")
    return resident.join(now, "fact_id", "left").select("session_id", "fact_id", kind.alias("correction")).where("correction is not null")


def live_evidence(evidence: DataFrame, keys: list[str], at: str, asof: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """(keys, first_at, expires_at) of evidence that is alive at ``asof``; repeats do not renew it."""
    first = evidence.groupBy(*keys).agg(F.min(at).alias("first_at"))
    return first.withColumn("expires_at", F.col("first_at") + F.expr(f"INTERVAL {ttl_days} DAYS")).where((F.col("first_at") <= asof) & (F.col("expires_at") > asof))


def clip_line(text: Column, chars: int = LINE_CHARS) -> Column:
    """One line of at most ``chars``; cut at the last space unless that throws half of it away."""
    one_line = lambda t: F.trim(F.regexp_replace(t, SPACE, " "))
    # The beginning of a text tells the line, unless it is mostly white space.
    near = F.substring(text, 1, HEAD_CHARS)

    def clip(flat):
        head = F.substring(flat, 1, chars - 1)
        cut = let(F.regexp_extract(head, "(?s)^(.*) ", 1), lambda whole: F.when(F.length(whole) >= -(-(chars - 1) // 2), whole).otherwise(head))
        return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(cut, F.lit("…")))

    return let(let(one_line(near), lambda flat: F.when((F.length(flat) > chars) | (F.length(text) <= HEAD_CHARS), flat).otherwise(one_line(text))), clip)


def tail_baton(turns: DataFrame, session: str, order: str, text: str, last: int = TAIL_TURNS) -> DataFrame:
    """(session, n_turns, baton): the last turns in order, a clipped line each."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    tail = turns.withColumn("_rank", rank).where(F.col("_rank") <= last)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), clip_line(F.coalesce(F.col(text), F.lit(""))).alias("line")))), lambda x: x["line"])
    return tail.groupBy(session).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(lines, "\n").alias("baton"))


# The lines of a baton, its length, how many tools and paths it looks at.
BATON_HEAD, BATON_CHARS, TAIL_TOOLS, TOUCHED = "[WORK NOW — DETERMINISTIC TAIL BATON]\nStatus: context-only", 1_200, 12, 5
PATHS = r"(?:^|\s)([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)"


def work_baton(turns: DataFrame, tools: DataFrame) -> DataFrame:
    """(session_id, baton): what a session worked on last, without a model.

    ``turns``: session_id, line_start, user_message; ``tools``: session_id, at, result, is_error, is_test, of trusted calls.
    Of the last ``TAIL_TOOLS`` calls the paths that their results name (latest first, each once), the latest test that
    passed and the latest error. Sessions without a request have no baton.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, SPACE, " "))
    own = F.trim(F.coalesce("user_message", F.lit("")))
    asked = turns.where(own != "").groupBy("session_id").agg(F.max_by(own, "line_start").alias("_ask"))
    last = tools.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("at")))).where(F.col("_n") <= TAIL_TOOLS)
    paths = last.select("session_id", "_n", F.posexplode(F.regexp_extract_all(F.coalesce("result", F.lit("")), F.lit(PATHS), F.lit(1))).alias("_i", "_path"))
    first = paths.groupBy("session_id", "_path").agg(F.min(F.struct("_n", "_i")).alias("_at"))
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy("_at"))).where(F.col("_k") <= TOUCHED)
    touched = first.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_path"))), lambda x: x["_path"]), ", ").alias("_touched"))
    latest = lambda test, name: F.min_by(F.when(test, F.col("result")), F.when(test, F.col("_n"))).alias(name)
    seen = last.groupBy("session_id").agg(latest(F.col("is_test") & ~F.col("is_error"), "_test"), latest(F.col("is_error"), "_error"))
    said = lambda name, c: F.concat(F.lit(name), c)
    lines = F.concat_ws(
        "\n", F.lit(BATON_HEAD), said("Request: ", sentence_cut(flat(F.col("_ask")), 500)), said("Touched: ", F.col("_touched")),
        said("Observed test evidence (verify): ", F.substring(flat(F.col("_test")), 1, 300)), said("Observed error (verification pending): ", F.substring(flat(F.col("_error")), 1, 300)),
    )
    return asked.join(touched, "session_id", "left").join(seen, "session_id", "left").select("session_id", F.substring(lines, 1, BATON_CHARS).alias("baton"))


def rehydration_items(carry: DataFrame, facts: DataFrame, turns: DataFrame, hot: DataFrame) -> DataFrame:
    """(session_id, section, rank, text): what a session is told when its context starts anew, for ``render_bundle``.

    ``carry`` (session_id, fact_id, generation) is what it held; ``facts`` (fact_id, generation, is_active, fact) what is
    so now: a fact that changed or was retired comes as a correction, one that is as it was comes again, one that is
    gone does not. ``turns`` (session_id, line_start, user_message) give the last turns, ``hot`` (session_id, ref, text)
    evidence that nothing has distilled yet.
    """
    now = facts.select("fact_id", F.col("generation").alias("_now"), "is_active", "fact")
    held = carry.join(now, "fact_id")
    changed = F.col("_now") != F.col("generation")
    section = F.when(~F.col("is_active") | changed, "correction").otherwise("fact")
    told = F.when(~F.col("is_active"), F.concat(F.lit("No longer active: "), "fact")).when(changed, F.concat(F.lit("Updated (supersedes earlier context): "), "fact")).otherwise(F.col("fact"))
    known = held.select("session_id", section.alias("section"), F.col("fact_id").cast("long").alias("rank"), told.alias("text"))
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("line_start")))
    tail = turns.withColumn("_k", last).where(F.col("_k") <= TAIL_TURNS).select("session_id", F.lit("tail").alias("section"), F.col("line_start").cast("long").alias("rank"), clip_line(F.coalesce("user_message", F.lit(""))).alias("text"))
    return known.unionByName(tail).unionByName(hot.select("session_id", F.lit("hot").alias("section"), F.col("ref").cast("long").alias("rank"), "text"))


def render_bundle(items: DataFrame, owner: str, section: str, rank: list, text: str, sections: dict[str, tuple[str, int]], wrap: bool = False) -> DataFrame:
    """(owner, bundle, n_lines, truncated): sections in the order of ``sections`` (name: heading, most items).

    An item that would pass the hard limit ends its section; past the target only short lines go on a section. Items
    over a section's limit fall away before rows are gathered, so a bundle is folded from a bounded list. With ``wrap``
    the hard limit and ``MOST_TOKENS`` hold for the bundle in its envelope (``gate.wrapped``), which it then is in.
    """
    names = list(sections)
    place = F.coalesce(*(F.when(F.col(section) == n, F.lit(i)) for i, n in enumerate(names)))
    most = F.element_at(F.array(*(F.lit(sections[n][1]) for n in names)), F.col("_s") + 1)
    top = max(m for _, m in sections.values())
    ranked = items.withColumn("_s", place).where("_s is not null").withColumn("_r", F.row_number().over(Window.partitionBy(owner, "_s").orderBy(*rank))).where(F.col("_r") <= top + 1)
    lines = F.array_sort(F.collect_list(F.struct("_s", "_r", most.alias("most"), F.concat(F.lit("- "), clip_line(F.coalesce(F.col(text), F.lit("")))).alias("line"))))
    heads = F.array(*(F.lit(sections[n][0]) for n in names))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(-1).alias("open"), F.lit(-1).alias("closed"), F.lit(False).alias("cut"))

    def step(acc, x):
        first = acc["open"] != x["_s"]
        grown = F.concat(acc["out"], F.when(first, F.concat(F.when(acc["out"] == "", "").otherwise("\n\n"), F.element_at(heads, x["_s"] + 1), F.lit("\n"))).otherwise(F.lit("\n")), x["line"])

        def taken(out):
            too_large = lambda whole: (F.length(whole) > HARD_CHARS) | (token_estimate(whole) > MOST_TOKENS)
            large = let(wrapped(out), too_large) if wrap else F.length(out) > HARD_CHARS
            over = (x["_r"] > x["most"]) | large | (~first & (F.length(out) > TARGET_CHARS) & (F.length(x["line"]) > LINE_CHARS // 2))
            shut = F.struct(acc["out"].alias("out"), acc["n"].alias("n"), acc["open"].alias("open"), x["_s"].alias("closed"), F.lit(True).alias("cut"))
            on = F.struct(out.alias("out"), (acc["n"] + 1).alias("n"), x["_s"].alias("open"), acc["closed"].alias("closed"), acc["cut"].alias("cut"))
            return F.when(over, shut).otherwise(on)

        return F.when(acc["closed"] == x["_s"], acc).otherwise(let(grown, taken))

    folded = ranked.groupBy(owner).agg(lines.alias("lines")).select(owner, F.aggregate("lines", start, step).alias("b"))
    out = F.when(F.col("b.out") == "", "").otherwise(wrapped(F.col("b.out"))) if wrap else F.col("b.out")
    return folded.select(owner, out.alias("bundle"), F.col("b.n").cast("long").alias("n_lines"), F.col("b.cut").alias("truncated"))


def context_epochs(events: DataFrame, session: str, order: list[str], reset: Column, marker: Column) -> DataFrame:
    """``events`` with ``epoch``: how many resets the session has seen so far; a marker that was applied before counts once."""
    again = F.row_number().over(Window.partitionBy(session, "_marker").orderBy(*order)) > 1
    marked = events.withColumn("_marker", F.when(reset, marker)).withColumn("_new", (F.col("_marker").isNotNull() & ~again).cast("long"))
    return marked.withColumn("epoch", F.sum("_new").over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_marker", "_new")
