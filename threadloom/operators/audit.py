"""Whether what is kept is sound: structural audit, index against archives, moves to canonical paths, purges, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.set_join import ordered_pairs

PROMOTED = ("decision", "project-current")


def integrity_findings(facts, exchanges, tombstones, promotions, revisions, vectors, relations, context) -> DataFrame:
    """(code, disposition, id): what a read-only audit finds; ``repairable`` or for ``review``.

    facts: id, scope_type, project_id, workspace_id, workstream_id, promotion_state, is_active, sources (null: unreadable);
    exchanges: ref, workstream_id; tombstones: id, reason; promotions: id, promotion_state; revisions: id, actor,
    event_kind, verified; vectors: id; relations: id, source_id, target_id; context: id, ref.
    """
    cited = facts.select("id", F.explode(F.array_distinct("sources")).alias("ref")).join(exchanges.select("ref", F.lit(True).alias("here"), F.col("workstream_id").alias("of")), "ref", "left")
    # A fact cites few exchanges, so the set of their streams is small.
    lineage = cited.groupBy("id").agg(F.count_if(F.col("here").isNull()).alias("gone"), F.collect_set("of").alias("streams"))
    buried = tombstones.where("reason = 'source_conversation_excluded'").select("id", F.lit(True).alias("buried")).distinct()
    proved = promotions.select("id", "promotion_state", F.lit(True).alias("proved")).distinct()
    doubtful = revisions.where("actor in ('consolidator', 'legacy') and event_kind = 'CHANGED' and not verified").select("id", F.lit(True).alias("doubtful")).distinct()
    f = facts.join(lineage, "id", "left").join(buried, "id", "left").join(proved, ["id", "promotion_state"], "left").join(doubtful, "id", "left")
    state, own = F.col("promotion_state"), F.col("workstream_id")
    streams = F.coalesce("streams", F.array().cast("array<string>"))
    legacy = F.col("project_id").isNull() | state.isNull() | (state == "legacy-project") | ((state == "workstream") & own.isNull()) | ((state == "workspace") & F.col("workspace_id").isNull())
    read = F.col("sources").isNotNull()
    tests = (
        ("privacy-resurrection", "repairable", F.col("buried")), ("legacy-identity", "review", (F.col("scope_type") == "project") & legacy), ("missing-source", "review", ~read | (F.col("gone") > 0)),
        ("mixed-workstream-lineage", "review", read & (F.size(streams) > 1)), ("foreign-workstream-lineage", "review", read & (state == "workstream") & F.exists(streams, lambda s: ~s.eqNullSafe(own))),
        ("unproven-promotion", "review", read & state.isin(*PROMOTED) & (F.size(streams) > 0) & F.col("proved").isNull()), ("semantic-revalidation-needed", "review", read & F.col("doubtful")),
    )
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(how).alias("disposition"))) for code, how, c in tests)))
    found = f.select("id", F.inline(codes)).select("code", "disposition", "id")
    live = facts.where("is_active").select("id")
    orphan = lambda df, code: df.select(F.lit(code).alias("code"), F.lit("repairable").alias("disposition"), "id")
    edges = relations.join(live.withColumnRenamed("id", "source_id").withColumn("_a", F.lit(1)), "source_id", "left").join(live.withColumnRenamed("id", "target_id").withColumn("_b", F.lit(1)), "target_id", "left").where("_a is null or _b is null")
    loose = context.join(facts.select("id", F.lit(1).alias("_f")), "id", "left").join(exchanges.select("ref", F.lit(1).alias("_e")), "ref", "left").where("_f is null or _e is null")
    return found.unionByName(orphan(vectors.join(live, "id", "left_anti"), "orphan-vector")).unionByName(orphan(edges, "orphan-relation")).unionByName(orphan(loose, "orphan-context"))


def verify_index(archives: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, state) of archives (key, modified, readable) against the index (key, indexed_at): corrupted, missing,
    outdated, orphaned or current."""
    both = archives.select(key, "modified", "readable").join(index.select(key, "indexed_at"), key, "full")
    state = (
        F.when(F.col("modified").isNull(), "orphaned").when(~F.col("readable"), "corrupted").when(F.col("indexed_at").isNull(), "missing")
        .when(F.col("indexed_at") < F.col("modified"), "outdated").otherwise("current")
    )
    return both.select(key, state.alias("state"))


def migration_plan(rows: DataFrame, canonical: Column) -> DataFrame:
    """(id, outcome, from, to) of rows (id, project, cwd): only an absolute working folder is evidence of a move."""
    cwd = F.trim(F.coalesce("cwd", F.lit("")))
    outcome = F.when(cwd == "", "no cwd").when(~cwd.startswith("/"), "relative cwd").when(F.col("project").eqNullSafe(canonical), "canonical").otherwise("move")
    return rows.select("id", outcome.alias("outcome"), F.col("project").alias("from"), F.when(outcome == "move", canonical).alias("to"))


def doomed_facts(gone: DataFrame, facts: DataFrame, revisions: DataFrame, context: DataFrame) -> DataFrame:
    """Ids of facts that cite an exchange which goes (ref): as a source, in a revision or as context."""
    cites = facts.select("id", F.explode("sources").alias("ref")).union(revisions.select("id", F.explode("sources").alias("ref"))).union(context.select("id", "ref"))
    return cites.join(gone.select("ref").distinct(), "ref", "left_semi").select("id").distinct()


def purge(tables: dict[str, tuple[DataFrame, list[str]]], doomed: DataFrame) -> dict[str, DataFrame]:
    """The tables without rows of doomed facts; each comes with the columns that hold fact ids."""
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(doomed.select(F.col("id").alias(c)), c, "left_anti")
        out[name] = df
    return out


def with_results(rows: DataFrame, owner: str, line: str, is_call: Column, is_result: Column, call_id: Column, text: Column, ahead: int = 5) -> DataFrame:
    """``rows`` with ``result``: for a call the first result under its id within the next ``ahead`` rows."""
    w = Window.partitionBy(owner).orderBy(line)
    marked = rows.withColumns({"_call": is_call, "_id": call_id, "_out": F.when(is_result, F.struct(call_id.alias("i"), text.alias("t")))})
    near = [F.lead("_out", n).over(w) for n in range(1, ahead + 1)]
    found = F.coalesce(*(F.when(o["i"] == F.col("_id"), o["t"]) for o in near))
    return marked.withColumn("result", F.when(F.col("_call"), found)).drop("_call", "_id", "_out")


def evaluation(cases: DataFrame) -> DataFrame:
    """One row over cases (case_id, tags, passed, expected, matched, observed, failed): counts and ratios, null where a
    denominator is zero. Failed runs count as cases only; a case that expects nothing is a negative one."""
    ran, none = ~F.col("failed"), F.col("expected") == 0
    tagged = lambda t: F.array_contains("tags", t)
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    share = lambda t: ratio(F.count_if(ran & tagged(t) & F.col("passed")), F.count_if(ran & tagged(t)))
    total = lambda c: F.coalesce(F.sum(F.when(ran, F.col(c))), F.lit(0))
    strays = F.sum(F.when(ran, F.greatest(F.col("observed") - F.col("matched"), F.lit(0))))
    return cases.agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if(ran & F.col("passed")).alias("passed_cases"), F.count_if(ran & ~F.col("passed")).alias("failed_cases"), F.count_if(~ran).alias("execution_errors"),
        strays.alias("false_positives"), ratio(total("matched"), total("expected")).alias("recall"), ratio(total("matched"), total("observed")).alias("precision"),
        ratio(F.count_if(ran & none & (F.col("observed") == 0)), F.count_if(ran & none)).alias("no_fact_accuracy"), share("ratification").alias("ratification"), share("verified_local").alias("verified_local"),
        ratio(F.count_if(ran & none & tagged("exploration") & (F.col("observed") > 0)), F.count_if(ran & none & tagged("exploration"))).alias("exploration_false_positives"),
    )


def counters(tables: dict[str, DataFrame], metrics: dict[str, dict[str, str]]) -> DataFrame:
    """(metric, value): rows of each table that meet each condition; a table is read once for all of its counters."""
    out = None
    for name, own in metrics.items():
        row = tables[name].agg(*(F.count_if(F.expr(c)).alias(m) for m, c in own.items()))
        part = row.unpivot([], list(own), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def tool_pairs(calls: DataFrame, turn: list[str], tool: str, at: str, least: int = 3, top: int = 5) -> DataFrame:
    """(first_tool, then_tool, n): tools of which one was called later than the other in the same turn, most frequent
    first. Pairs are counted, not made."""
    pairs = ordered_pairs(calls, turn, tool, at).withColumnsRenamed({"first": "first_tool", "then": "then_tool"})
    return pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "first_tool", "then_tool").limit(top)


def project_profiles(exchanges: DataFrame) -> DataFrame:
    """(project, n, sessions, branches, first_seen, last_seen)."""
    return exchanges.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("branch").alias("branches"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def coverage(files: DataFrame, sidecars: DataFrame, key: str, group: str) -> DataFrame:
    """(group, files, summarised): how many files of each group have a sidecar."""
    return files.join(sidecars.select(key, F.lit(1).alias("_has")).distinct(), key, "left").groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.count("_has").alias("summarised"))


def resolve_categories(asked: DataFrame, categories: DataFrame) -> DataFrame:
    """(request_id, category_id, created): the oldest category of the domain under that name in any case; else the name
    becomes a new category, named once by a hash of domain and lower-case name."""
    name = F.lower(F.trim("name"))
    oldest = categories.groupBy("domain", name.alias("_name")).agg(F.min(F.struct("created_at", "category_id"))["category_id"].alias("_id"))
    out = asked.withColumn("_name", name).join(oldest, ["domain", "_name"], "left")
    fresh = F.concat(F.lit("new-"), F.substring(F.md5(F.concat_ws("|", F.col("domain").cast("string"), "_name")), 1, 12))
    return out.select("request_id", F.coalesce(F.col("_id").cast("string"), fresh).alias("category_id"), F.col("_id").isNull().alias("created"))


def job_list(jobs: DataFrame, state: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """(job_id, kind, state, attempts, updated_at, in_state) of the newest jobs that pass the filters, with the number of
    all jobs in their state."""
    counts = jobs.groupBy("state").agg(F.count(F.lit(1)).alias("in_state"))
    kept = jobs.where((F.lit(True) if state is None else F.col("state") == state) & (F.lit(True) if kind is None else F.col("kind") == kind))
    newest = kept.orderBy(F.desc("updated_at"), "job_id").limit(max(1, min(limit, 500)))
    return newest.join(F.broadcast(counts), "state").select("job_id", "kind", "state", "attempts", "updated_at", "in_state")
