"""Identity: paths, projects behind workspaces, streams behind sessions, moves and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.set_join import similar_sets

BRANCH_CONFIDENCE = 0.9


def canonical_path(path: Column) -> Column:
    """Absolute path without empty, ``.`` and ``..`` parts; the empty string for null or blank input."""
    parts = F.filter(F.split(F.trim(path), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", "").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def _only(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name, name_n): the value of keys that have one, and how many they have."""
    n = F.count_distinct(value)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.when(n == 1, F.min(value)).alias(name), n.alias(f"{name}_n"))


def resolve_projects(requests: DataFrame, workspaces: DataFrame, projects: DataFrame) -> DataFrame:
    """(request_id, project_id, reason) for requests (request_id, path, explicit_id, portable_key, common_dir, remote).

    ``workspaces`` holds (path, project_id, common_dir, remote, approved), ``projects`` (project_id, portable_key). A
    known path wins; then an explicit id, a portable key, a common directory that one project has, an approved remote
    that one project has. Where the explicit id and the key, or the path and the explicit id, name different projects,
    or a shared directory or remote is claimed by several, the project is null and the reason ``conflict``.
    """
    named = projects.where("portable_key is not null").groupBy("portable_key").agg(F.min("project_id").alias("by_key"))
    found = (
        requests.join(workspaces.groupBy("path").agg(F.min("project_id").alias("by_path")), "path", "left")
        .join(named, "portable_key", "left")
        .join(_only(workspaces, "common_dir", "project_id", "by_dir"), "common_dir", "left")
        .join(_only(workspaces.where("approved"), "remote", "project_id", "by_remote"), "remote", "left")
    )
    clash = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    reason = (
        F.when(clash("by_path", "explicit_id") | clash("by_key", "explicit_id"), "conflict")
        .when(F.col("by_path").isNotNull(), "path").when(F.col("explicit_id").isNotNull(), "explicit").when(F.col("by_key").isNotNull(), "portable-key")
        .when(F.col("by_dir_n") > 1, "conflict").when(F.col("by_dir").isNotNull(), "common-dir")
        .when(F.col("by_remote_n") > 1, "conflict").when(F.col("by_remote").isNotNull(), "approved-remote").otherwise("new")
    )
    project = F.when(reason != "conflict", F.coalesce("by_path", "explicit_id", "by_key", "by_dir", "by_remote"))
    return found.select("request_id", project.alias("project_id"), reason.alias("reason"))


def stream_id(project: Column, branch: Column) -> Column:
    """The id of a project's stream for a branch; a null or blank branch names its default stream. the
    names of both kinds; every part ends in a NUL."""
    end, name = F.lit("\0"), F.nullif(F.trim(branch), F.lit(""))
    own = F.concat(F.lit("workstream-branch-v1"), end, project.cast("string"), end, name, end)
    default = F.concat(F.lit("workstream-project-default-v1"), end, project.cast("string"), end)
    return F.concat(F.lit("ws-"), F.substring(F.sha2(F.coalesce(own, default), 256), 1, 32))


# What the best topic must reach, and by how much it must lead the next.
TOPIC_SCORE, TOPIC_LEAD = 0.45, 0.15


def topic_streams(sessions: DataFrame, capsules: DataFrame) -> DataFrame:
    """(session_id, topic_stream, topic_score): the active stream of a session's project whose capsule (stream_id, project,
    text) its first prompt resembles clearly best. Sessions have session_id, project, prompt.

    Sessions meet streams by a set-similarity join at the least score that can matter: a runner-up further behind than
    ``TOPIC_LEAD`` changes nothing, and neither does a third.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_-]{2,}"), F.lit(0)))
    ask = sessions.select(F.col("session_id").alias("id"), "project", words(F.col("prompt")).alias("words"))
    have = capsules.select(F.col("stream_id").alias("id"), "project", words(F.col("text")).alias("words"))
    scored = similar_sets(ask, have, TOPIC_SCORE - TOPIC_LEAD, ["project"], k=2).withColumnsRenamed({"left_id": "session_id", "right_id": "stream_id"})
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "stream_id")
    best = scored.withColumn("place", F.row_number().over(order)).where("place <= 2").groupBy("session_id").agg(F.max(F.when(F.col("place") == 1, F.struct("score", "stream_id"))).alias("b"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("next"))
    clear = (F.col("b.score") >= TOPIC_SCORE) & (F.col("b.score") - F.coalesce("next", F.lit(0.0)) >= TOPIC_LEAD)
    return best.where(clear).select("session_id", F.col("b.stream_id").alias("topic_stream"), F.col("b.score").alias("topic_score"))


def bind_sessions(sessions: DataFrame, bound: DataFrame, streams: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(session_id, stream, reason, confidence) for sessions (session_id, project, workspace, explicit, branch, default_branch).

    A session that ``bound`` (session_id, old_stream) knows resumes; else an explicit stream of the same project, the
    only active stream of workspace and branch, and last the stream that project and branch name. An explicit stream
    of another project is rejected. ``topics`` (see ``topic_streams``) decides for sessions without a branch of their own
    whose project has no default stream yet.
    """
    own = streams.select(F.col("stream_id").alias("explicit"), F.col("project").alias("explicit_project"))
    active = streams.where("active and branch is not null").groupBy("project", "workspace", "branch").agg(F.min("stream_id").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    signal = F.when(~F.col("branch").eqNullSafe(F.col("default_branch")), F.nullif(F.trim("branch"), F.lit("")))
    all_ = sessions.join(bound, "session_id", "left").join(own, "explicit", "left").join(active, ["project", "workspace", "branch"], "left")
    all_ = all_.withColumns({"_signal": signal, "_named": stream_id(F.col("project"), signal)})
    if topics is None:
        all_ = all_.withColumns({"topic_stream": F.lit(None).cast("string"), "topic_score": F.lit(None).cast("double")})
    else:
        known = streams.select(F.col("stream_id").alias("_named"), F.lit(True).alias("_known")).distinct()
        all_ = all_.join(topics, "session_id", "left").join(known, "_named", "left")
        all_ = all_.withColumn("topic_stream", F.when(F.col("_known").isNull() & F.col("_signal").isNull(), F.col("topic_stream")))
    same = F.col("explicit_project").eqNullSafe(F.col("project"))
    reason = (
        F.when(F.col("old_stream").isNotNull(), "resume-exact").when(F.col("explicit").isNotNull() & same, "explicit").when(F.col("explicit").isNotNull(), "rejected")
        .when(F.col("only").isNotNull(), "unique-workspace-branch").when(F.col("topic_stream").isNotNull(), "strong-topic-margin").when(F.col("_signal").isNotNull(), "workspace-branch").otherwise("project-default")
    )
    stream = F.coalesce("old_stream", F.when(same, F.col("explicit")), F.when(F.col("explicit").isNull(), F.coalesce("only", "topic_stream", "_named")))
    confidence = F.when(reason == "unique-workspace-branch", BRANCH_CONFIDENCE).when(reason == "strong-topic-margin", F.col("topic_score")).when(reason != "rejected", 1.0)
    return all_.select("session_id", stream.alias("stream"), reason.alias("reason"), confidence.alias("confidence"))


def location_changes(seen: DataFrame, workspace: str, kind: str, order: list[str]) -> DataFrame:
    """One event for each workspace and kind of move, at its first time (``order[0]``)."""
    before = F.lag(kind).over(Window.partitionBy(workspace).orderBy(*order))
    moves = seen.select(F.col(workspace).alias("workspace"), before.alias("from_kind"), F.col(kind).alias("to_kind"), F.col(order[0]).alias("at")).where("from_kind <> to_kind")
    first = moves.groupBy("workspace", "from_kind", "to_kind").agg(F.min("at").alias("first_at"))
    return first.withColumn("event_id", F.concat(F.lit("wsloc-"), F.substring(F.sha2(F.concat_ws("|", F.col("workspace").cast("string"), "from_kind", "to_kind"), 256), 1, 32)))


def revision_state(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """(session_id, project, seen, current, stale); a project nobody knows is at revision zero."""
    joined = sessions.join(projects, "project", "left").withColumn("current", F.coalesce("revision", F.lit(0)).cast("long"))
    return joined.select("session_id", "project", F.col("seen").cast("long").alias("seen"), "current", (F.col("current") > F.col("seen")).alias("stale"))


def link_workspaces(workspaces: DataFrame, links: DataFrame) -> DataFrame:
    """``workspaces`` (workspace_id, project_id, …) after ``links`` (workspace_id, target), with ``moved``.

    A source project that keeps no workspace is emptied: its name lives on in ``emptied`` on the rows that left it.
    """
    target = links.groupBy("workspace_id").agg(F.max("target").alias("target"))
    joined = workspaces.join(target, "workspace_id", "left")
    moved = F.col("target").isNotNull() & (F.col("target") != F.col("project_id"))
    left = joined.groupBy("project_id").agg(F.count_if(~moved).alias("stay"))
    out = joined.join(left, "project_id").withColumns({"moved": moved, "emptied": F.when(moved & (F.col("stay") == 0), F.col("project_id"))})
    return out.withColumn("project_id", F.coalesce("target", "project_id")).drop("target", "stay")


def rebind_sessions(bindings: DataFrame, requests: DataFrame, streams: DataFrame) -> DataFrame:
    """(session_id, stream, outcome): a session moves to an active stream of its own project, else it stays put."""
    wish = requests.groupBy("session_id").agg(F.max("stream").alias("wish"))
    goal = streams.select(F.col("stream_id").alias("wish"), F.col("project").alias("goal_project"), "active")
    joined = bindings.join(wish, "session_id", "left").join(goal, "wish", "left")
    outcome = (
        F.when(F.col("wish").isNull() | F.col("wish").eqNullSafe(F.col("stream")), "unchanged").when(F.col("goal_project").isNull(), "unknown stream")
        .when(F.col("goal_project") != F.col("project"), "other project").when(~F.col("active"), "inactive").otherwise("moved")
    )
    return joined.select("session_id", F.when(outcome == "moved", F.col("wish")).otherwise(F.col("stream")).alias("stream"), outcome.alias("outcome"))


SLOT_NAME = "^[a-z][a-z0-9_.-]{2,160}$"


def assign_slots(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, outcome) for wishes (fact_id, project, subject, state, evidence, workspace, workstream).

    States need their evidence and their scope; a slot (project, subject, state, workspace, workstream) holds one
    active fact of ``facts`` (the same columns, active). Of wishes for one free slot the least fact id gets it. Keys
    are compared with nulls equal.
    """
    slot = ["project", "subject", "state", "workspace", "workstream"]
    state, evidence, wide = F.col("state"), F.col("evidence"), F.col("state").isin("decision", "project-current")
    no_space, no_stream = F.col("workspace").isNull(), F.col("workstream").isNull()
    wrong = (
        F.when(~F.coalesce(F.col("subject").rlike(SLOT_NAME), F.lit(False)), "bad name")
        .when((state == "decision") & (evidence != "explicit-decision") | (state == "project-current") & ~evidence.isin("merged", "validated", "no-branch-signal") | (state == "workstream") & (evidence != "experimental"), "bad evidence")
        .when((state == "workspace") & no_space | (state == "workstream") & no_stream | wide & ~(no_space & no_stream) | (state == "workspace") & ~no_stream, "bad scope")
    )
    held = facts.where("active").groupBy(*(F.col(c).alias(f"_{c}") for c in slot)).agg(F.min("fact_id").alias("low"), F.max("fact_id").alias("high"))
    same = F.lit(True)
    for c in slot:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    judged = wanted.withColumn("wrong", wrong)
    first = judged.where("wrong is null").groupBy(*(F.col(c).alias(f"_{c}") for c in slot)).agg(F.min("fact_id").alias("first"))
    met = judged.join(held, same, "left").drop(*(f"_{c}" for c in slot)).join(first, same, "left")
    taken = F.col("low").isNotNull() & ((F.col("low") != F.col("fact_id")) | (F.col("high") != F.col("fact_id")))
    return met.select("fact_id", F.coalesce("wrong", F.when(taken, "slot taken").when(F.col("first") < F.col("fact_id"), "later wish"), F.lit("assigned")).alias("outcome"))
