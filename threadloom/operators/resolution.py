"""Scopes that callers state, slots that new facts claim, and where a fact comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.history import authority_rank, verdict

#: Kind of scope -> the column that must name something of the stated project.
OWNED = {"workspace-id": "workspace_id", "workstream-id": "workstream_id", "session-id": "session_id"}
NEEDS_PROJECT = ("project-id", "other-project-id", *OWNED)

MAX_PATHS = 1_000


def check_scopes(scopes: DataFrame, owners: DataFrame) -> DataFrame:
    """(request_id, problem) for scopes (request_id, type, project_id, workspace_id, workstream_id, session_id).

    ``owners`` (kind, id, project_id) tells which project each id belongs to. A null problem means the scope is sound;
    null ids where one is needed are problems, a workspace beside a workstream must be the project's as well.
    """
    out, kind = scopes, F.col("type")
    for name, column in OWNED.items():
        own = owners.where(F.col("kind") == column).select(F.col("id").alias(column), F.col("project_id").alias(f"_{column}"))
        out = out.join(own, column, "left")
    outside = lambda c: F.when(F.col(c).isNull(), f"{c} is required").when(~F.col(f"_{c}").eqNullSafe(F.col("project_id")), f"{c} is outside the project")
    problem = F.coalesce(
        F.when(kind.isNull() | ~kind.isin("global", "all", "fact-ids", *NEEDS_PROJECT), "unknown scope"),
        F.when(kind.isin(*NEEDS_PROJECT) & (F.coalesce("project_id", F.lit("")) == ""), "project_id is required"),
        *(F.when(kind == name, outside(c)) for name, c in OWNED.items()),
        F.when((kind == "workstream-id") & F.col("workspace_id").isNotNull(), outside("workspace_id")),
    )
    return out.select("request_id", problem.alias("problem"))


def resolve_scopes(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(request_id, type, project_id, problem): from what a caller states to one scope of stable ids.

    ``asked`` has request_id, scope (null: project), project (a path), project_id, workspace_id, workstream_id,
    session_id; ``places`` one row for each session (session_id, workstream_id, workspace_id, project_id, path, seen_at).
    An id beats a path, both together are refused, as is any id beside global or all; an id must belong to the project
    and to what else is stated. A path that no workspace has becomes a ``fact-ids`` scope (see ``legacy_facts``).
    """
    scope = F.coalesce("scope", F.lit("project"))
    stated = F.coalesce(F.col("project"), F.col("project_id"), F.col("workspace_id"), F.col("workstream_id"), F.col("session_id")).isNotNull()
    out = asked
    for c in ("session_id", "workstream_id", "workspace_id"):
        own = places.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("project_id").alias(f"{c}_project"), F.min("workspace_id").alias(f"{c}_workspace"), F.min("workstream_id").alias(f"{c}_workstream"))
        out = out.join(own, c, "left")
    by_path = places.groupBy(F.col("path").alias("project")).agg(F.min(F.struct(F.negative(F.unix_micros("seen_at")).alias("t"), "workspace_id", "project_id"))["project_id"].alias("path_project"))
    known = places.select("project_id", F.lit(True).alias("project_known")).distinct()
    out = out.join(by_path, "project", "left").join(known, "project_id", "left")
    clash = lambda own, wanted: F.col(wanted).isNotNull() & ~F.col(own).eqNullSafe(F.col(wanted))
    project = F.when(scope == "session", F.col("session_id_project")).when(scope == "workstream", F.col("workstream_id_project")).when(scope == "workspace", F.col("workspace_id_project")).when(scope == "project", F.coalesce("project_id", "path_project"))
    inside = lambda c: F.col(c).isNotNull() & ~F.col(f"{c}_project").eqNullSafe(F.coalesce("project_id", "path_project"))
    named = lambda c: F.when(F.col(c).isNull(), f"{c} is required").when(F.col(f"{c}_project").isNull(), f"unknown {c}").when(clash(f"{c}_project", "project_id"), f"{c} is outside project_id")
    problem = (
        F.when(~scope.isin("project", "workspace", "workstream", "session", "global", "all"), "unknown scope")
        .when(scope.isin("global", "all"), F.when(stated, "scope cannot be combined with an identity"))
        .when((scope != "project") & F.col("project").isNotNull(), "a path cannot be combined with this scope")
        .when(scope == "session", F.coalesce(named("session_id"), F.when(clash("session_id_workspace", "workspace_id"), "session_id is outside workspace_id"), F.when(clash("session_id_workstream", "workstream_id"), "session_id is outside workstream_id")))
        .when(scope == "workstream", F.coalesce(named("workstream_id"), F.when(clash("workstream_id_workspace", "workspace_id"), "workstream_id is outside workspace_id"), F.when(F.col("session_id").isNotNull() & ~F.col("session_id_workstream").eqNullSafe(F.col("workstream_id")), "session_id is outside workstream_id")))
        .when(scope == "workspace", F.coalesce(named("workspace_id"), F.when(F.col("workstream_id").isNotNull() & ~F.col("workstream_id_workspace").eqNullSafe(F.col("workspace_id")), "workstream_id is outside workspace_id"), F.when(F.col("session_id").isNotNull() & ~F.col("session_id_workspace").eqNullSafe(F.col("workspace_id")), "session_id is outside workspace_id")))
        .when(F.col("project_id").isNotNull(), F.when(F.col("project").isNotNull(), "project_id or path, not both").when(F.col("project_known").isNull(), "unknown project_id"))
        .when(F.col("project").isNull(), "project is required")
    )
    unmapped = (scope == "project") & F.col("project_id").isNull() & F.col("path_project").isNull()
    problem = F.coalesce(problem, F.when((scope == "project") & ~unmapped, F.coalesce(*(F.when(inside(c), f"{c} is outside project_id") for c in ("workspace_id", "workstream_id", "session_id")))))
    kind = F.when(scope.isin("global", "all"), scope).when(unmapped, "fact-ids").otherwise(F.concat(scope, F.lit("-id")))
    sound = problem.isNull()
    return out.select("request_id", F.when(sound, kind).alias("type"), F.when(sound & ~unmapped, project).alias("project_id"), problem.alias("problem"))


def legacy_facts(facts: DataFrame, paths: DataFrame, fact_path: Column, kind: str) -> DataFrame:
    """(request_id, id): the facts that a path shows which no workspace has. ``paths`` has request_id and path.

    ``project``: the path's own and global ones; ``exact-project``: its own; ``other-projects``: those of other paths.
    """
    if kind != "exact-project" and paths.count() > MAX_PATHS:
        raise ValueError(f"{MAX_PATHS} paths at most can be asked for at once: they are broadcast")
    own = facts.select("id", "scope_type", fact_path.alias("_path"))
    mine = own.where("scope_type = 'project' and _path is not null")
    if kind == "other-projects":
        # The requests are stated scopes, ``MAX_PATHS`` at most; facts are read once.
        return mine.join(F.broadcast(paths), F.col("_path") != F.col("path")).select("request_id", "id")
    same = mine.join(paths, F.col("_path") == F.col("path")).select("request_id", "id")
    if kind == "exact-project":
        return same
    return same.unionByName(own.where("scope_type = 'global'").select("id").join(F.broadcast(paths.select("request_id")), how="cross").select("request_id", "id"))


def save_facts(candidates: DataFrame, held: DataFrame, slot: list[str]) -> DataFrame:
    """(candidate_id, holder, outcome) of candidates (candidate_id, slot, text, effective_at, authority) against what
    their slot holds (slot, id, text, effective_at, authority).

    ``new``: the slot is free; ``merge``: it holds the same text; else the evidence decides: ``change`` (later and of no
    less authority), ``historical`` (older) or ``contradicted``. Of several candidates for a free slot the first by
    clock and id is new, later ones are judged against it.
    """
    now = held.select(*slot, F.col("id").alias("holder"), F.col("text").alias("_text"), F.col("effective_at").alias("_at"), F.col("authority").alias("_authority"))
    w = Window.partitionBy(*slot).orderBy("effective_at", "candidate_id")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = candidates.join(now, slot, "left").withColumns({"_n": F.row_number().over(w), "_free": F.col("holder").isNull(), "_f_text": first("text"), "_f_at": first("effective_at"), "_f_authority": first("authority")})
    later = F.col("_free") & (F.col("_n") > 1)
    text, at, authority = (F.when(later, F.col(a)).otherwise(F.col(b)) for a, b in (("_f_text", "_text"), ("_f_at", "_at"), ("_f_authority", "_authority")))
    judged = verdict(F.lit(True), F.col("effective_at") > at, F.col("effective_at") < at, authority_rank(F.col("authority")), authority_rank(authority))
    outcome = F.when(F.col("_free") & ~later, "new").when(F.col("text") == text, "merge").otherwise(F.when(judged == "apply", "change").otherwise(judged))
    return out.select("candidate_id", "holder", outcome.alias("outcome"))


def trace(facts: DataFrame, sources: DataFrame, timeline: DataFrame, incidents: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, kind, ref, at): where facts (id, sources, subject) come from and what happened to them since.

    ``sources`` (ref, at) are the exchanges that facts cite, a cited one that is gone has a null clock; ``timeline``
    (id, ref, at) are the facts' revisions; ``incidents`` and ``hot`` (subject, ref, at) are joined by subject.
    """
    cited = facts.select("id", F.explode("sources").alias("ref")).join(sources.select("ref", "at"), "ref", "left")
    parts = [cited.select("id", F.lit("source").alias("kind"), "ref", "at"), timeline.join(facts.select("id"), "id", "left_semi").select("id", F.lit("revision").alias("kind"), "ref", "at")]
    parts += [facts.select("id", "subject").join(df, "subject").select("id", F.lit(kind).alias("kind"), "ref", "at") for kind, df in (("incident", incidents), ("hot", hot))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
