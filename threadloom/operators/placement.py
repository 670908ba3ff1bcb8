"""Where a fact belongs: tiers, scopes, slots, and what consolidation does to pairs of facts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.vector_cells import nearest_within

# The first part of a subject key that each category of facts calls for, and the default branches.
SUBJECT_PREFIX = {"decision": "decision", "constraint": "constraint", "preference": "preference", "pattern": "pattern", "knowledge": "state"}
DEFAULT_BRANCHES = ("main", "master")
SLOT = ["project_id", "subject_key", "tier", "workspace_id", "workstream_id"]


def fact_scope(scope_type: Column, project: Column, tier: Column, workspace: Column, stream: Column) -> Column:
    """The narrowest scope that reads a fact; null where an identity that its tier needs is missing."""
    return (
        F.when(scope_type == "global", "global").when(project.isNull(), None)
        .when(tier == "workstream", F.when(stream.isNotNull(), F.concat(F.lit("workstream:"), stream)))
        .when(tier == "workspace", F.when(workspace.isNotNull(), F.concat(F.lit("workspace:"), workspace)))
        .otherwise(F.concat(F.lit("project:"), project))
    )


def session_scope(known: Column, quarantined: Column, project: Column, stream: Column) -> Column:
    """Quarantined or unbound sessions read only what is global; unknown sessions nothing."""
    bound = project.isNotNull() & stream.isNotNull() & ~F.coalesce(quarantined, F.lit(False))
    return F.when(known & bound, F.concat(F.lit("workstream:"), stream)).when(known, "global")


def branch_signal(branch: Column, default: Column) -> Column:
    """none, default or ``branch:<name>``; without a stated default the usual names count as default."""
    name = F.nullif(F.trim(branch), F.lit(""))
    is_default = F.when(F.nullif(F.trim(default), F.lit("")).isNotNull(), name == F.trim(default)).otherwise(name.isin(*DEFAULT_BRANCHES))
    return F.when(name.isNull(), "none").when(is_default, "default").otherwise(F.concat(F.lit("branch:"), name))


def subject_key(raw: Column, category: Column) -> Column:
    """The key in lower case if it follows the grammar and begins as its category asks; else null."""
    key = F.lower(F.trim(raw))
    prefix = F.element_at(F.create_map(*(F.lit(x) for pair in SUBJECT_PREFIX.items() for x in pair)), category)
    return F.when(key.rlike(r"^[a-z][a-z0-9_-]*(?:\.[a-z0-9][a-z0-9_-]*)+$") & (F.split_part(key, F.lit("."), F.lit(1)) == prefix), key)


def untrusted_path(path: Column) -> Column:
    """Null, blank, unknown, or a path without a base name."""
    raw = F.trim(F.coalesce(path, F.lit("")))
    return (raw == "") | (raw == "unknown") | (F.regexp_extract(raw, "([^/]*)/*$", 1) == "")


def why_not_consolidate(a: str, b: str, relation: Column) -> Column:
    """The first reason against consolidating the pair (columns with these prefixes), null if there is none."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    same = lambda c: x(c).eqNullSafe(y(c))
    identity = lambda f: f("project_id").isNotNull() | f("workspace_id").isNotNull() | f("workstream_id").isNotNull()
    project = x("scope_type") == "project"
    wide = x("tier").isin("project-current", "decision")
    checks = (
        (x("id") == y("id"), "same participant"),
        (~x("is_active") | ~y("is_active"), "inactive participant"),
        (x("scope_type") != y("scope_type"), "different scope types"),
        (project & (x("project_id").isNull() | y("project_id").isNull() | x("tier").isNull() | y("tier").isNull()), "legacy or incomplete project identity"),
        (project & ~(same("project_id") & same("tier") & same("workspace_id") & same("workstream_id")), "different mutation scope"),
        (project & (x("tier") == "workstream") & x("workstream_id").isNull(), "missing workstream identity"),
        (project & (x("tier") == "workspace") & (x("workspace_id").isNull() | x("workstream_id").isNotNull()), "invalid workspace identity"),
        (project & wide & (x("workspace_id").isNotNull() | x("workstream_id").isNotNull()), "invalid project-wide identity"),
        (~project & (identity(x) | identity(y)), "global fact has project identity"),
        (x("subject_key").isNotNull() & y("subject_key").isNotNull() & (x("subject_key") != y("subject_key")), "different subjects"),
        (relation.isin("CONTRADICTION", "EVOLUTION") & (x("subject_key").isNull() | ~same("subject_key")), "unresolved competing subject"),
    )
    return F.coalesce(*(F.when(c, F.lit(why)) for c, why in checks))


def slot_holders(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """``wanted`` (request_id and the slot) with ``holder``: the active fact in the slot; nulls are equal there.

    Facts are folded to one row a slot first, so a crowded slot does not multiply requests.
    """
    held = facts.where("is_active and subject_key is not null and project_id is not null").groupBy(*SLOT).agg(F.min("id").alias("holder"))
    held = held.select(*(F.col(c).alias(f"_{c}") for c in SLOT), "holder")
    match = F.lit(True)
    for c in SLOT:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return wanted.join(held, match, "left").select("request_id", "holder")


def consolidate(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts after the verdicts (survivor, other, relation).

    DUPLICATE retires the other, whose sources and one confirmation for each go to the survivor; CONTRADICTION and
    EVOLUTION retire the survivor in favour of the other; INDEPENDENT changes nothing. A fact that a duplicate retires
    stays retired.
    """
    dup = verdicts.where("relation = 'DUPLICATE'")
    given = dup.join(facts.select(F.col("id").alias("other"), F.col("sources").alias("more")), "other").groupBy(F.col("survivor").alias("id")).agg(F.count(F.lit(1)).alias("gained"), F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"))
    retired = dup.select(F.col("other").alias("id")).union(verdicts.where("relation in ('CONTRADICTION', 'EVOLUTION')").select("survivor")).distinct().withColumn("retired", F.lit(True))
    out = facts.join(given, "id", "left").join(retired, "id", "left")
    return out.select(
        "id", (F.col("is_active") & F.col("retired").isNull()).alias("is_active"), (F.col("confirmations") + F.coalesce("gained", F.lit(0))).alias("confirmations"),
        F.array_sort(F.array_union("sources", F.coalesce("more", F.array().cast("array<string>")))).alias("sources"),
    )


def rank_score(confirmations: Column, age_days: Column, scope_type: Column) -> Column:
    """Confirmations on a logarithm, a step for freshness, two for the project's own."""
    counted = F.when(confirmations > 0, 3 * (1 + F.log2(confirmations + 1))).otherwise(F.lit(3.0))
    fresh = F.when(age_days <= 7, 5).when(age_days <= 30, 3).when(age_days <= 90, 1).otherwise(0)
    return counted + fresh + F.when(scope_type == "project", 2).otherwise(0)


def nearest_in_scope(facts: DataFrame, vectors: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """(id, nearest, similarity, asked): each fact's closest other fact of its scope at or over the threshold.

    The threshold is a radius, so facts meet only in blocks and cells that it reaches; ``asked`` counts the facts that one
    was compared with.
    """
    rows = facts.join(vectors, "id").select("id", *scope, "v")
    found = nearest_within(rows, scope, math.sqrt(max(0.0, 2 - 2 * threshold)), least=threshold)
    return found.select("id", "nearest", (1 - F.pow(F.sqrt("distance_sq"), 2) / 2).alias("similarity"), "asked")
