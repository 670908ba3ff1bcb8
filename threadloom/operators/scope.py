"""Predicates over facts and exchanges: scopes, filters, path boundaries, backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(kind: str, project: str | None = None, ids: list | None = None) -> Column:
    """Which facts a reader sees: ``all``, ``global``, ``project`` (its truths and global ones), ``project-only``,
    ``other-projects`` or ``fact-ids``."""
    shared = F.col("scope_type") == "global"
    own = (F.col("project") == project) & ~shared
    kinds = {"all": F.lit(True), "global": shared, "project": own | shared, "project-only": own, "other-projects": (F.col("project") != project) & ~shared, "fact-ids": F.col("id").isin(ids or [])}
    if kind not in kinds:
        raise ValueError(f"unknown scope: {kind}")
    return kinds[kind]


def search_filters(project: str | None = None, after: str | None = None, before: str | None = None) -> Column:
    """All given bounds hold; dates compare as strings with ISO clocks, so the day ``before`` itself is outside."""
    out = F.lit(True)
    if project is not None:
        out = out & (F.col("project") == project)
    if after is not None:
        out = out & (F.col("timestamp") >= after)
    if before is not None:
        out = out & (F.col("timestamp") <= before)
    return out


def path_within(path: Column, roots: list[str]) -> Column:
    """The path is a root or lies under one; no pattern characters."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def contains_text(column: Column, needle: str) -> Column:
    """Substring in any case; the needle is literal."""
    return F.contains(F.lower(column), F.lit(needle.lower()))


def fresh_lease(state: Column, claimed_at: Column, now: Column, minutes: int = 30) -> Column:
    """Claimed within the last minutes; an unreadable or missing clock is stale."""
    return F.coalesce((state == "claimed") & (F.try_to_timestamp(claimed_at) > now - F.make_dt_interval(mins=F.lit(minutes))), F.lit(False))


def confident(x: Column, least: float = 0.7) -> Column:
    return F.coalesce(x.between(least, 1.0) & ~F.isnan(x), F.lit(False))


def eligible(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first reason against, null if there is none."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in checks), F.lit(None).cast("string"))


def backlog(rows: DataFrame, vectors: DataFrame, key: str, version: int, current: str = "embedding_version") -> DataFrame:
    """Rows whose vector is missing or of another version."""
    have = vectors.where(F.col(current) == version).select(key)
    return rows.join(have, key, "left_anti")


def tolerant_select(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; missing ones are null strings."""
    return df.select(*(F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))


def keyset_after(columns: list[str], values: list) -> Column:
    """Rows after a cursor in ascending order of the columns."""
    return F.struct(*columns) > F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, values)))
