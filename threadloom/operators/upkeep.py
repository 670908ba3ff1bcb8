"""Session state, imports, purges, bounded projections and repairs: what keeps an archive in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How prompts begin that no person wrote.
INTERNAL = ("<environment_context>", "<user_instructions>", "# AGENTS.md")


def internal_context(text: Column) -> Column:
    out = F.lit(False)
    for prefix in INTERNAL:
        out = out | F.ltrim(text).startswith(prefix)
    return F.coalesce(out, F.lit(False))


def is_subthread(parent: Column, source: Column) -> Column:
    """A thread with a parent, or whose source says so."""
    return F.coalesce(F.trim(parent) != "", F.lit(False)) | F.coalesce(source.rlike("(?i)sub-?agent|sub-?thread"), F.lit(False))


def ensure_sessions(seen: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """(key, project, last_seen, created): known sessions keep their project, new ones take the one they are seen in."""
    s = state.select(key, F.col("project").alias("_project"), F.col("last_seen").alias("_last"), F.lit(True).alias("_known"))
    both = seen.join(s, key, "full")
    return both.select(key, F.coalesce("_project", "project").alias("project"), F.greatest("last_seen", "_last").alias("last_seen"), F.col("_known").isNull().alias("created"))


def common_identity(sources: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns): what all sources of a fact agree in, else null; minimum and maximum tell, no sets are gathered."""
    agg = [F.when(F.count(F.lit(1)) == F.count(c), F.when(F.min(c) == F.max(c), F.min(c))).alias(c) for c in columns]
    return sources.groupBy(key).agg(*agg)


def purge_sources(events: DataFrame, purged: DataFrame, key: str, sources: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(events that cite a purged source, the others)."""
    cited = events.select(key, F.explode(sources).alias(source)).join(purged.select(source), source, "left_semi").select(key).distinct()
    return events.join(cited, key, "left_semi"), events.join(cited, key, "left_anti")


def import_events(incoming: DataFrame, tombs: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    """(key, project) of events that no tombstone names, in the local project of their portable key; unknown ones stay out."""
    local = projects.where("portable_key is not null").groupBy("portable_key").agg(F.min("project").alias("project"))
    return incoming.join(tombs.select(key), key, "left_anti").join(local, "portable_key").select(key, "project")


def capsule(evidence: DataFrame, owner: str, kind: str, order: list[str], text: str, most: int = 8, chars: int = 500) -> DataFrame:
    """(owner, kind, n, latest, items): each kind's newest items, bounded in number and length before they are gathered."""
    w = Window.partitionBy(owner, kind).orderBy(*(F.desc(c) for c in order))
    kept = evidence.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    folded = kept.groupBy(owner, kind).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_n", F.substring(text, 1, chars).alias("t")))).alias("i"))
    return folded.select(owner, kind, "n", F.element_at("i", 1)["t"].alias("latest"), F.array_join(F.transform("i", lambda x: x["t"]), "|").alias("items"))


def claimable(state: Column, claimed_at: Column, now: Column, watermark: Column, last: Column, minutes: int = 30) -> Column:
    """Unclaimed, or claimed under a stale lease; and with something after the watermark."""
    stale = ~F.coalesce(claimed_at > now - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))
    return ((state != "claimed") | stale) & (last > F.coalesce(watermark, F.lit(-1)))


def failure_kind(error_class: Column, handed_over: Column, provider: Column) -> tuple[Column, Column]:
    """(kind, does it use up the budget?)."""
    kind = F.when(handed_over, "handoff").when(error_class == "config", "config").when(provider & (error_class == "deterministic"), "provider_deterministic").when(provider, "provider_transient").otherwise("internal")
    return kind, kind.isin("provider_deterministic", "internal")
