"""Ledgers of work: jobs, targets, fences, failed ranges, skips, receipts; and joins that keep them sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORCE_AFTER = 3
BOUNDARIES, BYTES = 6, 8_192

# What a provider's message tells about a failed call.
DETERMINISTIC = r"too (large|long)|prompt is too long|context length|maximum.*token|max_?tokens|content.*too|invalid[_ ]?request|bad request|unprocessable"
TRANSIENT = r"unauthor|forbidden|invalid.*(api.?key|access.?token|credential)|timeout|etimedout|econnreset|econnrefused|enotfound|epipe|socket hang up|network|fetch failed|stream (disconnect|closed|ended|aborted)|premature close|overloaded|temporarily|rate.?limit|too many requests|internal server error|server error|service unavailable|bad gateway|gateway timeout"
NAMED_STATUS = r"status(?:\s*code)?\s*[:=]?\s*([0-9]{3})(?![A-Za-z0-9_])"
PREFIXED_STATUS = r"(?<![A-Za-z0-9_])(?:api|http|request|response|server)\s+(?:error|failure|code)\s*[:=-]?\s*([0-9]{3})(?![A-Za-z0-9_])"


def outbox(jobs: DataFrame, key: list[str], target: str) -> DataFrame:
    """(key, n, target, conflict): a job is kept once for its key; another target under the same key is a conflict."""
    per = jobs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(target).alias(target), F.max(target).alias("_most"))
    return per.select(*key, "n", target, (F.col(target) != F.col("_most")).alias("conflict"))


def may_complete(state: Column, owner: Column, me: Column, generation: Column, held: Column, expires: Column, now: Column) -> Column:
    """A worker may complete what it runs under its own unexpired lease of the same generation."""
    return F.coalesce((state == "running") & (owner == me) & (generation == held) & (expires > now), F.lit(False))


def superseded(jobs: DataFrame, targets: DataFrame, key: str, generation: str) -> DataFrame:
    """Jobs whose target has gone on to another generation, with the one to requeue for."""
    now = targets.select(key, F.col(generation).alias("now"))
    return jobs.join(now, key).where(F.col(generation) != F.col("now"))


def coalesced(checkpoints: DataFrame, partition: str, order: str, size: Column, boundary: Column) -> DataFrame:
    """(partition, boundaries, bytes, due): what has gathered since the partition's last boundary.

    Two aggregates instead of a running sum: sums are combined before the shuffle, so a hot partition does not gather.
    """
    last = checkpoints.where(boundary).groupBy(partition).agg(F.max(order).alias("_last"))
    since = checkpoints.join(last, partition, "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last")))
    sums = since.groupBy(partition).agg(F.count(F.lit(1)).alias("boundaries"), F.sum(F.greatest(size, F.lit(0))).alias("bytes"))
    return sums.withColumn("due", (F.col("boundaries") >= BOUNDARIES) | (F.col("bytes") >= BYTES))


def starvation(skips: DataFrame, lane: str, order: list[str], reason: str) -> DataFrame:
    """``skips`` with ``total`` (skips in a row for the same reason), ``consecutive`` (since the last forced run) and
    ``forced`` (every third)."""
    w = Window.partitionBy(lane).orderBy(*order)
    new = F.coalesce((F.lag(reason).over(w) != F.col(reason)).cast("long"), F.lit(1).cast("long"))
    runs = skips.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(lane, "_run").orderBy(*order)).cast("long")
    return runs.withColumn("total", at).withColumn("consecutive", (F.col("total") - 1) % FORCE_AFTER + 1).withColumn("forced", F.col("total") % FORCE_AFTER == 0).drop("_run")


def gap_report(markers: DataFrame, kind: str, at: str, key: str, now: Column, days: int = 30) -> DataFrame:
    """(kind, n, oldest): whole counts of each class among markers younger than ``days``."""
    kept = markers.where(F.col(at) > now - F.expr(f"INTERVAL {days} DAYS"))
    return kept.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(at, key))[key].alias("oldest"))


def monotone(rows: DataFrame, key: str, progress: list[str]) -> DataFrame:
    """(key, accepted progress, ignored): the furthest state of each key; how many rows did not reach it."""
    best = F.max(F.struct(*progress)).alias("b")
    return rows.groupBy(key).agg(best, F.count(F.lit(1)).alias("n"), F.count_distinct(*progress).alias("d")).select(key, *(F.col(f"b.{c}").alias(c) for c in progress), (F.col("n") - 1).alias("ignored"))


def fence(rows: DataFrame, processed: DataFrame, key: list[str], position: str, limit_at: DataFrame, owner: str) -> DataFrame:
    """Rows up to the owner's fixed position that no page has processed yet; later rows belong to a later target."""
    fixed = limit_at.select(owner, F.col(position).alias("_fence"))
    return rows.join(fixed, owner).where(F.col(position) <= F.col("_fence")).join(processed.select(*key), key, "left_anti").drop("_fence")


def page_current(page: DataFrame, now: DataFrame, page_id: str, key: str, generation: str) -> DataFrame:
    """(page, n, current, commit): a page commits only if every item of it still has its generation."""
    have = now.select(key, F.col(generation).alias("_now"))
    per = page.join(have, key, "left").groupBy(page_id).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(generation) == F.col("_now")).alias("current"))
    return per.withColumn("commit", F.col("n") == F.col("current"))


def failed_ranges(ranges: DataFrame, owner: str) -> DataFrame:
    """(owner, failed, recovered, dismissed, open_items) from rows with a state and a first and last position."""
    width = F.col("last_pos") - F.col("first_pos") + 1
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return ranges.groupBy(owner).agg(n("failed"), n("recovered"), n("dismissed"), F.sum(F.when(F.col("state") == "failed", width).otherwise(0)).alias("open_items"))


def error_class(code: Column, status: Column, message: Column) -> Column:
    """config, deterministic, transient or unknown: codes, then a status, then one that the message labels as a status or
    puts after an error word, then phrases; a bare number says nothing."""
    low = F.lower(F.coalesce(message, F.lit("")))
    by = lambda s: F.when(s.isin(401, 403, 404, 429) | (s >= 500), "transient").when(s.isin(400, 413, 422), "deterministic").otherwise("unknown")
    number = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).cast("int")
    named = F.coalesce(number(NAMED_STATUS), number(PREFIXED_STATUS))
    return (
        F.when(code == "config", "config").when(code.isin("input-limit", "output-limit", "output-schema"), "deterministic")
        .when(status.isNotNull(), by(status)).when(named.isNotNull(), by(named))
        .when(low.rlike(DETERMINISTIC), "deterministic").when(low.rlike(TRANSIENT), "transient").otherwise("unknown")
    )


def receipts(rows: DataFrame, key: str) -> DataFrame:
    """(key, status, first_at): prepared only ever goes on to emitted."""
    return rows.groupBy(key).agg(F.when(F.bool_or(F.col("status") == "emitted"), "emitted").otherwise("prepared").alias("status"), F.min("created_at").alias("first_at"))


def orphans(children: DataFrame, parents: DataFrame, key: str, code: str) -> DataFrame:
    """(code, id) of children without an active parent."""
    return children.join(parents.where("is_active").select(F.col("id").alias(key)), key, "left_anti").select(F.lit(code).alias("code"), F.col(key).alias("id"))


def all_sources_resolve(rows: DataFrame, key: str, sources: str, known: DataFrame, source: str) -> DataFrame:
    """(key, n_sources, missing, repairable): a row can be repaired if each source it cites is known."""
    cited = rows.select(key, F.explode_outer(sources).alias(source)).join(known.select(source, F.lit(1).alias("_here")), source, "left")
    per = cited.groupBy(key).agg(F.count(source).alias("n_sources"), F.count_if(F.col(source).isNotNull() & F.col("_here").isNull()).alias("missing"))
    return per.withColumn("repairable", F.col("missing") == 0)


def remediate(occurrences: DataFrame, fixes: DataFrame, key: list[str]) -> DataFrame:
    """(key, closed, still_open): a fix closes what happened at or before it; a signature's last fix counts."""
    last = fixes.groupBy(*key).agg(F.max("fixed_at").alias("fixed_at"))
    shut = F.coalesce(F.col("at") <= F.col("fixed_at"), F.lit(False))
    return occurrences.join(last, key, "left").groupBy(*key).agg(F.count_if(shut).alias("closed"), F.count_if(~shut).alias("still_open"))


def capped(items: DataFrame, owner: str, order: list[str], text: str, most: int = 8, chars: int = 500) -> DataFrame:
    """(owner, kept, dropped, clamped): at most ``most`` items each, texts over ``chars`` cut."""
    placed = items.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    kept = F.col("_n") <= most
    return placed.groupBy(owner).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_if(kept & (F.length(text) > chars)).alias("clamped"), F.sum(F.when(kept, F.least(F.length(text), F.lit(chars))).otherwise(0)).alias("chars"))
