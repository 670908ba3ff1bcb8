"""Before and after extraction: anchor windows, forbidden patterns, rule overrides, report comparison."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_WINDOW = 5
MATCH_CHARS = 8_000


def anchor_windows(rows: DataFrame, session: str, order: list[str], eligible: Column, anchor: Column, size: int = MAX_WINDOW) -> DataFrame:
    """(session, first_pos, last_pos): anchors with one eligible neighbour on each side, merged up to ``size`` rows.

    Windows never reach over an ineligible row. Ranges that touch form islands; islands are dealt out and walked in
    order with one open window, so memory does not grow with a session.
    """
    by = Window.partitionBy(session).orderBy(*order)
    placed = rows.select(F.col(session).alias("session"), F.row_number().over(by).cast("long").alias("pos"), eligible.alias("ok"), anchor.alias("hit"), F.coalesce(F.lag(eligible).over(by), F.lit(False)).alias("left"), F.coalesce(F.lead(eligible).over(by), F.lit(False)).alias("right"))
    ranges = placed.where("ok and hit").select("session", (F.col("pos") - F.col("left").cast("int")).alias("lo"), (F.col("pos") + F.col("right").cast("int")).alias("hi"))
    walk = Window.partitionBy("session").orderBy("lo", "hi")
    new = F.coalesce(F.col("lo") > F.lag("hi").over(walk) + 1, F.lit(True))
    islands = ranges.withColumn("island", F.sum(new.cast("long")).over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    kind = dict(islands.dtypes)["session"]

    def merge(batches: Iterator) -> Iterator:
        import pandas as pd

        key = first = last = None
        for batch in batches:
            out = []
            for s, island, lo, hi in zip(batch["session"], batch["island"], batch["lo"], batch["hi"]):
                if key == (s, island) and max(last, hi) - first + 1 <= size:
                    last = max(last, hi)
                    continue
                if key is not None:
                    out.append((key[0], first, last))
                key, first, last = (s, island), lo, hi
            yield pd.DataFrame(out, columns=["session", "first_pos", "last_pos"])
        if key is not None:
            yield pd.DataFrame([(key[0], first, last)], columns=["session", "first_pos", "last_pos"])

    dealt = islands.repartition("session", "island").sortWithinPartitions("session", "island", "lo", "hi")
    return dealt.mapInPandas(merge, f"session {kind}, first_pos bigint, last_pos bigint").withColumnRenamed("session", session)


def block_set(items: DataFrame, batch: str, fields: dict[str, dict[str, str]], max_chars: int = MATCH_CHARS) -> DataFrame:
    """``items`` with ``state`` (held, blocked, kept) and ``pattern_ids``.

    ``fields`` gives each text column its patterns by id. Every field is matched by itself. A field over ``max_chars``
    cannot be checked, and an unfinished check holds its whole batch.
    """
    too_long = F.greatest(F.lit(0), *(F.coalesce(F.length(c), F.lit(0)) for c in fields)) > max_chars
    held = items.groupBy(batch).agg(F.max(too_long).alias("held"))
    hits = F.array_compact(F.array(*(F.when(F.col(c).rlike(p), F.lit(name)) for c, own in fields.items() for name, p in own.items())))
    state = F.when(F.col("held"), "held").when(F.size("hits") > 0, "blocked").otherwise("kept")
    joined = items.join(held, batch).withColumn("hits", hits)
    return joined.withColumns({"state": state, "pattern_ids": F.when(state == "blocked", F.array_join(F.array_sort(F.array_distinct("hits")), ",")).otherwise("")}).drop("held", "hits")


def resolve_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``requests`` (project, rule_id, …) with the rule's value: the project's own, else the global one (null project)."""
    own = rules.where("project is not null").select("project", "rule_id", F.col("value").alias("own"))
    common = rules.where("project is null").select("rule_id", F.col("value").alias("common"))
    joined = requests.join(own, ["project", "rule_id"], "left").join(common, "rule_id", "left")
    return joined.withColumns({"value": F.coalesce("own", "common"), "origin": F.when(F.col("own").isNotNull(), "project").when(F.col("common").isNotNull(), "global").otherwise("none")}).drop("own", "common")


def compare_reports(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(case_id, change) of two reports (case_id, passed); cases of one report alone are ``incomparable``."""
    a, b = current.select("case_id", F.col("passed").alias("now"), F.lit(True).alias("in_now")), baseline.select("case_id", F.col("passed").alias("was"), F.lit(True).alias("in_was"))
    change = (
        F.when(F.col("in_now").isNull() | F.col("in_was").isNull(), "incomparable").when(F.col("now").isNull() | F.col("was").isNull(), "unjudged")
        .when(~F.col("was") & F.col("now"), "improved").when(F.col("was") & ~F.col("now"), "regressed").when(F.col("now"), "unchanged pass").otherwise("unchanged failure")
    )
    return a.join(b, "case_id", "full").select("case_id", change.alias("change"))
