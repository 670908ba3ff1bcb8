"""The two-clock history of facts, incidents, and replica merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import let

WHITE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
AUTHORITY = {"decision": 3, "human": 2, "tool": 2}


def authority_rank(kind: Column) -> Column:
    out = F.lit(1)
    for name, rank in AUTHORITY.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def verdict(has_prior: Column, newer: Column, older: Column, rank: Column, prior_rank: Column) -> Column:
    """What competing evidence does to a slot."""
    return (
        F.when(~has_prior, "apply")
        .when(newer & (rank >= prior_rank), "apply")
        .when(newer, "contradicted")
        .when(older, "historical")
        .otherwise("contradicted")
    )


def encode_cursor(effective_at: Column, recorded_at: Column, seq: Column) -> Column:
    """A timeline cursor: base64url, without padding, of its JSON."""
    plain = F.base64(F.encode(F.to_json(F.struct(effective_at.alias("effective_at"), recorded_at.alias("recorded_at"), seq.alias("seq"))), "UTF-8"))
    return F.regexp_replace(F.translate(plain, "+/", "-_"), r"[=\r\n]+", "")


def decode_cursor(cursor: Column) -> Column:
    """(effective_at, recorded_at, seq) of a cursor; null if it is none."""
    raw = F.translate(cursor, "-_", "+/")
    padded = F.rpad(raw, F.length(raw) + F.pmod(-F.length(raw), F.lit(4)), F.lit("="))
    got = F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), "effective_at string, recorded_at string, seq bigint")
    return F.when(got["effective_at"].isNotNull() & got["recorded_at"].isNotNull() & got["seq"].isNotNull(), got)


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key by these clocks, as one aggregate (no window, so a hot key is combined early)."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("e")).select(key, *(F.col(f"e.{c}").alias(c) for c in columns))


# What a signature forgets, in this order, and what stands for it; ``\\b`` is the edge of an ASCII word.
SIGNATURE = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(z|[+-][0-9]{2}:?[0-9]{2})?", "<time>"),
    (r"(?:/[A-Za-z0-9_.-]+){2,}", "<path>"),
    (r"0x[0-9a-f]+", "<hex>"),
    (r"\b[0-9a-f]{7,}\b", "<hex>"),
    (r"[0-9]+(\.[0-9]+)?", "<n>"),
)
ANSI = r"\x1b\[[0-9;]*m"
SIGNATURE_CHARS = 240


HEAD_CHARS = 600  # of a text, which its signature is made of; over ``SIGNATURE_CHARS``


def signature(text: Column) -> Column:
    """Text of an incident without what differs from run to run: colours, ids, clocks, paths, addresses, numbers.

    A signature is the beginning of that, so it comes from the beginning of the text unless little is left of it. No
    pattern crosses white space but a clock, after a digit: before other white space a text can be cut.
    """

    def normal(s):
        for pattern, name in SIGNATURE:
            s = F.regexp_replace(s, pattern.replace("\\b", WORD_EDGE), name)
        return F.trim(F.regexp_replace(s, f"{WHITE}+", " "))

    def cut(s):
        head = F.regexp_extract(F.substring(s, 1, HEAD_CHARS), r"(?s)^(.*[^0-9\s])\s", 1)
        return let(normal(head), lambda near: F.when((F.length(s) > HEAD_CHARS) & (F.length(near) >= SIGNATURE_CHARS), near).otherwise(normal(s)))

    return F.substring(let(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), ANSI, "")), cut), 1, SIGNATURE_CHARS)


def signature_key(text: Column) -> Column:
    return F.substring(F.sha2(signature(text), 256), 1, 24)


def episodes(events: DataFrame, key: list[str], ts: str, gap_seconds: int = 1800) -> DataFrame:
    """(key, episode, started, ended, retries): events of a key at most ``gap_seconds`` apart are one episode."""
    w = Window.partitionBy(*key).orderBy(ts, "event_id")
    before = F.lag(ts).over(w)
    # Clocks are compared in microseconds; a gap of exactly the limit still joins.
    new = F.when(before.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = events.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w))
    return numbered.groupBy(*key, "episode").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("retries"))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def merge_facts(replicas: DataFrame) -> DataFrame:
    """One row per id from the replicas' rows: meaning by its latest clock (then text), activation by its own (a tie
    goes to inactive), lineage by union and maximum. The order of replicas does not matter."""
    return replicas.groupBy("id").agg(
        F.max(F.struct("meaning_clock", "fact"))["fact"].alias("fact"),
        F.max("meaning_clock").alias("meaning_clock"),
        (~F.max(F.struct("active_clock", (~F.col("is_active")).alias("off")))["off"]).alias("is_active"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.max("confirmations").alias("confirmations"),
    )


def merge_tombstones(tombs: DataFrame) -> DataFrame:
    """The newest deletion of each id; privacy prevails as the reason once any replica states it."""
    return tombs.groupBy("id").agg(F.max("deleted_at").alias("deleted_at"), F.when(F.bool_or(F.col("reason") == "privacy"), "privacy").otherwise(F.max(F.struct("deleted_at", "reason"))["reason"]).alias("reason"))


def strict(rows: DataFrame, key: str, sound: Column) -> DataFrame:
    """(key, n_rows) of the generations whose rows are all sound; a test without an answer refuses like a false one."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("valid")).where("valid").drop("valid")


def manifest(files: DataFrame, name: str, line: str) -> DataFrame:
    """Row count and content hash of each file: lines' hashes are sorted within 4,096 ranges of hashes (their first three
    digits), each range is hashed, then the ranges' hashes; no task holds all lines of a file."""
    hashed = files.select(F.col(name), F.md5(line).alias("h"))
    ranges = hashed.groupBy(name, F.substring("h", 1, 3).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("r"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "r"))), lambda x: x["r"]), "")
    return ranges.groupBy(name).agg(F.sum("n").alias("n_rows"), F.sha2(whole, 256).alias("sha256"))
