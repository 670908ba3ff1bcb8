"""URL filters: fixed prefix rules, and association rules mined by FP-growth.

A URL's tokens (host labels, host, path words, query names) form a transaction with the page's label. Spark's FP-growth
finds frequent combinations; rules that lead to a label are kept if support (a share of the labelled pages, and never
fewer than ``MIN_ROWS`` of them, however small the table) and confidence reach their limits and no shorter rule with
the same label is as sure. Pages match rules through an inverted index: a rule stands under the
token of its that fewest pages hold, and what meets there is checked for the other tokens. The surest rule decides.

Null URLs and URLs without ``://`` have empty host and path; no prefix rule fits them. Rows with null labels teach
nothing; without labels no rule is mined and the verdict is ``allow``. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed rules: (host, path, verdict).
PREFIX_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT = 0.002
MIN_ROWS = 50
MIN_CONFIDENCE = 0.6
BROADCAST_RULES = 50_000
LABEL = "label="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the prefix rules see them."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def prefix_rule(host: Column, path: Column, rules=PREFIX_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest prefix rule that fits, both null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(((host == h) | host.endswith(f".{h}")) & path.startswith(p), f"{h}{p}", v) for h, p, v in ordered]
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name, _ in fits)), F.coalesce(*(F.when(c, F.lit(v)) for c, _, v in fits))


def url_tokens(url: Column) -> Column:
    """Distinct tokens; numbers are all one token."""
    host, path = url_parts(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"^\d+$", "#")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), F.lower(x)))
    tokens = F.concat(F.array(F.concat(F.lit("site:"), host)), labels, words, names)
    return F.array_distinct(F.filter(tokens, lambda x: ~x.rlike(r"^\w+:$")))


def document_of(url: Column) -> Column:
    """The number of the document that a page shows: the last number of its path (null if there is none)."""
    return F.regexp_extract(url_parts(url)[1], r"(\d+)\D*$", 1).try_cast("bigint")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """(tokens, verdict, confidence, lift, support) from rows with ``url`` and ``verdict`` (block, allow or null)."""
    basket = labelled.where(F.col("verdict").isNotNull() & F.col("url").isNotNull()).select(F.concat(url_tokens(F.col("url")), F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    basket = basket.cache()
    # Half a row less, so that rounding never asks for one row more.
    share = max(min_support, (min_rows - 0.5) / max(1, basket.count()))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, share), minConfidence=min_confidence).fit(basket)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.regexp_replace(F.element_at("consequent", 1), f"^{LABEL}", "").alias("verdict"), "confidence", "lift", "support")
    short = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    sub = (F.col("verdict") == F.col("v")) & (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))
    one = short.withColumn("token", F.element_at("part", 1))
    covered = rules.withColumn("token", F.explode("tokens")).join(one, "token").where(sub).select("tokens", "verdict").distinct()
    return rules.join(covered, ["tokens", "verdict"], "left_anti")


def match_rules(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, mined verdict, confidence, tokens) of the surest rule that fits each page; pages without one are left out."""
    tokens = pages.select(key, url_tokens(F.col("url")).alias("page_tokens"))
    frequency = rules.select(F.explode("tokens").alias("token")).distinct().join(tokens.select(F.explode("page_tokens").alias("token")), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posting = rules.withColumn("token", F.explode("tokens")).join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    index = posting.groupBy("tokens", "verdict", "confidence").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = tokens.withColumn("token", F.explode("page_tokens")).join(index, "token").where(F.size(F.array_except("tokens", "page_tokens")) == 0)
    best = F.max(F.struct("confidence", F.size("tokens").alias("n"), "verdict", "tokens"))
    return met.groupBy(key).agg(best.alias("best")).select(key, F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"), F.col("best.tokens").alias("tokens"))


def judge_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) per page.

    A page's label is that of the document whose number its path holds: low quality or toxic means block.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(bad).alias("bad")).select(F.col("doc_id").cast("long").alias("document"), F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rules = mine_rules(own.withColumn("document", document_of(F.col("url"))).join(known, "document")).cache()
    host, path = url_parts(F.col("url"))
    rule, verdict = prefix_rule(F.col("host"), F.col("path"))
    parts = own.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "fixed": verdict})
    if rules.isEmpty():
        return parts.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.lit("allow")).alias("verdict"), F.lit(None).cast("array<string>").alias("mined_rule"))
    urls = own.select("url").distinct().where("url is not null")
    mined = match_rules(urls, rules, "url")
    return parts.join(mined, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit("allow")).alias("verdict"), F.col("tokens").alias("mined_rule"))
