"""What callers may ask for: bounds of arguments, checked before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import graph, lanes, retrieval, scope

# Bounds of what a caller may state.
QUERY_CHARS, CONCEPTS, LIMIT, HOPS = (2, 10_000), (2, 5), (1, 50), (1, 3)
PROJECT_ID, STREAM_ID, DAY = re.compile(r"[A-Za-z0-9_-]{8,128}"), re.compile(r"[A-Za-z0-9_-]{4,128}"), re.compile(r"\d{4}-\d{2}-\d{2}")
MODES = ("vector", "text", "both")


def within(name: str, value: int, bounds: tuple[int, int]) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must be a whole number from {bounds[0]} to {bounds[1]}: {value!r}")
    return value


def _shaped(name: str, value: str | None, shape: re.Pattern) -> None:
    if value is not None and not shape.fullmatch(value):
        raise ValueError(f"{name} is malformed: {value!r}")


@dataclass(frozen=True)
class Search:
    """A search as a caller states it: one query, or two to five concepts that must meet."""

    query: str | tuple[str, ...]
    mode: str = "both"
    limit: int = 10
    project: str | None = None
    after: str | None = None
    before: str | None = None
    ids: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        texts = (self.query,) if isinstance(self.query, str) else tuple(self.query)
        if not isinstance(self.query, str):
            within("concepts", len(texts), CONCEPTS)
        for text in texts:
            within("query length", len(text.strip()), QUERY_CHARS)
        within("limit", self.limit, LIMIT)
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}: {self.mode!r}")
        for name, day in (("after", self.after), ("before", self.before)):
            _shaped(name, day, DAY)
        for name, value in self.ids.items():
            _shaped(name, value, PROJECT_ID if name in ("project_id", "workspace_id") else STREAM_ID)


def search_text(exchanges: DataFrame, request: Search, key: str = "id", text: str = "user_message") -> DataFrame:
    """(key, score) of the exchanges that a text search finds, best first."""
    if not isinstance(request.query, str):
        raise ValueError("a text search takes one query")
    kept = exchanges.where(scope.search_filters(request.project, request.after, request.before))
    words = retrieval.query_tokens(request.query)
    return retrieval.bm25(kept, key, text, words).select(key, "score").orderBy(F.desc("score"), key).limit(request.limit)


def search_concepts(vectors: DataFrame, request: Search, probes: list[list[float]], key: str, v: str, group: str) -> DataFrame:
    """Groups that hold a near row of every concept; ``probes`` are the concepts' vectors."""
    within("concepts", len(probes), CONCEPTS)
    return lanes.concepts_together(vectors, key, v, group, probes, request.limit)


def explore(edges: DataFrame, seeds: DataFrame, hops: int = 1, visible: DataFrame | None = None) -> DataFrame:
    """A bounded walk over one to three hops."""
    return graph.expand(edges, seeds, within("hops", hops, HOPS), visible)


DEFAULT_LIMIT, DEFAULT_HOPS = 10, 2


def search_facts(facts: DataFrame, distances: DataFrame, visible, query: str = "", words: list[str] | None = None, threshold: float = 0.0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(id, lane, lexical_score, similarity): facts in scope by words, by vectors, or both (``distances``: id, distance)."""
    within("limit", limit, LIMIT)
    if query:
        within("query length", len(query.strip()), QUERY_CHARS)
    named = lanes.lexical(facts, "fact", query, words or [], visible, limit) if query or words else facts.limit(0).select("id", F.lit(0).alias("lexical_score"))
    return lanes.combined(named, lanes.scoped_knn(facts, distances, visible, threshold, limit).select("id", "distance"), limit)


def search_ontology(placed: DataFrame, domain: str | None = None, category: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The taxonomy (see ``graph.taxonomy``), whole branches by name; ``limit`` facts of each, first by name."""
    within("limit", limit, LIMIT)
    kept = placed.where(F.lit(True) if domain is None else F.col("domain") == domain).where(F.lit(True) if category is None else F.col("category") == category)
    first = F.row_number().over(Window.partitionBy("domain", "category").orderBy("fact"))
    return graph.taxonomy(kept).withColumn("_n", first).where(F.col("_n") <= limit).drop("_n")


def read_exchanges(exchanges: DataFrame, session: str, first: int = 1, last: int | None = None) -> DataFrame:
    """A session's exchanges whose lines lie between two line numbers, in order."""
    if first < 1 or last is not None and last < first:
        raise ValueError(f"lines run from 1 on, forward: {first} to {last}")
    kept = exchanges.where((F.col("session_id").cast("string") == str(session)) & (F.col("line_end") >= first))
    return (kept if last is None else kept.where(F.col("line_start") <= last)).orderBy("line_start")


def trace_fact(edges: DataFrame, fact, hops: int = DEFAULT_HOPS, limit: int = LIMIT[1], visible: DataFrame | None = None) -> DataFrame:
    """What a fact hangs together with, nearest and most relevant first."""
    within("limit", limit, LIMIT)
    seed = edges.where((F.col("source_id") == fact) | (F.col("target_id") == fact)).select(F.lit(fact).cast(dict(edges.dtypes)["source_id"]).alias("id")).limit(1)
    return explore(edges, seed, hops, visible).orderBy("hop", F.desc("relevance"), "id").limit(limit)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by category, domain and relation type."""
    return graph.stats(nodes, edges)


def timeline(events: DataFrame, order: list[str], after: list | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A page of ``limit`` rows behind the row that ``after`` names, and one more that tells whether there is a next."""
    within("limit", limit, LIMIT)
    kept = events if after is None else events.where(scope.keyset_after(order, after))
    return kept.orderBy(*order).limit(limit + 1)
