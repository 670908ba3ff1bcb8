"""Bounded walks over typed edges, and the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.storage import settled

DECAY, FLOOR = 0.6, 0.2
# Relation types that carry relevance whole, and the share that all others carry.
AFFIRMATIVE, OTHER_WEIGHT = ("SUPPORTS", "INFLUENCES"), 0.7
PRIORITY = {"CONTRADICTS": 0, "SUPERSEDES": 1, "SUPPORTS": 2}


def both_ways(edges: DataFrame) -> DataFrame:
    """(from, to, relation_type, created_at, outward) of every edge seen from either end."""
    out = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), "relation_type", "created_at", F.lit(True).alias("outward"))
    return out.unionByName(edges.select(F.col("target_id").alias("from"), F.col("source_id").alias("to"), "relation_type", "created_at", F.lit(False).alias("outward")))


def priority():
    out = F.lit(len(PRIORITY))
    for name, p in PRIORITY.items():
        out = F.when(F.col("relation_type") == name, p).otherwise(out)
    return out


def expand(edges: DataFrame, seeds: DataFrame, hops: int, visible: DataFrame | None = None) -> DataFrame:
    """(id, hop, relevance, relation_type, via) of what lies within ``hops`` of the seeds (column id).

    Relevance is 0.6 to the zero-based hop, times 0.7 over edges that neither support nor influence; what falls under
    0.2 is left out. A hop takes its nodes one after the other, the seeds by id; each node's outgoing edges come before
    its incoming ones, contradictions before superseding, supporting and other edges, older before newer. The first node
    that reaches a neighbour keeps it, over the first edge that clears the floor; in that order neighbours are next. Only
    ``visible`` nodes are entered. An order is the path that leads to a node, so no hop is numbered in one task.
    ``edges`` may be an ``adjacency``; edges are shuffled once, when it is built, and hops only move the frontier.
    """
    links = edges if "_part" in edges.columns else adjacency(edges)
    parts = max(1, links.sparkSession.sparkContext.defaultParallelism, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    start = seeds.select("id").distinct()
    visited = start
    kinds = dict(links.dtypes)
    step_of = lambda side, p, at, node: F.struct(side.cast("int").alias("side"), p.cast("int").alias("p"), at.cast(kinds["created_at"]).alias("at"), node.cast(kinds["from"]).alias("node"))
    zero = F.lit(0)
    frontier, found = start.join(hubs(links), "id", "left").select("id", F.coalesce("_parts", F.lit(1)).alias("_parts"), F.array(step_of(zero, zero, F.lit(None), F.col("id"))).alias("_path")), None
    for hop in range(hops):
        if DECAY**hop < FLOOR:
            break
        factor = F.when(F.col("relation_type").isin(*AFFIRMATIVE), 1.0).otherwise(OTHER_WEIGHT)
        # A frontier node is sent to every part of its edges; they lie where the build has put them.
        sent = frontier.select(F.col("id").alias("from"), "_path", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).repartition(parts, "from", "_part")
        near = links.join(sent, ["from", "_part"]).withColumn("relevance", F.lit(DECAY**hop) * factor)
        near = near.join(visited.withColumnRenamed("id", "to"), "to", "left_anti")
        if visible is not None:
            near = near.join(visible.select(F.col("id").alias("to")), "to", "left_semi")
        # The edges of one side between two nodes lie in one part: the first of them ranks the neighbour, the first over
        # the floor is shown. Then each neighbour keeps the earliest way; combined before the shuffle and kept.
        row = F.struct(priority().alias("p"), F.col("created_at").alias("at"), "relation_type", "relevance")
        side = F.when(F.col("outward"), 0).otherwise(1)
        between = near.groupBy("from", "_part", side.alias("side"), "to").agg(F.first("_path").alias("_path"), F.first("_to_parts").alias("_parts"), F.min(row).alias("first"), F.min(F.when(F.col("relevance") >= FLOOR, row)).alias("e")).where("e is not null")
        way = F.struct("_path", step_of(F.col("side"), F.col("first.p"), F.col("first.at"), F.col("to")).alias("last"), "e", "from", "_parts")
        best = between.groupBy(F.col("to").alias("id")).agg(F.min(way).alias("w"))
        step = settled(best.select("id", F.lit(hop + 1).alias("hop"), "w.e.relevance", "w.e.relation_type", F.col("w.from").alias("via"), "w._parts", F.concat("w._path", F.array("w.last")).alias("_path")))
        found = step if found is None else found.unionByName(step)
        frontier = step.select("id", "_parts", "_path")
        visited = visited.union(step.select("id"))
    return found.drop("_parts", "_path") if found is not None else None


HUB_EDGES = 10_000


def adjacency(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``both_ways`` of the edges, laid out by node once and kept: hash-partitioned by (from, _part), a node with over
    ``hub_edges`` edges in several parts. ``_parts`` and ``_to_parts`` tell how many parts either end has."""
    spark = edges.sparkSession
    links = both_ways(settled(edges.select("source_id", "target_id", "relation_type", "created_at")))
    # There is a hub for ``hub_edges`` edges at most, so hubs go to the edges and not the edges to hubs.
    size = settled(links.groupBy(F.col("from").alias("id")).agg(F.ceil(F.count(F.lit(1)) / hub_edges).cast("int").alias("_n")).where("_n > 1"))
    own, other = (F.broadcast(size.withColumnsRenamed({"id": end, "_n": n})) for end, n in (("from", "_parts"), ("to", "_to_parts")))
    laid = links.join(own, "from", "left").join(other, "to", "left").withColumns({"_parts": F.coalesce("_parts", F.lit(1)), "_to_parts": F.coalesce("_to_parts", F.lit(1))})
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = laid.withColumn("_part", F.pmod(F.xxhash64("to"), F.col("_parts")).cast("int"))
    # A checkpoint of an adaptive plan forgets how its rows are partitioned, and joins would shuffle them again.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settled(rows.repartition(parts, "from", "_part"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def hubs(links: DataFrame) -> DataFrame:
    """(id, _parts) of the nodes whose edges lie in several parts."""
    return links.where("_parts > 1").select(F.col("from").alias("id"), "_parts").distinct()


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def crossing(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """Edges whose ends belong to different groups: what a guard must refuse."""
    a = nodes.select(F.col("id").alias("source_id"), F.col(group).alias("source_group"))
    b = nodes.select(F.col("id").alias("target_id"), F.col(group).alias("target_group"))
    return edges.join(a, "source_id").join(b, "target_id").where("source_group <> target_group")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes (id, category, domain) by category and domain, edges between them by type."""
    by = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by(nodes, "category", "category").unionByName(by(nodes, "domain", "domain")).unionByName(by(inside(edges, nodes), "relation", "relation_type"))


def edge_per_neighbour(edges: DataFrame) -> DataFrame:
    """(node, neighbour, relation_type): the one edge that is shown of all between two nodes, seen from either end:
    contradictions first, then superseding, supporting, others, then the oldest. A minimum, so it combines early."""
    links = both_ways(edges).withColumn("p", priority())
    best = links.groupBy(F.col("from").alias("node"), F.col("to").alias("neighbour")).agg(F.min(F.struct("p", "created_at", "relation_type")).alias("b"))
    return best.select("node", "neighbour", "b.relation_type")


def taxonomy(placed: DataFrame) -> DataFrame:
    """(domain, category, n_facts, fact): a row for each fact (domain, category, fact) under its branch. Counts are joined
    on, so no category is gathered anywhere."""
    counts = placed.groupBy("domain", "category").agg(F.count(F.lit(1)).alias("n_facts"))
    return placed.join(counts, ["domain", "category"]).select("domain", "category", "n_facts", "fact")
