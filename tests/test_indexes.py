"""Stored indexes, set joins, ordered pairs, walks and the prompt matcher against plain computations."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import gate, gate_tables, graph, lanes, placement, retrieval, revisions, set_join
from threadloom.operators.storage import numbered
from threadloom.operators.text_index import TrigramIndex, WordIndex, containing, literal_pieces
from threadloom.operators.vector_cells import CellIndex, nearest_within

WORDS = ["alpha", "beta", "gamma", "delta", "rare", "x1", "the"]


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    texts = {i: " ".join(rng.choices(WORDS, weights=[8, 6, 4, 2, 0.05, 1, 20], k=rng.randint(0, 60))) for i in range(n)}
    texts[7], texts[8] = None, "100% sure_thing 7_b"
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def words_of(spark, texts, tmp_path_factory):
    """An index in two builds: the second half was added later."""
    built = []
    for half in (0, 1):
        docs = spark.createDataFrame([(i, t) for i, t in texts.items() if i % 2 == half], "doc_id long, text string")
        built.append(WordIndex.build(docs, "doc_id", "text", str(tmp_path_factory.mktemp("words")), range_docs=32, buckets=8))
    return built[0].add(built[1])


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.mark.parametrize("asked", [["alpha", "rare"], ["the"], ["absent", "rare"], ["absent"], ["alpha", "beta", "gamma", "delta"]])
@pytest.mark.parametrize("all_words", [False, True])
def test_word_index_gives_what_the_scan_gives(spark, texts, words_of, asked, all_words):
    want = {r["doc_id"]: round(r["score"], 6) for r in retrieval.bm25(frame(spark, texts), "doc_id", "text", asked, all_words).collect()}
    got = {r["doc_id"]: r["score"] for r in words_of.bm25(asked, "doc_id", all_words).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    for k in (1, 10, 5000):
        best, read = words_of.top(asked, k, "doc_id", all_words)
        rows = [(r["doc_id"], r["score"]) for r in best.collect()]
        assert rows == sorted(got.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert read["read"] <= read["rows"]


def test_block_maxima_skip_ranges(spark, texts, words_of):
    best, read = words_of.top(["rare", "the"], 3, "doc_id")
    print("rows read of", read)
    assert read["read"] < 0.6 * read["rows"]


def test_ladder_over_the_index(spark, texts, words_of):
    asked = ["alpha", "delta", "x1"]
    want = retrieval.ladder(frame(spark, texts), "doc_id", "text", asked, 30)
    got = retrieval.ladder_of(words_of.hits(asked, "doc_id"), "doc_id", asked, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("needle", ["rare", "a the", "100% sure", "_thing", "7_b", "%", "b", "a ", "absent", "İ", "RARE"])
def test_trigram_index_finds_substrings(spark, texts, trigrams_of, needle):
    want = {i for i, t in texts.items() if t is not None and needle.lower() in t.lower()}
    assert {r["doc_id"] for r in trigrams_of.like(containing(needle), "doc_id").collect()} == want


@pytest.mark.parametrize("pattern", ["%rare%alpha%", "alpha_beta%", "%x1", "%a_a%", "%\\%%", "%"])
def test_trigram_index_takes_wildcards(spark, texts, trigrams_of, pattern):
    want = {r["doc_id"] for r in frame(spark, texts).where(F.lower("text").like(pattern)).collect()}
    assert {r["doc_id"] for r in trigrams_of.like(pattern, "doc_id").collect()} == want


@pytest.fixture(scope="module")
def trigrams_of(spark, texts, tmp_path_factory):
    return TrigramIndex.build(frame(spark, texts), "doc_id", "text", str(tmp_path_factory.mktemp("grams")), range_docs=64, buckets=16)


def test_pieces_of_patterns():
    assert literal_pieces("a%b_c\\%d\\\\") == ["a", "b", "c%d\\"] and containing("a_b%") == "%a\\_b\\%%"


# --- vectors ---


def clustered(n=1200, d=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, d))
    v[5] = v[6] = v[7]  # ties
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    v = clustered()
    rows = spark.createDataFrame([(i, x.tolist(), i % 50) for i, x in enumerate(v)] + [(9999, None, 0)], "id long, v array<double>, label int")
    return v, CellIndex.build(rows, "id", "v", str(tmp_path_factory.mktemp("cells")))


@pytest.mark.parametrize("k", [1, 7, 2000])
@pytest.mark.parametrize("rare", [False, True])
def test_cells_are_exact(spark, cells, k, rare):
    v, index = cells
    for q in (v[7], v[100] * 0.5, np.zeros(8)):
        found, read = index.knn(q.tolist(), k, F.col("label") == 3 if rare else None)
        d = np.sqrt(((v - q) ** 2).sum(1))
        ids = [i for i in range(len(v)) if not rare or i % 50 == 3]
        want = sorted(ids, key=lambda i: (round(d[i], 12), i))[:k]
        got = [(r["id"], r["distance"]) for r in found.collect()]
        assert [round(x, 9) for _, x in got] == [round(d[i], 9) for i in want] and len({i for i, _ in got}) == len(got)
    assert read["rows"] == len(v)


def test_cells_prune(cells):
    v, index = cells
    read = index.knn(v[3].tolist(), 5)[1]
    print("distances computed", read)
    assert read["computed"] < 0.5 * read["rows"]


@pytest.mark.parametrize("reach", [0.05, 0.4, 2.5])
def test_nearest_within_reach(spark, reach):
    v = clustered(400)
    rows = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)], "id long, s string, v array<double>")
    got = {r["id"]: (r["nearest"], round(r["distance_sq"], 8)) for r in nearest_within(rows, ["s"], reach, tile=50).collect()}
    want, asked = {}, 0
    for i in range(400):
        sq = {j: round(float(((v[i] - v[j]) ** 2).sum()) / 2, 9) * 2 for j in range(i % 2, 400, 2) if j != i}
        j = min(sq, key=lambda j: (sq[j], j))
        if sq[j] <= reach**2 + 1e-9:
            want[i] = (j, round(sq[j], 8))
    assert got.keys() == want.keys()
    assert all(abs(got[i][1] - want[i][1]) < 1e-7 for i in want)
    if reach == 0.05:
        pairs = nearest_within(rows, ["s"], reach).agg(F.sum("asked")).first()[0] or 0
        print("pairs computed", pairs, "of", 400 * 199)
        assert pairs < 0.5 * 400 * 199


def test_threshold_is_a_radius(spark):
    v = np.eye(3)
    v = np.vstack([v, [0.96, math.sqrt(1 - 0.96**2), 0]])
    facts = spark.createDataFrame([(i, "p") for i in range(4)], "id long, project string")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = placement.nearest_in_scope(facts, vectors, ["project"], 0.95).collect()
    assert sorted((r["id"], r["nearest"], round(r["similarity"], 6)) for r in got) == [(0, 3, 0.96), (3, 0, 0.96)]


def test_top_in_scope(spark):
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(40, 4)).round(1), rng.normal(size=(300, 4)).round(1)
    asked = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(q)], "qid long, scope string, q array<double>")
    facts = spark.createDataFrame([(i, "abc"[i % 3], x.tolist()) for i, x in enumerate(v)], "id long, scope string, v array<double>")
    got = sorted((r["qid"], r["id"]) for r in lanes.top_in_scope(asked, facts, 3, block=7, tile=20).collect())
    score = (q @ v.T).round(9)
    want = sorted((i, j) for i in range(40) for j in sorted((j for j in range(300) if j % 3 == i % 2), key=lambda j: (-score[i, j], j))[:3])
    assert got == want


# --- sets, pairs, walks ---


def test_similar_sets_loses_no_pair(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    left = [(i, "ab"[i % 2], rng.sample(words, rng.randint(0, 9))) for i in range(160)] + [(900, "a", None), (901, "a", ["w1", None, "w1"]), (902, "a", ["w1"])]
    right = [(i, "ab"[i % 3 % 2], rng.sample(words, rng.randint(0, 9))) for i in range(120)] + [(903, "a", ["w1"])]
    frames = [spark.createDataFrame(x, "id long, s string, words array<string>") for x in (left, right)]
    for least in (0.3, 0.5, 0.8, 1.0):
        want = {}
        for (i, s, a), (j, t, b) in itertools.product(left, right):
            a, b = {x for x in a or () if x}, {x for x in b or () if x}
            if s == t and a and b and len(a & b) / len(a | b) >= least - 1e-12:
                want[i, j] = round(len(a & b) / len(a | b), 9)
        got = {(r["left_id"], r["right_id"]): round(r["score"], 9) for r in set_join.similar_sets(*frames, least, ["s"]).collect()}
        assert got == want
        a, b = set_join._named(frames[0], ["s"], "l"), set_join._named(frames[1], ["s"], "r")
        print("similarity", least, "candidates", set_join.candidates(a, b, least, ["s"]).count(), "of", 163 * 121)


def test_ordered_pairs_of_a_hot_turn(spark):
    """One turn of a million calls: n log n, where pairs would be 5 * 10^11."""
    n, kinds = 1_000_000, 4
    rows = spark.range(n).select(F.lit(1).alias("turn"), (F.col("id") % kinds).cast("string").alias("tool"), (F.floor(F.col("id") / 2)).alias("at"))
    got = {(r["first"], r["then"]): r["n"] for r in set_join.ordered_pairs(rows, ["turn"], "tool", "at").collect()}
    want, before = collections.Counter(), collections.Counter()
    for at in range(n // 2):
        now = [str((2 * at + i) % kinds) for i in (0, 1)]
        for b in now:
            for a in before:
                want[a, b] += before[a]
        before.update(now)
    assert got == dict(want)


def test_ordered_pairs_with_ties_and_nulls(spark):
    rows = [(1, "a", 1), (1, "b", 1), (1, "a", 2), (2, "a", 5), (2, "c", None), (None, "a", 1), (None, "b", 2)]
    got = {(r["first"], r["then"]): r["n"] for r in set_join.ordered_pairs(spark.createDataFrame(rows, "g long, k string, at long"), ["g"], "k", "at").collect()}
    assert got == {("a", "a"): 1, ("b", "a"): 1}


def test_walks_over_hubs_do_not_shuffle_edges(spark):
    rng = random.Random(8)
    edges = {(0, i) for i in range(1, 300)} | {(rng.randrange(300), rng.randrange(300, 600)) for _ in range(500)}
    rows = spark.createDataFrame([(a, b, rng.choice(["SUPPORTS", "RELATES"]), 1) for a, b in sorted(edges)], "source_id long, target_id long, relation_type string, created_at long")
    laid = graph.adjacency(rows, hub_edges=40)
    assert graph.hubs(laid).where("id = 0").first()["_parts"] == 8
    seeds = spark.createDataFrame([(5,), (310,)], "id long")
    got = {r["id"]: r["hop"] for r in graph.expand(laid, seeds, 3).collect()}
    ways = collections.defaultdict(set)
    kind = {(r["source_id"], r["target_id"]): r["relation_type"] for r in rows.collect()}
    for (a, b), k in kind.items():
        ways[a].add((b, k))
        ways[b].add((a, k))
    want, seen, front = {}, {5, 310}, {5, 310}
    for hop in range(3):
        factor = 0.6**hop
        near = {b for a in front for b, k in ways[a] if factor * (1.0 if k == "SUPPORTS" else 0.7) >= 0.2} - seen
        want |= dict.fromkeys(near, hop + 1)
        seen |= near
        front = near
    assert got == want
    sent = laid.select("from", "_part").distinct().repartition(max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "from", "_part")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = laid.join(sent, ["from", "_part"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ENSURE_REQUIREMENTS" not in plan.split("Sort [from")[1]


# --- prompts, signatures, numbers ---


def test_bits_of_prompts_are_the_patterns_that_fit(spark):
    prompts = ["Why did it fail?", "whyever", "WHAT DID WE decide", "history_x prehistory", "ok, thanks!", "계속해줘", "또  그 문제", "no, the other one", "", "  roll back　", "pre-why-post", "ſource source", "decide.", "왜 그랬지"]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i long, prompt string")
    read = gate.read_prompts(table, "prompt").withColumn("a", gate.explain(gate.ReadPrompt("_p"))).withColumn("b", gate.explain(F.col("prompt")))
    read = read.withColumn("c", gate.intents(gate.ReadPrompt("_p"))).withColumn("d", gate.intents(F.col("prompt")))
    for r in read.collect():
        assert r["a"] == r["b"] and r["c"] == r["d"], r["prompt"]
    assert len(gate.BIT) == len(set(gate.PATTERNS.values())) and len(gate.PATTERNS) == sum(map(len, (gate_tables.MEMORY, gate_tables.TRACE, gate_tables.HIGH_IMPACT, gate_tables.ACKNOWLEDGEMENT, gate_tables.CONTINUATION, gate_tables.MINOR_CORRECTION)))


def test_signatures_inside_texts(spark):
    texts = spark.createDataFrame([(1, "abc def"), (2, "bc"), (3, None), (4, "")], "probe_id long, text string")
    got = sorted((r["probe_id"], r["key"]) for r in revisions.holding(texts, [("bc", "k1"), ("bc", "k2"), ("c d", "k3")]).collect())
    assert got == [(1, "k1"), (1, "k2"), (1, "k3"), (2, "k1"), (2, "k2")]
    assert revisions.holding(texts, []).collect() == []


def test_numbers_without_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id")).repartition(7)
    got = [(r["id"], r["number"]) for r in numbered(rows, ["id"], "number").collect()]
    assert sorted(got) == [(i, i) for i in range(1000)]
    assert numbered(spark.range(0), ["id"], "number").collect() == []


def test_patterns_without_case():
    assert all(re.fullmatch(r"[^A-Z]*", p.replace("\\b", "").replace("\\s", "")) for terms in gate.BY_TERM.values() for _, p in terms)


def test_walks_take_nodes_in_the_order_of_a_queue(spark):
    """Against a queue: outgoing before incoming, contradictions first, older first; the first way that clears the floor."""
    rng = random.Random(21)
    kinds = ["SUPPORTS", "CONTRADICTS", "SUPERSEDES", "INFLUENCES", "RELATES"]
    edges = sorted({(rng.randrange(40), rng.randrange(40), rng.choice(kinds), rng.randrange(5)) for _ in range(160)} - {(i, i, k, t) for i in range(40) for k in kinds for t in range(5)})
    rank = lambda k: graph.PRIORITY.get(k, 3)
    seeds = [3, 8]
    visited, front, want = set(seeds), sorted(seeds), {}
    for hop in range(3):
        nxt = []
        for node in front:
            for side in (0, 1):
                rows = sorted((rank(k), t, k, *((b,) if side == 0 else (a,))) for a, b, k, t in edges if (a, b)[side] == node)
                groups = {}
                for p, t, k, other in rows:
                    if other not in visited:
                        groups.setdefault(other, []).append((p, t, k))
                order = sorted(groups, key=lambda o: (groups[o][0][0], groups[o][0][1], o))
                for other in order:
                    relevance = [(0.6**hop * (1.0 if k in graph.AFFIRMATIVE else 0.7), k) for _, _, k in groups[other]]
                    if chosen := next(((r, k) for r, k in relevance if r >= 0.2), None):
                        visited.add(other)
                        nxt.append(other)
                        want[other] = (hop + 1, round(chosen[0], 9), chosen[1], node)
        front = nxt
    rows = spark.createDataFrame(edges, "source_id long, target_id long, relation_type string, created_at long")
    got = {r["id"]: (r["hop"], round(r["relevance"], 9), r["relation_type"], r["via"]) for r in graph.expand(rows, spark.createDataFrame([(s,) for s in seeds], "id long"), 3).collect()}
    assert got == want
