"""What keeps work in proportion: rows that meet block by block, and figures that SQL rounds once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import blocks, classification, continuity, graph, history, injection, placement, revisions, set_join, text_index, vector_cells


def vectors(spark, x, scope):
    return spark.createDataFrame([(i, scope(i), bool(i % 7), v.tolist()) for i, v in enumerate(x)], "id long, s string, is_active boolean, v array<float>")


@pytest.mark.parametrize("copies", [False, True])
def test_relation_candidates_meet_in_blocks(spark, monkeypatch, copies):
    """No pair is a row of its own: the plan joins no vectors, and blocks of any size give the same."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    if copies:
        x = x[np.arange(300) % 5]
    rows = vectors(spark, x, lambda i: "ab"[i % 2])
    new = rows.where("id % 3 = 0")
    y = x.astype(float)
    score = blocks.products(np.repeat(y, 300, 0), np.tile(y, (300, 1))).reshape(300, 300).round(9)
    want = []
    for i in range(0, 300, 3):
        fit = [j for j in range(300) if j != i and j % 2 == i % 2 and j % 7 and score[i, j] >= 1.0]
        want += [(i, j) for j in sorted(fit, key=lambda j: (-score[i, j], j))[:2]]
    found = classification.relation_candidates(new, rows, ["s"], threshold=1.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "zip_with" not in plan
    assert sorted((r["id"], r["other"]) for r in found.collect()) == sorted(want)
    small = blocks.best_in_scope(new.select(F.col("id").alias("qid"), "s", F.col("v").alias("q")), rows.where("is_active"), ["s"], 2, least=1.0, others=True, block=9, tile=17)
    assert sorted((r["qid"], r["id"]) for r in small.collect()) == sorted(want)


def test_blocks_take_what_no_product_can(spark):
    """Null vectors, holes and other lengths meet none; what is not a number comes first, as SQL orders it."""
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", [1.0, None]), (4, "a", [1.0]), (5, "a", [float("nan"), 1.0]), (6, None, [1.0, 0.0])], "id long, s string, v array<double>")
    asked = spark.createDataFrame([(9, "a", [2.0, 0.0])], "qid long, s string, q array<double>")
    assert [(r["id"], str(r["similarity"])) for r in blocks.best_in_scope(asked, rows, ["s"], 5).orderBy("id").collect()] == [(1, "2.0"), (5, "nan")]
    assert blocks.best_in_scope(asked.limit(0), rows, ["s"], 5).count() == 0


def test_similarity_is_rounded_once(spark):
    """0.4999995 less a little: nine digits first would round the sixth up."""
    x = np.array([1.0, 0.0])
    s = 0.4999994998
    rows = spark.createDataFrame([(1, "p", x.tolist()), (2, "p", [s, float(np.sqrt(1 - s * s))])], "id long, project string, v array<double>")
    got = placement.nearest_in_scope(rows.select("id", "project"), rows.select("id", "v"), ["project"], 0.1)
    assert [r["s"] for r in got.select(F.round("similarity", 6).alias("s")).collect()] == [0.499999, 0.499999]


def test_rows_are_copied_once_a_block(spark):
    """Vectors in random directions reach every cell; what is shuffled hangs on the blocks, not on cells and rings."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    x /= np.sqrt((x**2).sum(1))[:, None]
    rows = spark.createDataFrame([(i, "p", v.tolist()) for i, v in enumerate(x)], "id long, s string, v array<double>")
    found = vector_cells.nearest_within(rows, ["s"], 1.3)
    assert "band" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 1900 and found.agg(F.sum("asked")).first()[0] <= 2000 * 1999


def test_trigram_postings_are_bits(spark, tmp_path):
    """A posting costs a bit of its range's words, not a key; ranges of more than one word find their texts."""
    docs = spark.createDataFrame([(i, f"{'Abc' if i % 50 == 0 else 'xyz'} number {i}") for i in range(200)] + [(999, None)], "doc_id long, text string")
    index = text_index.TrigramIndex.build(docs, "doc_id", "text", str(tmp_path), range_docs=1000, buckets=4)
    assert dict(index.rows(["abc"]).dtypes)["bits"] == "bigint" and "keys" not in index.rows(["abc"]).columns
    assert sorted(r["doc_id"] for r in index.like(text_index.containing("aBC n"), "doc_id").collect()) == [0, 50, 100, 150]


def test_sets_meet_in_blocks(spark):
    """A word that every set holds makes no pairs: only similar ones leave a task, whatever the sizes of blocks and tiles."""
    rng = np.random.default_rng(6)
    sets = [["the", *(f"w{x}" for x in rng.choice(40, rng.integers(1, 8), replace=False))] for _ in range(240)]
    left = spark.createDataFrame([(i, "ab"[i % 2], s) for i, s in enumerate(sets)], "id long, s string, words array<string>")
    right = spark.createDataFrame([(1000 + i, "ab"[i % 2], sets[i % 80]) for i in range(200)], "id long, s string, words array<string>")
    want = {}
    for i, s in enumerate(sets):
        for j in range(200):
            both = len({*s} & {*sets[j % 80]})
            if i % 2 == j % 2 and both / len({*s} | {*sets[j % 80]}) >= 0.5:
                want[i, 1000 + j] = both / len({*s} | {*sets[j % 80]})
    met = set_join.candidates(set_join._named(left, ["s"], "l"), set_join._named(right, ["s"], "r"), 0.5, ["s"])
    assert "CoGroup" in met._jdf.queryExecution().optimizedPlan().toString()
    assert met.count() < len(want) and met.where("score < 0.5 - 1e-9").count() == 0
    for block, tile in ((7, 11), (1000, 1000)):
        got = {(r["left_id"], r["right_id"]): r["score"] for r in set_join.similar_sets(left, right, 0.5, ["s"], block=block, tile=tile).collect()}
        assert got == want
        few = {(r["left_id"], r["right_id"]) for r in set_join.similar_sets(left, right, 0.5, ["s"], k=2, block=block, tile=tile).collect()}
        best = {i: sorted((p for p in want if p[0] == i), key=lambda p: (-want[p], p[1]))[:2] for i in range(240)}
        assert few == {p for ps in best.values() for p in ps}


def test_copies_do_not_meet_copies(spark):
    """A thousand rows of one set on either side give the best two of each, not a million pairs."""
    rows = spark.range(1000).select("id", F.array(F.lit("x"), F.lit("y")).alias("words"))
    got = set_join.similar_sets(rows, rows, 0.3, k=2)
    assert got.count() == 2000 and {r["right_id"] for r in got.select("right_id").distinct().collect()} == {0, 1}


def test_lines_are_cut_before_facts_move(spark):
    """A bundle shows one line of a fact, so its text is not shuffled for each prompt."""
    given = spark.range(3).selectExpr("id as request_id", "id as id", "'semantic' as lane", "1.0 as relevance", "1 as place")
    plan = injection.bundles(given, spark.range(3).selectExpr("id", "repeat('word ', cast(id as int)) as fact"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("regexp_replace") > plan.index("Join")


def test_lines_of_any_white_space(spark):
    texts = [None, "", "a  b", "x" * 400, " " * 3000 + "late \n words", "one " + "\t" * 1500 + "two " * 80, "word " * 500, "y" * 159 + " z", "y" * 160, "a " + "b" * 300, "é " * 79 + "end" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")

    def line(t):
        flat = re.sub(continuity.SPACE, " ", t).strip(" ")
        head = flat[:159]
        whole = head[: head.rindex(" ")] if " " in head else ""
        return flat if len(flat) <= 160 else (whole if len(whole) >= 80 else head) + "…"

    got = {r["id"]: (r["x"], r["y"]) for r in rows.select("id", continuity.clip_line(F.col("t")).alias("x"), continuity.clip_line(continuity.clip_line(F.col("t"))).alias("y")).collect()}
    assert got == {i: (None, None) if t is None else (line(t), line(t)) for i, t in enumerate(texts)}


def test_neighbours_are_seen_before_they_are_shuffled(spark):
    """What a prompt and an edge tell decides who sees a neighbour, on the rows of the walk, not after a join by fact."""
    asked = spark.createDataFrame([(1, 5, True, "p"), (2, 6, True, "q"), (3, 6, False, "p")], "request_id long, session long, trace boolean, project string")
    hits = spark.createDataFrame([(r, 10, 0.9, 0.1, None) for r in (1, 2, 3)], "request_id long, id long, similarity double, baseline double, lexical_score int")
    edges = spark.createDataFrame([(10, n, "SUPPORTS" if n % 2 else "RELATES", n) for n in range(20, 30)], "source_id long, target_id long, relation_type string, created_at long")
    links = graph.both_ways(edges).withColumn("_of", F.when(F.col("to") < 26, "p").otherwise("q"))
    seen = []

    def visible(rows):
        seen.extend(rows.columns)
        return rows.where(F.col("_of") == F.col("project"))

    none = spark.createDataFrame([], "session long, id long, current boolean")
    got = injection.inject(asked, hits, links, visible, none)
    assert {"project", "_of", "session", "id"} <= {*seen}
    want = {(r, 10, "semantic") for r in (1, 2, 3)} | {(1, n, "related") for n in (21, 23, 25)} | {(2, n, "related") for n in (26, 27, 29)}
    assert {(r["request_id"], r["id"], r["lane"]) for r in got.collect()} == want


def test_signatures_come_from_the_beginning_of_a_text(spark):
    """Cut or whole, the same signature: what crosses the cut, what shrinks, and white space of any length."""
    rng = np.random.default_rng(9)
    parts = ["word", "2024-01-02 03:04:05.6z", "/usr/lib/x.py", "0xdeadbeef", "123.5", "deadbeef1", "\x1b[31m", "\n\n", " ", "12345678-1234-1234-1234-123456789abc", "t", " ", "Ünï", "7", "-", "/"]
    texts = ["".join(parts[j] + " " * int(rng.integers(0, 2)) for j in rng.integers(0, len(parts), n)) for n in rng.integers(1, 400, 300)]
    texts += ["7 " * 900, "a" * 3000, " " * 900 + "b c" * 300, "x" * (history.HEAD_CHARS - 12) + " 2024-01-02 03:04 end" * 9, "/a/b" * 900 + " z" * 300, "1 " * 299 + "2024-01-02 03:04:05 " * 90]
    rows = spark.createDataFrame(list(enumerate([None, "", *texts])), "id long, t string")

    def whole(t):
        s = F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), history.ANSI, ""))
        for pattern, name in history.SIGNATURE:
            s = F.regexp_replace(s, pattern.replace("\\b", history.WORD_EDGE), name)
        return F.substring(F.trim(F.regexp_replace(s, f"{history.WHITE}+", " ")), 1, history.SIGNATURE_CHARS)

    assert rows.where(history.signature(F.col("t")) != whole(F.col("t"))).count() == 0


def test_patterns_meet_texts_where_they_lie(spark):
    """No shuffle of texts by word, and a text hands on its best few only."""
    known = spark.createDataFrame([(f"k{i:02}", f"same few words here number{i % 2}", i, i) for i in range(30)], "key string, text string, episodes long, last_at long")
    probes = spark.createDataFrame([(i, "same few words here number1") for i in range(50)], "probe_id long, text string")
    found = revisions.match_patterns(known, probes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    got = {(r["probe_id"], r["place"]): (r["key"], r["score"]) for r in found.collect()}
    assert got == {(p, n + 1): (f"k{29 - 2 * n:02}", 1.0) for p in range(50) for n in range(5)}
    few = revisions.resembling(probes.withColumn("words", F.split("text", " ")), [(f"k{i}", None, ["same", "few", "words", "here", f"number{i % 2}"]) for i in range(30)], 0.5, 5)
    assert few.count() == 250


def test_edges_are_laid_out_by_one_shuffle(spark, monkeypatch):
    """Hubs go to the edges: no plan of the build sorts or shuffles edges to learn of hubs, and they are found once."""
    plans, settle = [], graph.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(graph, "settled", seen)
    rows = spark.createDataFrame([(i % 7, 1000 + i, "SUPPORTS", i) for i in range(900)], "source_id long, target_id long, relation_type string, created_at long")
    laid = graph.adjacency(rows, hub_edges=50)
    assert not any("SortMergeJoin" in p for p in plans) and plans[-1].count("Exchange hashpartitioning") == 1
    assert laid.count() == 1800 and {r["_parts"] for r in graph.hubs(laid).collect()} == {3}
