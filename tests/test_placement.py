"""Facts in scopes, identifiers and replay-safe ledgers, on small tables."""

import math
import random

from pyspark.sql import functions as F

from threadloom.operators import lanes, ledger, placement, revisions, vector_cells


def test_tiles_lose_no_neighbour(spark):
    rng = random.Random(5)
    rows = [(i, "p" if i % 3 else "q", [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(90)]
    rows += [(200, "alone", [0.0] * 6)]
    facts = spark.createDataFrame([r[:2] for r in rows], "id long, project string")
    vectors = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, v array<double>")

    def brute(i, project, v):
        others = [(round(1 - sum((a - b) ** 2 for a, b in zip(v, w)) / 2, 9), -j) for j, p, w in rows if p == project and j != i]
        return max(others, default=None)

    want = {(r[0], -b[1]) for r in rows if (b := brute(*r)) and b[0] >= 0.2}
    got = placement.nearest_in_scope(facts, vectors, ["project"], 0.2).collect()
    assert {(r["id"], r["nearest"]) for r in got} == want
    tiled = vector_cells.nearest_within(facts.join(vectors, "id"), ["project"], math.sqrt(1.6), tile=7).collect()
    assert {(r["id"], r["nearest"]) for r in tiled} == want


def test_identifier_shapes(spark):
    cases = {"see src/app/main.py now": ["src/app/main.py", "main.py"], "call run()": ["run"], "MAX_ROWS and max_rows": ["MAX_ROWS", "max_rows"], "useState here": ["useState"], "plain words": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: (list(r["i"]), r["n"]) for r in df.select("t", lanes.identifiers(F.col("t")).alias("i"), lanes.names_exactly(F.col("t")).alias("n")).collect()}
    for text, shapes in cases.items():
        assert got[text] == (shapes, bool(shapes))


def test_hashed_words_beyond_the_basic_plane(spark):
    token = "\U0001d41a\U0001d41b"  # two letters, four UTF-16 units
    h = 2166136261
    raw = token.encode("utf-16-le")
    for at in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[at : at + 2], "little")) * 16777619) & 0xFFFFFFFF
    df = spark.createDataFrame([(1, token), (2, ""), (3, None)], "id long, t string")
    got = {(r["id"], r["bucket"]) for r in lanes.hashed_words(df, "id", "t").collect()}
    assert got == {(1, h % 384), (1, (h >> 8) % 384)}


def test_consolidation_is_a_set_of_decisions(spark):
    facts = spark.createDataFrame([(1, True, 2, ["a"]), (2, True, 5, ["b", "a"]), (3, True, 0, ["c"]), (4, True, 1, [])], "id long, is_active boolean, confirmations long, sources array<string>")
    verdicts = spark.createDataFrame([(1, 2, "DUPLICATE"), (1, 3, "DUPLICATE"), (4, 1, "EVOLUTION")], "survivor long, other long, relation string")
    got = {r["id"]: (r["is_active"], r["confirmations"], list(r["sources"])) for r in placement.consolidate(facts, verdicts).collect()}
    assert got == {1: (True, 4, ["a", "b", "c"]), 2: (False, 5, ["a", "b"]), 3: (False, 0, ["c"]), 4: (False, 1, [])}


def test_error_class_and_nulls(spark):
    rows = [(None, None, None, "unknown"), ("config", 400, "x", "config"), (None, 503, None, "transient"), (None, None, "retry after 400 ms", "unknown"), (None, None, "Status: 422", "deterministic"), (None, None, "Rate limit", "transient")]
    df = spark.createDataFrame(rows, "code string, status int, message string, want string")
    for r in df.select("want", ledger.error_class(F.col("code"), F.col("status"), F.col("message")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, c string, at long")
    assert revisions.reconcile(none, none, ["id"], "c").count() == 0
    assert ledger.starvation(none, "id", ["at"], "c").count() == 0
    assert lanes.spread(none, "id", ["at"], 3).count() == 0
    assert ledger.coalesced(none, "id", "at", F.col("at"), F.col("c") == "x").count() == 0
