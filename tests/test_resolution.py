"""Scopes, slots, audits, evidence and injection on small tables."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import audit, classification, injection, requests, resolution, revisions

ASKED = "request_id long, scope string, project string, project_id string, workspace_id string, workstream_id string, session_id string"


def test_scopes_resolve_or_say_why_not(spark):
    places = spark.createDataFrame([("s1", "t1", "w1", "p1", "/a", 1), ("s2", "t2", "w2", "p2", "/b", 2), ("s3", "t2", "w3", "p2", "/b", 3)], "session_id string, workstream_id string, workspace_id string, project_id string, path string, seen long").withColumn("seen_at", F.timestamp_seconds("seen"))
    cases = [
        ((None, "/a", None, None, None, None), ("project-id", "p1", None)), ((None, "/nowhere", None, None, None, None), ("fact-ids", None, None)), ((None, None, None, None, None, None), (None, None, "project is required")),
        (("project", "/a", "p1", None, None, None), (None, None, "project_id or path, not both")), (("project", None, "p9", None, None, None), (None, None, "unknown project_id")), (("project", None, "p1", "w2", None, None), (None, None, "workspace_id is outside project_id")),
        (("global", None, None, None, None, None), ("global", None, None)), (("all", None, "p1", None, None, None), (None, None, "scope cannot be combined with an identity")), (("session", "/a", None, None, None, "s1"), (None, None, "a path cannot be combined with this scope")),
        (("session", None, None, None, None, "s1"), ("session-id", "p1", None)), (("session", None, "p2", None, None, "s1"), (None, None, "session_id is outside project_id")), (("session", None, None, None, None, "zz"), (None, None, "unknown session_id")),
        (("workstream", None, None, None, "t1", "s2"), (None, None, "session_id is outside workstream_id")), (("workspace", None, None, "w1", "t1", "s1"), ("workspace-id", "p1", None)), (("team", None, None, None, None, None), (None, None, "unknown scope")),
    ]
    got = resolution.resolve_scopes(spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], ASKED), places).orderBy("request_id").collect()
    assert [(r["type"], r["project_id"], r["problem"]) for r in got] == [c[1] for c in cases]


def test_slots_on_save(spark):
    schema = "candidate_id long, slot string, text string, effective_at long, authority string"
    held = spark.createDataFrame([("a", "f1", "old", 10, "human")], "slot string, id string, text string, effective_at long, authority string")
    rows = [(1, "a", "old", 99, "unknown"), (2, "a", "x", 11, "decision"), (3, "a", "x", 11, "unknown"), (4, "a", "x", 9, "decision"), (5, "a", "x", 10, "decision"), (6, "b", "first", 1, "human"), (7, "b", "first", 2, "human"), (8, "b", "other", 3, "human")]
    got = {r["candidate_id"]: r["outcome"] for r in resolution.save_facts(spark.createDataFrame(rows, schema), held, ["slot"]).collect()}
    assert got == {1: "merge", 2: "change", 3: "contradicted", 4: "historical", 5: "contradicted", 6: "new", 7: "merge", 8: "change"}


def test_index_states_and_moves(spark):
    archives = spark.createDataFrame([(1, 5, True), (2, 5, False), (3, 5, True), (4, 5, True)], "k long, modified long, readable boolean")
    index = spark.createDataFrame([(1, 5), (2, 9), (4, 4), (5, 1)], "k long, indexed_at long")
    assert {r["k"]: r["state"] for r in audit.verify_index(archives, index, "k").collect()} == {1: "current", 2: "corrupted", 3: "missing", 4: "outdated", 5: "orphaned"}
    rows = spark.createDataFrame([(1, "/a", "/a"), (2, "x", "/a"), (3, "x", None), (4, "x", "rel/a"), (5, None, " /a ")], "id long, project string, cwd string")
    assert {r["id"]: (r["outcome"], r["to"]) for r in audit.migration_plan(rows, F.trim("cwd")).collect()} == {1: ("canonical", None), 2: ("move", "/a"), 3: ("no cwd", None), 4: ("relative cwd", None), 5: ("move", "/a")}


def test_results_within_five_rows(spark):
    rows = [(1, n, k, i) for n, (k, i) in enumerate([("call", "a"), ("call", "b"), ("out", "b"), ("say", ""), ("say", ""), ("say", ""), ("out", "a"), ("out", "b")])]
    df = spark.createDataFrame(rows, "o long, n long, kind string, i string")
    got = {r["n"]: r["result"] for r in audit.with_results(df, "o", "n", F.col("kind") == "call", F.col("kind") == "out", F.col("i"), F.concat("i", F.col("n").cast("string"))).collect()}
    assert got == dict.fromkeys(range(8)) | {1: "b2"}


def test_evaluation_of_nothing_has_no_ratios(spark):
    empty = spark.createDataFrame([], "case_id long, tags array<string>, passed boolean, expected long, matched long, observed long, failed boolean")
    r = audit.evaluation(empty).first()
    assert r["case_count"] == 0 and r["recall"] is None and r["precision"] is None and r["ratification"] is None


def test_observations_need_evidence(spark):
    candidates = spark.createDataFrame([(i, kind, "a summary", conf, sig, flag) for i, (kind, conf, sig, flag) in enumerate([("incident", 0.9, "boom at x", False), ("incident", 0.9, "made up", True), ("incident", 0.9, None, False), ("validated", 0.9, None, False), ("validated", 0.5, None, False), ("remark", 0.9, None, False), ("validated", 0.9, None, False)])], "candidate_id long, observation string, summary string, confidence double, signature_text string, repeat_flag boolean")
    evidence = spark.createDataFrame([(0, 1, "tool", "test_execution", 1, "boom at"), (1, 1, "human", "repeated_signal", 2, "it fails again"), (2, 1, "human", "repeated_signal", 2, "it fails again"), (3, 1, "tool", "test_execution", 3, "all passed"), (4, 1, "tool", "test_execution", 3, "all passed"), (5, 1, "tool", "test_execution", 3, "all passed"), (6, 1, "tool", "test_execution", 1, "boom at")], "candidate_id long, n int, source string, kind string, ref long, span string")
    texts = spark.createDataFrame([(1, "boom at x.py", True, True), (2, "it fails again", True, False), (3, "all passed", True, False)], "ref long, body string, learnable boolean, is_error boolean")
    got = {r["candidate_id"]: (r["signature"], r["problem"]) for r in classification.check_observations(candidates, evidence, texts).collect()}
    assert got == {0: ("boom at x", None), 1: ("it fails again", None), 2: (None, "unproven"), 3: (None, None), 4: (None, "confidence"), 5: (None, "kind"), 6: (None, "not passed")}


def test_injection_tells_what_is_new(spark):
    asked = spark.createDataFrame([(1, "s", True)], "request_id long, session string, trace boolean")
    hits = spark.createDataFrame([(1, 10, 0.9, 0.8, None), (1, 11, 0.82, 0.8, None), (1, 12, 0.1, 0.8, 2), (1, 13, 0.95, 0.8, None)], "request_id long, id long, similarity double, baseline double, lexical_score int")
    edges = spark.createDataFrame([(10, 20, "SUPPORTS", 1), (10, 21, "CONTRADICTS", 1), (10, 22, "SUPPORTS", 1), (12, 10, "SUPPORTS", 1)], "source_id long, target_id long, relation_type string, created_at long")
    visible = spark.createDataFrame([("s", i) for i in (10, 11, 12, 13, 20, 21)], "session string, id long")
    residents = spark.createDataFrame([("s", 13, True), ("s", 30, False)], "session string, id long, current boolean")
    got = injection.inject(asked, hits, edges, lambda rows: rows.join(visible, ["session", "id"], "left_semi"), residents).orderBy("place")
    assert [(r["id"], r["lane"], r["relevance"]) for r in got.collect()] == [(30, "correction", 1.0), (12, "lexical", 0.1), (10, "semantic", 0.9), (20, "related", 1.0), (21, "related", 0.7)]
    assert injection.receipts(got).first()["n"] == 5


@pytest.mark.parametrize(("text", "before", "want"), [("why?", True, False), ("go ahead", False, False), ("go ahead", True, True), ("/clear", True, False), ("Caveat: x", True, False), ("use tabs", False, True), ("  ", True, False)])
def test_anchors(spark, text, before, want):
    r = spark.createDataFrame([(text, before)], "t string, b boolean").select(injection.candidate_anchor(F.col("t"), F.lit(False), F.col("b"))).first()
    assert r[0] == want


def test_pattern_matches_are_ordered(spark):
    known = spark.createDataFrame([("k1", "timeout in <path> while reading", 2, 5), ("k2", "timeout in <path> while writing", 9, 4), ("k3", "other words entirely", 1, 6)], "key string, text string, episodes long, last_at long")
    probe = spark.createDataFrame([(1, "timeout in <path> while reading")], "probe_id long, text string")
    got = [(r["key"], r["score"]) for r in revisions.match_patterns(known, probe).orderBy("place").collect()]
    assert got[0] == ("k1", 1.0) and got[1][0] == "k2" and 0.5 <= got[1][1] < 1


@pytest.mark.parametrize("wrong", [{"query": "a"}, {"query": " a "}, {"query": "x" * 10_001}, {"query": ("one",)}, {"query": ("ab",) * 6}, {"query": "ab", "limit": 0}, {"query": "ab", "limit": 51}, {"query": "ab", "mode": "all"}, {"query": "ab", "after": "2024-1-1"}, {"query": "ab", "ids": {"project_id": "short"}}, {"query": "ab", "limit": True}])
def test_bounds_of_requests(wrong):
    with pytest.raises(ValueError):
        requests.Search(**wrong)


def test_a_bounded_search(spark):
    rows = spark.createDataFrame([(1, "p", "2024-01-02T00:00:00.000Z", "red fox jumps"), (2, "p", "2024-01-02T00:00:00.000Z", "red red car"), (3, "q", "2024-01-02T00:00:00.000Z", "red fox"), (4, "p", "2024-01-09T00:00:00.000Z", "fox")], "id long, project string, timestamp string, user_message string")
    got = requests.search_text(rows, requests.Search("red fox", project="p", before="2024-01-05", ids={"session_id": "abcd"}))
    assert [r["id"] for r in got.collect()] == [1, 2]
    with pytest.raises(ValueError):
        requests.explore(rows, rows, hops=4)


def test_read_tools_check_what_they_are_asked_for(spark):
    edges = spark.createDataFrame([(1, 2, "SUPPORTS", 1), (2, 3, "RELATES", 2), (3, 4, "SUPPORTS", 3)], "source_id long, target_id long, relation_type string, created_at long")
    assert [(r["id"], r["hop"]) for r in requests.trace_fact(edges, 1).collect()] == [(2, 1), (3, 2)]
    placed = spark.createDataFrame([("d", "c", f"f{i}") for i in range(4)] + [("d", "x", "g")], "domain string, category string, fact string")
    assert [(r["fact"], r["n_facts"]) for r in requests.search_ontology(placed, category="c", limit=2).orderBy("fact").collect()] == [("f0", 4), ("f1", 4)]
    said = spark.createDataFrame([("s", 1, 3), ("s", 4, 9), ("t", 1, 2)], "session_id string, line_start long, line_end long")
    assert [r["line_start"] for r in requests.read_exchanges(said, "s", 2, 4).collect()] == [1, 4]
    facts = spark.createDataFrame([(1, "use tabs", True), (2, "use spaces", True), (3, "old tabs", False)], "id long, fact string, is_active boolean")
    far = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.0)], "id long, distance double")
    assert [(r["id"], r["lane"]) for r in requests.search_facts(facts, far, F.lit(True), "tabs").collect()] == [(1, "both"), (2, "semantic")]
    assert [r["line_start"] for r in requests.timeline(said, ["session_id", "line_start"], ["s", 1], 1).collect()] == [4, 1]
    for bad in (lambda: requests.trace_fact(edges, 1, hops=4), lambda: requests.search_ontology(placed, limit=0), lambda: requests.read_exchanges(said, "s", 5, 4), lambda: requests.search_facts(facts, far, F.lit(True), "x"), lambda: requests.timeline(said, ["line_start"], limit=51)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("text", "want"), [("use that", True), ("그 방식으로 하자", True), ("from now on run the linter over every file that was changed since the last release of it", True), ("why?", False), ("go ahead", True), ("I like tabs", False), ("tabs please", True), ("/clear", False), ("  ", False), (None, False), ("우리 탭", False), ("이걸 봐", True)])
def test_turns_that_need_older_context(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(injection.needs_referent(F.col("t"))).first()[0] == want
