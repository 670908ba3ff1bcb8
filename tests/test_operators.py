"""Semantics that the given tables do not show: traps, permutations, streams, files."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import continuity, extraction, gate, graph, history, identity, lanes, ledger, retrieval, scope
from threadloom.sources import transcripts
from threadloom.streaming import windows


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_two_similarities_over_one_distance(spark):
    d = F.lit(0.5)
    r = spark.range(1).select(retrieval.conversation_similarity(d).alias("a"), retrieval.fact_similarity(d).alias("b")).first()
    assert (r["a"], r["b"]) == (0.5, 0.875)


def test_before_excludes_its_day(spark):
    df = spark.createDataFrame([("p", "2024-01-05T00:00:01.000Z"), ("p", "2024-01-04T23:59:59.999Z")], "project string, timestamp string")
    assert df.where(scope.search_filters(before="2024-01-05")).count() == 1


def test_first_hop_has_full_relevance(spark):
    edges = spark.createDataFrame([(1, 2, "SUPPORTS", 1), (1, 3, "CONTRADICTS", 1), (2, 4, "SUPPORTS", 1), (4, 1, "SUPPORTS", 0), (1, 2, "CONTRADICTS", 9)], "source_id long, target_id long, relation_type string, created_at long")
    got = {r["id"]: (r["hop"], round(r["relevance"], 3), r["relation_type"]) for r in graph.expand(edges, spark.createDataFrame([(1,)], "id long"), 3).collect()}
    assert got == {2: (1, 0.7, "CONTRADICTS"), 3: (1, 0.7, "CONTRADICTS"), 4: (1, 1.0, "SUPPORTS")}
    hidden = graph.expand(edges, spark.createDataFrame([(1,)], "id long"), 2, spark.createDataFrame([(2,)], "id long"))
    assert [r["id"] for r in hidden.collect()] == [2]


def test_merge_does_not_depend_on_order(spark):
    rows = [("f", "old", 1, 5, True, ["a"], 2), ("f", "new", 3, 5, False, ["b"], 1), ("f", "mid", 2, 4, True, ["c", "a"], 7)]
    seen = {str(history.merge_facts(spark.createDataFrame(list(p), "id string, fact string, meaning_clock long, active_clock long, is_active boolean, sources array<string>, confirmations long")).collect()) for p in itertools.permutations(rows)}
    assert len(seen) == 1 and "fact='new'" in next(iter(seen)) and "is_active=False" in next(iter(seen))


def test_episode_gap_of_exactly_the_limit_joins(spark):
    df = spark.createDataFrame([(1, "k", "2024-01-01 00:00:00"), (2, "k", "2024-01-01 00:30:00"), (3, "k", "2024-01-01 01:00:01")], "event_id long, k string, t string").select("event_id", "k", F.to_timestamp("t").alias("ts"))
    assert [r["retries"] for r in history.episodes(df, ["k"], "ts").orderBy("episode").collect()] == [2, 1]


def test_signature_forgets_what_varies(spark):
    texts = ["Error at 2024-01-02T03:04:05Z in /usr/lib/x.py line 12", "error at 2025-11-12T13:14:15Z  in /opt/app/y.py line 9"]
    a, b = (one(spark, history.signature_key(F.col("t")), t=t) for t in texts)
    assert a == b and len(a) == 24


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("failed at 0x1f after 1.5s", "failed at <hex> after <n>s"), ("\x1b[31mBad\x1b[0m commit deadbee on 2024-01-02 03:04", "bad commit <hex> on <time>"), ("2024-01-02T03:04:05.6+09:00 /usr/lib/a_b.py:12", "<time> <path>:<n>"),
        ("id 123e4567-e89b-12d3-a456-426614174000!", "id <uuid>!"), ("/one only, abcdef and abcdef1", "/one only, abcdef and <hex>"), ("a/b@c/d  \u00a0 e", "a/b@c/d e"), (None, ""),
    ],
)
def test_signature_values(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(history.signature(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The Client, the client-side (v1.2) and x", "client,client-side,v1.2"), ("클라이언트를 다시 -- 옵션도", "클라이언트,다시,옵션"), ("해줘 나를", "나를"), ("..edge.. --a-- _ok_", "edge,_ok_"),
    ],
)
def test_prompt_tokens(spark, text, want):
    assert one(spark, F.array_join(gate.prompt_tokens(F.col("t")), ","), t=text) == want


@pytest.mark.parametrize(
    ("text", "flags"),
    [
        ("Thanks!", "a"), ("okay, go ahead", "a"), ("go", "c"), ("keep going..", "c"), ("계속해줘", "c"), ("why was it dropped", "mt"), ("drop it", "h"), ("adopted", ""), ("prehistory", "mt"), ("또 그거", "m"), ("please now", ""), ("", ""), ("sounds good really", "a"),
    ],
)
def test_intents(spark, text, flags):
    got = one(spark, gate.intents(F.col("t")), t=text)
    assert "".join(k for k, name in zip("mthac", ("memory", "trace", "high_impact", "acknowledgement", "continuation")) if got[name]) == flags


TOPIC = "compile kernel modules tonight with clang"


@pytest.mark.parametrize(
    ("text", "state", "want"),
    [
        ("  ", {"last_epoch": -1}, ("skip", "", "empty_prompt")),
        ("thanks", {}, ("skip", "", "acknowledgement")),
        ("thanks", {"last_epoch": -1}, ("retrieve", "first_substantive_in_epoch", None)),
        ("continue", {"last_epoch": 1, "epoch": 2}, ("retrieve", "context_epoch_changed", None)),
        ("continue", {"last_epoch": 1, "epoch": 2, "last_source": "compact"}, ("retrieve", "compact_first_prompt", None)),
        ("continue", {"capsule": 2, "capsule_seen": 1, "revision": 1, "incident": True}, ("retrieve", "incident_signature_match,project_revision_stale,capsule_generation_changed", None)),
        ("ok, remember the port again", {}, ("retrieve", "explicit_memory_intent", None)),
        ("no, the other one", {}, ("skip", "", "minor_correction")),
        ("no, drop it", {}, ("retrieve", "high_impact_intent", None)),
        ("paint wooden fence green tomorrow", {"topic": TOPIC, "has_topic_embedding": True}, ("retrieve", "topic_drift", None)),
        ("paint wooden fence green", {"topic": TOPIC, "has_topic_embedding": True}, ("ambiguous", "", None)),
        ("paint wooden fence green", {"topic": TOPIC}, ("retrieve", "no_topic_embedding", None)),
        ("kernel modules tonight clang", {"topic": TOPIC}, ("skip", "", "continuation")),
        ("compile kernel modules tonight gcc", {"topic": TOPIC}, ("skip", "", "coherent_topic")),
        ("compile kernel modules tonight gcc", {"topic": TOPIC, "informative": 6}, ("retrieve", "safety_refresh", None)),
        ("one two three four five six seven eight", {"resident": "nine ten", "has_topic_embedding": True}, ("retrieve", "low_resident_coverage", None)),
    ],
)
def test_gate(spark, text, state, want):
    columns = {k: gate.prompt_tokens(F.lit(v)) if k in ("topic", "resident") else F.lit(v) for k, v in state.items()}
    got = one(spark, gate.decide(F.col("t"), columns), t=text)
    assert (got["action"], ",".join(got["triggers"]), got["skip_reason"]) == want


def test_gate_overlay(spark):
    assert one(spark, gate.decide(F.col("t"), {"has_topic_embedding": F.lit(True)}, gate.Overlay(disabled=("memory.en.why", "trace.en.why"))), t="why")["action"] == "ambiguous"
    assert one(spark, gate.decide(F.col("t"), {}, user_hits={"high_impact": F.lit(True)}), t="hello")["triggers"] == ["high_impact_intent"]
    assert one(spark, gate.explain(F.col("t")), t="why is history so?") == ["memory.en.history-plain", "memory.en.history", "memory.en.why", "trace.en.history-plain", "trace.en.history", "trace.en.why"]
    assert one(spark, gate.decide(F.col("t"), {}, gate.Overlay(add_words={"ack": ("merci",)})), t="merci")["skip_reason"] == "acknowledgement"
    assert one(spark, gate.decide(F.col("t"), {"informative": F.lit(2)}, gate.Overlay(limits={"safety_refresh": 2})), t="one two three")["triggers"] == ["safety_refresh"]
    for wrong in ({"disabled": ("nothing",)}, {"add_words": {"nope": ()}}, {"limits": {"safety_refresh": 0}}, {"limits": {"drift_min_tokens": 2.5}}, {"limits": {"other": 1}}):
        with pytest.raises(ValueError):
            gate.Overlay(**wrong)
    assert one(spark, gate.resolve_ambiguous(F.lit("ambiguous"), F.lit(0.5), F.lit(0.43)), t="x") == "retrieve"


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("API Error: 500 Internal", "transient"), ("http error 422", "deterministic"), ("retry after 400 ms", "unknown"), ("response 400 ms timeout", "transient"), ("status code 413", "deterministic"), ("Invalid API key", "transient"),
        ("read ETIMEDOUT", "transient"), ("stream disconnected", "transient"), ("gateway timeout", "transient"), ("prompt is too long", "deterministic"), ("boom", "unknown"),
    ],
)
def test_error_classes(spark, message, want):
    assert one(spark, ledger.error_class(F.lit(""), F.lit(None).cast("int"), F.col("t")), t=message) == want


def test_path_like_names_have_path_boundaries(spark):
    texts = ["see src/a.ts.", "see src/a.ts.bak", "see lib/src/a.ts", "SRC/A.TS!", "src/a.ts-old", "x src/a.ts"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert sorted(r["i"] for r in df.where(lanes.holds_word(F.col("t"), "src/a.ts")).collect()) == [0, 3, 5]


def test_stream_ids(spark):
    import hashlib

    want = [hashlib.sha256(s.encode()).hexdigest()[:32] for s in ("workstream-branch-v1\0p\0main\0", "workstream-project-default-v1\0p\0")]
    got = [one(spark, identity.stream_id(F.col("p"), b), p="p") for b in (F.lit(" main "), F.lit("  "))]
    assert got == [f"ws-{w}" for w in want]


def test_relation_weights(spark):
    edges = spark.createDataFrame([(1, 2, "RELATES", 1), (1, 3, "INFLUENCES", 1), (3, 4, "DEPENDS", 1)], "source_id long, target_id long, relation_type string, created_at long")
    got = {r["id"]: round(r["relevance"], 3) for r in graph.expand(edges, spark.createDataFrame([(1,)], "id long"), 2).collect()}
    assert got == {2: 0.7, 3: 1.0, 4: 0.42}


def test_token_estimate_and_cuts(spark):
    assert one(spark, gate.token_estimate(F.col("t")), t="abcd") == 2
    assert one(spark, gate.token_estimate(F.col("t")), t="é漢🙂") == 5
    assert one(spark, gate.sentence_cut(F.col("t"), 22), t="One here. Two there and more.") == "One here."
    assert one(spark, gate.sentence_cut(F.col("t"), 8), t="words without end") == "words"
    assert json.loads(one(spark, gate.envelope(F.col("t")), t='a <b> "c" & d')) == 'a <b> "c" & d'


def test_query_tokens_keep_the_telling_ones():
    assert retrieval.query_tokens("a b") == ["a", "b"]
    got = retrieval.query_tokens("one three fourteen seventeen eleven hundred thousand API x9 of")
    assert "api" in got and "x9" in got and "of" not in got and len(got) <= 10


def test_text_functions(spark):
    assert one(spark, tx.normalized_fact(F.col("t")), t="  We  USE tabs!. ") == "we use tabs!."
    assert one(spark, tx.normalized_fact(F.col("t")), t=" We use  TABS!.。") == "we use tabs"
    assert one(spark, tx.dominant_script(F.col("t")), t="한국어 text ```long english code block here```") == "ko"
    assert one(spark, tx.first_json(F.col("t")), t='so: ```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, tx.storage_key(F.col("t")), t="/a/b c/").startswith("b-c--")


def test_transcripts(spark, tmp_path):
    sid = "0b1c2d3e-0000-4000-8000-000000000001"
    rows = [
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": sid, "cwd": "/w"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "<environment_context>x"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "t", "text": "hi"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "ls", "call_id": "c1", "arguments": "{}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "ok"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "rm", "call_id": "c2", "arguments": "{}"}},
        {"type": "response_item", "timestamp": "2024-01-01T00:01:00Z", "payload": {"type": "message", "role": "assistant", "content": "hello"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "unanswered"}},
    ]
    folder = tmp_path / "2024" / "01"
    folder.mkdir(parents=True)
    (folder / f"rollout-x-{sid}.jsonl").write_text("\n".join([*map(json.dumps, rows[:4]), "{broken", *map(json.dumps, rows[4:])]) + "\n")
    (folder / "rollout-empty.jsonl").write_text("")
    (folder / "other.jsonl").write_text("{}\n")
    records = transcripts.parse(transcripts.read_lines(spark, str(tmp_path)))
    head = transcripts.headers(records).first()
    assert (head["session_id"], head["cwd"], head["is_subthread"]) == (sid, "/w", False)
    got = transcripts.exchanges(records).collect()
    assert [(r["user_message"], r["assistant_message"], r["line_start"], r["line_end"], r["n_tools"], r["n_open"], r["closure_state"]) for r in got] == [("hi", "hello", 3, 8, 2, 1, "closed")]
    assert got[0]["id"] == hashlib.md5(f"mx:{sid}:u3".encode()).hexdigest()


def test_turns_of_tools_alone(spark):
    say = lambda n, kind, **p: (n, json.dumps({"type": "response_item", "payload": {"type": kind, **p}}))
    lines = [
        say(1, "message", role="assistant", content="too early"), say(2, "message", role="user", content=""), say(3, "custom_tool_call", name="a", call_id="x", input="1"), say(4, "custom_tool_call_output", call_id="x", output="ok"),
        say(5, "custom_tool_call_output", call_id="nobody", output="?"), say(6, "message", role="user", content="[not json"), say(7, "message", role="assistant", content=[{"type": "t", "text": "a"}]), say(8, "message", role="assistant", content="b"),
        say(9, "message", role="user", content="last"), say(10, "function_call", name="b", call_id="y", arguments="{}"), say(11, "reasoning", content="hm"),
    ]
    records = transcripts.parse(spark.createDataFrame([("/t/none.jsonl", n, line) for n, line in lines], "path string, line_no long, line string"))
    got = [(r["seq"], r["user_message"], r["assistant_message"], r["line_start"], r["line_end"], r["closure_state"], r["n_tools"], r["n_open"]) for r in transcripts.exchanges(records).orderBy("seq").collect()]
    assert got == [(1, "(tool calls only)", "", 2, 4, "closed", 1, 0), (2, "[not json", "a\n\nb", 6, 8, "closed", 0, 0), (3, "last", "", 9, 10, "interrupted", 1, 1)]


def test_cursors(spark):
    good = one(spark, history.decode_cursor(history.encode_cursor(F.lit("2024-01-01T00:00:00Z"), F.lit("é?~"), F.col("n"))), n=7)
    assert (good["recorded_at"], good["seq"]) == ("é?~", 7)
    assert all(one(spark, history.decode_cursor(F.col("c")), c=c) is None for c in ("", "e30", "!!", "AAAA"))


def test_generations_count_whole_or_not_at_all(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, t string").repartition(2)
    path = str(tmp_path / "g")
    expected = transcripts.write_generation(df, path).cache()
    assert transcripts.read_generation(spark, path, expected, df.schema).count() == 20
    assert transcripts.read_generation(spark, path, expected.limit(1), df.schema).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, f in (("tumble", lambda e: windows.tumbling(e, "1 hour", "60 days")), ("session", lambda e: windows.sessions(e, "30 minutes", "60 days")), ("seen", lambda e: windows.first_seen(e, ["user_id", "event_type"], "60 days").select("user_id", "event_type"))):
        run = f(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "seen" else "complete").option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
        want = f(events)
        assert spark.table(name).exceptAll(want).isEmpty() and want.exceptAll(spark.table(name)).isEmpty()


def test_windows_stop_at_ineligible_rows_and_at_five(spark):
    kinds = ["a", "a", "a", "a", "x", "a", "-", "-", "-", "a"]
    rows = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)] + [("t", 0, "-")], "session string, at long, kind string")
    got = extraction.anchor_windows(rows, "session", ["at"], F.col("kind") != "x", F.col("kind") == "a")
    assert sorted((r["first_pos"], r["last_pos"]) for r in got.collect()) == [(1, 4), (6, 7), (9, 10)]
    long = spark.createDataFrame([("s", i, "a") for i in range(8)], rows.schema)
    assert sorted((r["first_pos"], r["last_pos"]) for r in extraction.anchor_windows(long, "session", ["at"], F.lit(True), F.lit(True)).collect()) == [(1, 5), (4, 8)]
    assert extraction.anchor_windows(rows.limit(0), "session", ["at"], F.lit(True), F.lit(True)).count() == 0


def test_paths_are_lexical(spark):
    cases = {"/a//b/./c/": "/a/b/c", "/a/../../b": "/b", " x/y ": "/x/y", "/": "/", "  ": "", "/..": "/"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, "")], "p string, want string")
    assert df.where(identity.canonical_path(F.col("p")) != F.col("want")).count() == 0


def test_an_unfinished_check_holds_its_batch(spark):
    df = spark.createDataFrame([(1, 1, "fine"), (2, 1, "y" * 11), (3, 2, "bad"), (4, 2, None)], "id long, batch long, t string")
    got = {r["id"]: (r["state"], r["pattern_ids"]) for r in extraction.block_set(df, "batch", {"t": {"p": "^bad$"}}, 10).collect()}
    assert got == {1: ("held", ""), 2: ("held", ""), 3: ("blocked", "p"), 4: ("kept", "")}


def test_conflicting_identities_raise_no_project(spark):
    requests = spark.createDataFrame([(1, "/a", None, None, None, None), (2, "/a", 9, None, None, None), (3, None, None, None, "d", None), (4, None, None, None, None, "r"), (5, None, None, None, None, None)], "request_id long, path string, explicit_id long, portable_key string, common_dir string, remote string")
    spaces = spark.createDataFrame([("/a", 1, "d", "r", False), ("/b", 2, "d", "r", True)], "path string, project_id long, common_dir string, remote string, approved boolean")
    got = {r["request_id"]: (r["project_id"], r["reason"]) for r in identity.resolve_projects(requests, spaces, spark.createDataFrame([(1, "k")], "project_id long, portable_key string")).collect()}
    assert got == {1: (1, "path"), 2: (None, "conflict"), 3: (None, "conflict"), 4: (2, "approved-remote"), 5: (None, "new")}


def test_bundle_keeps_to_its_limits(spark):
    items = spark.createDataFrame([("p", "d", i, "word " * 60) for i in range(9)] + [("p", "h", 1, "short"), ("q", "h", 1, None), ("q", "z", 1, "unknown section")], "owner string, section string, n long, text string")
    got = {r["owner"]: r for r in continuity.render_bundle(items, "owner", "section", ["n"], "text", {"d": ("[D]", 8), "h": ("[H]", 2)}).collect()}
    assert len(got["p"]["bundle"]) <= continuity.HARD_CHARS and got["p"]["truncated"] and got["p"]["bundle"].endswith("[H]\n- short")
    assert (got["q"]["bundle"], got["q"]["n_lines"], got["q"]["truncated"]) == ("[H]\n- ", 1, False)
