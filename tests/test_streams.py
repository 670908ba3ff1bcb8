"""Streams and sources over real files: session state, growing transcripts, published generations."""

import json
import os

import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from threadloom.plans import source_queries, stream_queries
from threadloom.sources import generations, transcripts
from threadloom.sources.transcript_source import TranscriptSource
from threadloom.streaming import session_state

ACTIONS = "session string, ts timestamp, seq long, action string, marker string, token string, item string, generation long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- session state ---


def act(spark, rows):
    made = spark.createDataFrame([(s, seq, a, m, t, i, g, minute) for s, minute, seq, a, m, t, i, g in rows], "session string, seq long, action string, marker string, token string, item string, generation long, minute long")
    return made.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("minute") * 60)).select([c.split()[0] for c in ACTIONS.split(", ")])


def test_stream_and_table_agree_over_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/../sf0.01/events.parquet")
    want = session_state.session_log(stream_queries.actions(events), stream_queries.TTL_DAYS)
    got = stream_queries.str06_session_stream(spark, f"{sf_dir}/../sf0.01")
    want = want.select("session", F.col("at").cast("timestamp_ntz").alias("at"), "seq", "what", "item", "epoch", "n")
    assert rows_of(got.na.fill("")) == rows_of(want.na.fill(""))
    assert {r["what"] for r in got.select("what").distinct().collect()} == {"epoch", "repeat", "resident", "held", "evidence", "read", "expired"}


def test_state_survives_a_restart_and_refuses_what_regresses(spark, tmp_path):
    """Three runs from one checkpoint: state goes on, a regressing action and one behind the watermark change nothing."""
    day = 24 * 60
    first = [
        ("s", 1, 1, "resident", None, None, "f1", 1), ("s", 2, 2, "evidence", None, None, "e1", 0), ("s", 3, 3, "compact", "m1", "t1", None, 0),
        ("s", 4, 4, "resident", None, None, "f1", 2), ("other", 5, 1, "evidence", None, None, "x", 0),
    ]
    second = [
        ("s", 4, 4, "resident", None, None, "f9", 9), ("s", 6, 5, "compact", "m1", "t9", None, 0), ("s", 7, 6, "clear", "m2", "t1", None, 0),
        ("s", 8, 7, "read", None, None, None, 0), ("s", 9, 8, "read", None, None, None, 0), ("s", 10, 9, "clear", "m3", "t3", None, 0), ("s", 11, 10, "read", None, None, None, 0),
    ]
    third = [("s", 15 * day, 11, "read", None, None, None, 0), ("other", 15 * day, 2, "read", None, None, None, 0)]
    late = [("s", 20, 12, "resident", None, None, "late", 1), ("s", 15 * day + 1, 13, "other", None, None, None, 0)]
    source = tmp_path / "in"
    seen = []
    for k, rows in enumerate((first, second, third, late)):
        act(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ACTIONS).parquet(str(source))
        out = session_state.drain(session_state.session_log(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        rows_now = {(r["session"], r["seq"], r["what"], r["item"], r["epoch"], r["n"]) for r in out.collect()}
        seen.append(rows_now - set().union(*seen))
    assert seen[0] == {("s", 1, "resident", "f1", 0, 1), ("s", 2, "evidence", "e1", 0, 0), ("s", 3, "epoch", None, 1, 0), ("s", 4, "resident", "f1", 1, 2), ("other", 1, "evidence", "x", 0, 0)}
    # m1 was applied, t1 is the token in force: no new epoch; the cursor moves with a read and starts anew with an epoch.
    assert seen[1] == {("s", 4, "refused", "f9", 1, 0), ("s", 5, "repeat", None, 1, 0), ("s", 6, "repeat", None, 1, 0), ("s", 7, "read", None, 1, 1), ("s", 8, "read", None, 1, 0), ("s", 9, "epoch", None, 2, 0), ("s", 10, "read", None, 2, 1)}
    assert seen[2] == {("s", 11, "read", None, 2, 0), ("other", 2, "read", None, 0, 0), ("s", 2, "expired", "e1", 0, 0), ("other", 1, "expired", "x", 0, 0)}
    assert not {r for r in seen[3] if r[2] == "resident"}
    held = spark.read.format("statestore").option("stateVarName", "resident").load(str(tmp_path / "checkpoint"))
    assert held.count() == 0  # the third epoch holds nothing


def test_residents_of_a_log(spark):
    log = session_state.session_log(act(spark, [("s", 1, 1, "resident", None, None, "a", 1), ("s", 2, 2, "compact", None, None, None, 0), ("s", 3, 3, "resident", None, None, "b", 2), ("s", 4, 4, "resident", None, None, "b", 1), ("s", 5, 5, "resident", None, None, "b", 3)]))
    assert rows_of(session_state.residents(log)) == [("s", "b", 1, 3)]
    assert rows_of(session_state.session_log(act(spark, []))) == []


# --- transcripts ---


@pytest.fixture
def feed(spark, tmp_path):
    """(root, run): run reads what is new into a table and returns the rows added."""
    spark.dataSource.register(TranscriptSource)
    root, out, seen = tmp_path / "journals", str(tmp_path / "rows"), set()
    root.mkdir()

    def run(**options):
        stream = spark.readStream.format("transcripts").option("path", str(root)).option("ledger", str(tmp_path / "ledger")).options(**options).load()
        got = [(r["path"], r["epoch"], r["at"], r["line"]) for r in session_state.drain(stream, out, str(tmp_path / "checkpoint")).collect()]
        assert len(got) == len(set(got))  # nothing is read twice
        new = sorted(set(got) - seen)
        seen.update(got)
        return new

    return root, run


def test_growing_files_are_read_once(feed):
    root, run = feed
    (root / "a.jsonl").write_text("one\ntwo\nhalf")
    (root / "sub").mkdir()
    (root / "sub" / "b.jsonl").write_text("é漢\n")
    assert run() == [("a.jsonl", 0, 0, "one"), ("a.jsonl", 0, 4, "two"), ("sub/b.jsonl", 0, 0, "é漢")]
    assert run() == []
    with open(root / "a.jsonl", "a") as f:
        f.write(" line\nthree\n")
    assert run() == [("a.jsonl", 0, 8, "half line"), ("a.jsonl", 0, 18, "three")]
    (root / "sub" / "b.jsonl").unlink()
    assert run() == []


def test_truncated_and_replaced_files_start_an_epoch(feed):
    root, run = feed
    a = root / "a.jsonl"
    a.write_text("one\ntwo\nthree\n")
    assert len(run()) == 3
    a.write_text("one\n")  # truncated
    assert run() == [("a.jsonl", 1, 0, "one")]
    a.write_text("ONE\n")  # rewritten at the same size
    os.utime(a, ns=(1, 1))
    assert run() == [("a.jsonl", 2, 0, "ONE")]
    a.write_text("another\nfile\n")  # replaced by a longer one
    assert run() == [("a.jsonl", 3, 0, "another"), ("a.jsonl", 3, 8, "file")]
    a.write_text("")
    assert run() == []
    a.write_text("again\n")
    assert [r[3] for r in run()] == ["again"]


def test_archives(feed):
    root, run = feed
    pack = lambda text: zstandard.ZstdCompressor().compress(text.encode())
    (root / "a.jsonl").write_text("one\ntwo\n")
    (root / "z.jsonl.zst").write_bytes(pack("x\n") + pack("y\n"))  # two frames
    assert run() == [("a.jsonl", 0, 0, "one"), ("a.jsonl", 0, 4, "two"), ("z.jsonl", 0, 0, "x"), ("z.jsonl", 0, 2, "y")]
    (root / "a.jsonl.zst").write_bytes(pack("one\ntwo\nthree\n"))  # the same transcript, packed after it grew
    (root / "a.jsonl").unlink()
    assert run() == [("a.jsonl", 0, 8, "three")]
    (root / "z.jsonl.zst").write_bytes(pack("x\ny\nw\n")[:-4])  # damaged: no line of it can be unpacked, or only some
    assert all(r[:2] == ("z.jsonl", 1) for r in run())
    (root / "b.jsonl").write_text("plain\n")
    assert [r[3] for r in run()] == ["plain"]
    (root / "b.jsonl.zst").write_bytes(pack("other\n"))  # does not begin with what was taken
    os.utime(root / "b.jsonl", ns=(1, 1))
    assert run() == [("b.jsonl", 1, 0, "other")]


@pytest.mark.parametrize("split", [1, 2, 7, 64])
def test_splits_cut_no_line(spark, tmp_path, split):
    spark.dataSource.register(TranscriptSource)
    lines = ["", "a", "long " * 9, "", "é", "end"]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\nrest")
    got = spark.read.format("transcripts").option("path", str(tmp_path)).option("splitBytes", split).load().orderBy("at")
    assert [r["line"] for r in got.collect()] == lines


def test_a_restart_repeats_no_line(spark, tmp_path):
    """A trigger that fails after its plan was logged is run again over the same bytes, though the file has grown."""
    spark.dataSource.register(TranscriptSource)
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    root.mkdir()
    (root / "a.jsonl").write_text("one\n")

    def stream():
        return spark.readStream.format("transcripts").option("path", str(root)).option("ledger", str(tmp_path / "ledger")).load()

    session_state.drain(stream(), out, checkpoint)
    with open(root / "a.jsonl", "a") as f:
        f.write("two\n")
    failing = stream().withColumn("line", F.when(F.col("line") == "two", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        session_state.drain(failing, out, checkpoint)
    with open(root / "a.jsonl", "a") as f:
        f.write("three\n")
    for _ in range(2):  # the logged batch first, then what has come since
        got = session_state.drain(stream(), out, checkpoint)
    assert [r["line"] for r in got.orderBy("at").collect()] == ["one", "two", "three"]


def test_many_sessions_a_file(spark, sf_dir):
    lines = source_queries.rollouts(spark, sf_dir)
    assert lines.select(F.substring_index("path", "#", 1)).distinct().count() < lines.select("path").distinct().count()
    heads = transcripts.headers(transcripts.parse(lines))
    assert heads.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()


# --- generations ---


@pytest.fixture
def shelf(spark, tmp_path):
    spark.dataSource.register(generations.GenerationSource)
    root = str(tmp_path / "shelf")

    def write(df, device="d", **options):
        df.write.format("generations").option("path", root).option("device", device).options(**options).mode("append").save()

    def read(**options):
        return spark.read.format("generations").option("path", root).options(**options).load()

    return root, write, read


def test_a_failed_write_leaves_the_old_generation(spark, shelf):
    root, write, read = shelf
    write(spark.range(100).repartition(4))
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("id") + 1000).alias("id"))
    with pytest.raises(Exception, match="torn"):
        write(bad)
    assert sorted(r["id"] for r in read().collect()) == list(range(100))
    assert len(generations.generations_of(f"{root}/d")) == 1 and len(os.listdir(f"{root}/d")) == 2
    write(spark.range(5))
    assert sorted(r["id"] for r in read().collect()) == list(range(5))


def test_devices_keep_their_own_generations(spark, shelf):
    root, write, read = shelf
    for n in range(5):
        write(spark.range(n + 1), "a", keep=2)
    write(spark.range(10, 13), "b")
    got = read()
    assert sorted((r["_device"], r["id"]) for r in got.collect()) == [("a", i) for i in range(5)] + [("b", i) for i in range(10, 13)]
    assert len(generations.generations_of(f"{root}/a")) == 3
    assert [r["_device"] for r in read(device="b").select("_device").distinct().collect()] == ["b"]
    write(spark.range(0), "b")
    assert read(device="b").count() == 0


@pytest.mark.parametrize("harm", ["pointer", "manifest", "missing", "altered", "shortened"])
def test_damage_refuses_a_device(spark, shelf, harm):
    root, write, read = shelf
    write(spark.range(20).coalesce(1), "sound")
    write(spark.range(20).coalesce(1), "torn")
    (generation,) = generations.generations_of(f"{root}/torn")
    folder = f"{root}/torn/{generation}"
    (part,) = [f for f in os.listdir(folder) if f.startswith("part")]
    if harm == "pointer":
        open(f"{root}/torn/CURRENT", "w").write("{")
    elif harm == "manifest":
        told = json.load(open(f"{folder}/manifest.json"))
        json.dump(told | {"n_rows": 1}, open(f"{folder}/manifest.json", "w"))
    elif harm == "missing":
        os.remove(f"{folder}/{part}")
    elif harm == "altered":
        size = os.path.getsize(f"{folder}/{part}")
        table = pq.read_table(f"{folder}/{part}")
        data = bytearray(open(f"{folder}/{part}", "rb").read())
        data[20] ^= 1
        assert len(data) == size and table.num_rows == 20
        open(f"{folder}/{part}", "wb").write(data)
    else:
        open(f"{folder}/{part}", "ab").truncate(30)
    with pytest.raises(Exception, match="torn"):
        read().collect()
    assert {r["_device"] for r in read(onDamage="skip").collect()} == {"sound"}


def test_state_is_called_for_what_remains_not_for_each_action():
    """A session's trigger reads its state once and writes what has become of it; a thousand actions are a few calls."""
    import pandas as pd

    calls, state = [], {}

    class Variable:
        def __init__(self, name):
            self.name, self.kept = name, state.setdefault(name, {})

        def __getattr__(self, method):
            def call(*args):
                calls.append((self.name, method))
                if method in ("updateValue",):
                    self.kept[args[0]] = args[1]
                elif method in ("update", "put", "appendList"):
                    self.kept[0] = args[0] if method != "appendList" else [*self.kept.get(0, []), *args[0]]
                elif method == "clear":
                    self.kept.clear()
                return {"get": lambda: self.kept.get(0), "exists": lambda: bool(self.kept), "iterator": lambda: iter(self.kept.items()), "getValue": lambda: self.kept.get(args[0]), "containsKey": lambda: args[0] in self.kept}.get(method, lambda: None)()

            return call

    class Handle:
        getValueState = getMapState = getListState = lambda self, name, *kinds: Variable(name)

        def registerTimer(self, at):
            calls.append(("timer", at))

    processor = session_state.SessionState(session_state.DAY_US)
    processor.init(Handle())
    n = 1000
    kinds = ["resident", "evidence", "read", "other"]
    rows = pd.DataFrame([(i * 1000, i, kinds[i % 4], None, None, f"f{i % 12 // 4}" if i % 4 < 2 else None, i) for i in range(n)], columns=["at_us", "seq", "action", "marker", "token", "item", "generation"])
    out = pd.concat(processor.handleInputRows(("s",), iter([rows[500:], rows[:500]]), None))
    assert [tuple(x) for x in out[["seq", "what", "n"]].itertuples(index=False)][:4] == [(0, "resident", 0), (1, "evidence", 0), (2, "read", 1), (4, "resident", 4)]
    assert len(out) == 750 and set(out[out.what == "read"].n) == {1} and len(calls) < 12
    again = pd.DataFrame([(n * 1000, n, "read", None, None, None, 0), (n * 1000 + 1, n + 1, "resident", None, None, "f0", 1)], columns=rows.columns)
    out = pd.concat(processor.handleInputRows(("s",), iter([again]), None))
    assert [tuple(x) for x in out[["what", "n"]].itertuples(index=False)] == [("read", 0), ("held", 1)]
