"""What a session's context holds, kept as state over a stream: epochs, residents, living evidence.

``session_log`` takes actions (session, ts, seq, action, marker, token, item, generation) and returns what each of them
did: (session, at, seq, what, item, epoch, n), the same over a table and over a stream.

``compact`` and ``clear`` start a new epoch (``epoch``), unless their marker was applied before or their token is the
one in force (``repeat``). ``resident`` takes a fact into the context (``resident``), unless the epoch holds it in that
generation or a newer one (``held``); n is the generation. ``evidence`` lives for ``TTL_DAYS`` and then is ``expired``.
``read`` counts the living evidence since the epoch's last read (n). Other actions do nothing.

A stream takes a session's actions in the order of (ts, seq). One that is not after the last one taken is ``refused``,
one behind the watermark never arrives; neither changes anything. Within a trigger a session's actions are sorted, so
the trigger's size bounds what a task holds. State lies in value, map and list variables, expiry in event-time timers,
one at a time for a session. A call on state costs more than an action, so a trigger reads what a session holds once,
when it is first asked for, and writes what has become of it at its end. A
stream's evidence expires as the watermark passes it, a table's as of its last action less the lateness.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

TTL_DAYS = 14
DAY_US = 86_400_000_000
LATENESS = "10 minutes"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOG = "session string, at_us bigint, seq bigint, what string, item string, epoch bigint, n bigint"
_ACTIONS = ("session", "ts", "at_us", "seq", "action", "marker", "token", "item", "generation")


class SessionState(StatefulProcessor):
    """State of one session: the last action taken, applied markers, residents and what was carried over, evidence in order."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "at_us bigint, seq bigint, epoch bigint, token string, read_us bigint, read_seq bigint, timer_ms bigint")
        self.markers = handle.getMapState("markers", "marker string", "seq bigint")
        self.resident = handle.getMapState("resident", "item string", "generation bigint")
        self.carry = handle.getMapState("carry", "item string", "generation bigint")
        self.evidence = handle.getListState("evidence", "at_us bigint, seq bigint, item string, epoch bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        parts = list(rows)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts)
        order = np.lexsort((frame["seq"].to_numpy(), frame["at_us"].to_numpy()))
        columns = (frame[c].to_numpy()[order].tolist() for c in ("at_us", "seq", "action", "marker", "token", "item", "generation"))
        was = self.head.get()
        at, seq, epoch, token, read_us, read_seq, timer = was or (-(1 << 62), 0, 0, None, -(1 << 62), 0, None)
        # None: not read yet. A session that is new holds nothing.
        held, carried, living = (None, None, None) if was else ({}, {}, [])
        out, fresh, known, applied, changed, anew, turned = [], [], {}, {}, set(), False, False
        text = lambda x: None if x is None or x != x else x
        for at_us, number, action, marker, given, item, generation in zip(*columns, strict=True):
            marker, given, item = text(marker), text(given), text(item)
            say = lambda what, n=0: out.append((key[0], at_us, number, what, item, epoch, n))  # noqa: B023, E731
            if (at_us, number) <= (at, seq):
                say("refused")
                continue
            at, seq = at_us, number
            if action in ("compact", "clear"):
                if marker is not None and marker not in known:
                    known[marker] = bool(was) and self.markers.containsKey((marker,))
                if (marker is not None and known[marker]) or (token is not None and given == token):
                    say("repeat")
                else:
                    epoch, token, read_us, read_seq = epoch + 1, given, -(1 << 62), 0
                    # A compaction carries the residents over, unless older ones still wait; a cleared context carries nothing.
                    if action == "clear":
                        carried, turned = {}, True
                    else:
                        carried = self._all(self.carry) if carried is None else carried
                        if not carried:
                            carried, turned = self._all(self.resident) if held is None else held, True
                    held, anew = {}, True
                    changed.clear()
                    say("epoch")
                if marker is not None:
                    known[marker], applied[marker] = True, seq
            elif action == "resident" and item is not None:
                held = self._all(self.resident) if held is None else held
                if held.get(item, generation - 1) >= generation:
                    say("held", generation)
                else:
                    held[item] = generation
                    changed.add(item)
                    say("resident", generation)
            elif action == "evidence":
                fresh.append((at, seq, item, epoch))
                if living is not None:
                    living.append((at, seq))
                say("evidence")
            elif action == "read":
                if living is None:
                    living = [(e[0], e[1]) for e in (*self.evidence.get(), *fresh)]
                say("read", len(living) - bisect_right(living, max((read_us, read_seq), (at - self.ttl_us, math.inf))))
                read_us, read_seq = at, seq
        if anew and was:
            self.resident.clear()
        for item in changed:
            self.resident.updateValue((item,), (held[item],))
        if turned:
            if was:
                self.carry.clear()
            for item, generation in carried.items():
                self.carry.updateValue((item,), (generation,))
        for marker, n in applied.items():
            self.markers.updateValue((marker,), (n,))
        if fresh:
            self.evidence.appendList(fresh)
            timer = self._timer(fresh) if timer is None else timer
        self.head.update((at, seq, epoch, token, read_us, read_seq, timer))
        yield pd.DataFrame(out, columns=["session", "at_us", "seq", "what", "item", "epoch", "n"])

    @staticmethod
    def _all(state) -> dict:
        return {k[0]: v[0] for k, v in state.iterator()}

    def _timer(self, evidence: list) -> int | None:
        """Evidence comes in order, so the first to expire is the first; the others wait for their turn."""
        if not evidence:
            return None
        due = (evidence[0][0] + self.ttl_us) // 1000
        self.handle.registerTimer(due)
        return due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        # All that the watermark has passed goes at once, whichever timer woke the session.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        evidence = list(self.evidence.get())
        n = sum((e[0] + self.ttl_us) // 1000 <= now for e in evidence)
        gone, rest = evidence[:n], evidence[n:]
        if rest:
            self.evidence.put(rest)
        else:
            self.evidence.clear()
        self.head.update((*self.head.get()[:-1], self._timer(rest)))
        yield pd.DataFrame([(key[0], e[0] + self.ttl_us, e[1], "expired", e[2], e[3], 0) for e in gone], columns=["session", "at_us", "seq", "what", "item", "epoch", "n"])

    def close(self) -> None:
        pass


def session_log(actions: DataFrame, ttl_days: int = TTL_DAYS, lateness: str = LATENESS) -> DataFrame:
    """(session, at, seq, what, item, epoch, n) of ``actions``, a table or a stream."""
    rows = actions.withColumn("ts", F.col("ts").cast("timestamp")).withColumns({"session": F.col("session").cast("string"), "at_us": F.unix_micros("ts"), "seq": F.col("seq").cast("long"), "item": F.col("item").cast("string"), "marker": F.col("marker").cast("string"), "token": F.col("token").cast("string"), "generation": F.coalesce(F.col("generation").cast("long"), F.lit(0))}).select(*_ACTIONS)
    if rows.isStreaming:
        log = rows.withWatermark("ts", lateness).groupBy("session").transformWithStateInPandas(SessionState(ttl_days * DAY_US), _LOG, "Append", "EventTime")
    else:
        log = _table_log(rows.drop("ts"), ttl_days * DAY_US, lateness)
    return log.select("session", F.timestamp_micros("at_us").alias("at"), "seq", "what", "item", "epoch", "n")


def _table_log(rows: DataFrame, ttl_us: int, lateness: str) -> DataFrame:
    own = Window.partitionBy("session").orderBy("at_us", "seq")
    reset = F.col("action").isin("compact", "clear")
    # The first action with a marker counts; of those, one with the token of the one before does not advance.
    first = reset & (F.col("marker").isNull() | (F.row_number().over(Window.partitionBy("session", "marker", reset).orderBy("at_us", "seq")) == 1))
    x = rows.withColumn("_first", first)
    token = F.struct(F.col("token").alias("t"))
    before = F.last(F.when(F.col("_first"), token), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))["t"]
    x = x.withColumn("_new", F.col("_first") & ~F.coalesce(before == F.col("token"), F.lit(False)))
    x = x.withColumn("epoch", F.sum(F.col("_new").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.max(F.when((F.col("action") == "resident"), F.col("generation"))).over(Window.partitionBy("session", "epoch", "item").orderBy("at_us", "seq").rowsBetween(Window.unboundedPreceding, -1))
    evidence = (F.col("action") == "evidence").cast("long")
    total = F.sum(evidence).over(own.rowsBetween(Window.unboundedPreceding, 0))
    dead = F.coalesce(F.sum(evidence).over(Window.partitionBy("session").orderBy("at_us").rangeBetween(Window.unboundedPreceding, -ttl_us)), F.lit(0))
    x = x.withColumns({"_held": held, "_total": total, "_living": total - dead})
    seen = F.max(F.when(F.col("action") == "read", F.col("_total"))).over(Window.partitionBy("session", "epoch").orderBy("at_us", "seq").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_since", F.col("_total") - F.coalesce(seen, F.lit(0)))
    kind = F.col("action")
    what = (
        F.when(reset, F.when(F.col("_new"), "epoch").otherwise("repeat"))
        .when((kind == "resident") & F.col("item").isNotNull(), F.when(F.col("_held") >= F.col("generation"), "held").otherwise("resident"))
        .when(kind.isin("evidence", "read"), kind)
    )
    n = F.when(kind == "resident", F.col("generation")).when(kind == "read", F.least("_since", "_living")).otherwise(0)
    log = x.select("session", "at_us", "seq", what.alias("what"), "item", "epoch", n.alias("n")).where("what is not null")
    end = rows.agg(F.unix_micros(F.timestamp_micros(F.max("at_us")) - F.expr(f"INTERVAL {lateness}"))).first()[0]
    gone = log.where("what = 'evidence'").where(F.floor((F.col("at_us") + ttl_us) / 1000) <= F.floor(F.lit(end) / 1000))
    return log.unionByName(gone.select("session", (F.col("at_us") + ttl_us).alias("at_us"), "seq", F.lit("expired").alias("what"), "item", "epoch", "n"))


def residents(log: DataFrame) -> DataFrame:
    """(session, item, generation, epoch): what every session's context holds at the end of a log."""
    now = log.groupBy("session").agg(F.max("epoch").alias("epoch"))
    return log.where("what = 'resident'").join(now, ["session", "epoch"]).groupBy("session", "item", "epoch").agg(F.max("n").alias("generation"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run ``stream`` over all that its source has now, appending to ``path``; the same ``checkpoint`` goes on from there."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
