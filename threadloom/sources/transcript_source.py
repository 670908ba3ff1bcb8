"""Growing transcripts as a data source: ``transcripts``, for tables and streams.

    spark.dataSource.register(TranscriptSource)
    spark.readStream.format("transcripts").option("path", root).option("ledger", folder).load()

Rows are (path, epoch, at, line): complete lines of ``*.jsonl`` and ``*.jsonl.zst`` below ``path`` with the byte each
begins at. A name and its compressed form are one transcript; the newer file counts, of equally new ones the plain.

A stream's offset is the number of a ledger in the folder ``ledger`` (shared storage): for each transcript, how many
bytes have been taken, and digests of the first and the last bytes among them. A file that still holds those bytes is
read on from there. One that is shorter or holds others was truncated, rewritten or replaced: its ``epoch`` grows and it
is read from the start. Planning reads a few kilobytes a changed file; tasks read the rest, in splits of ``splitBytes``.
Ledgers never change once written, so a trigger that is run again plans the same bytes, and each is read once.

A compressed archive is taken whole when it appears. If it takes the place of a plain file whose bytes were taken, the
task that reads it compares them, and goes on behind them or starts a new epoch. What cannot be unpacked ends there.
Digests cover ``EDGE`` bytes at both ends: a file rewritten only in its middle, with both edges as before, looks grown.
A file that is replaced between planning and reading gives nothing then and a new epoch at the next trigger.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from threadloom.sources import files

EDGE = 4096
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20
SPLIT_BYTES = 64 << 20
PACKED = ".zst"
SCHEMA = "path string, epoch int, at bigint, line string"


@dataclass(frozen=True)
class Taken:
    """What has been taken of a transcript. ``through`` is -1 for an archive that was taken whole."""

    file: str
    size: int
    modified: int
    epoch: int
    through: int
    head: str = ""
    seam: str = ""


@dataclass(frozen=True)
class Segment(InputPartition):
    """Lines of ``file`` that begin in [start, end); a packed file's end is -1. ``first`` is where the segment begins."""

    path: str
    file: str
    epoch: int
    first: int
    start: int
    end: int
    taken: Taken | None = None


def _digest(data: bytes) -> str:
    return hashlib.md5(data, usedforsecurity=False).hexdigest()


def _at(source, start: int, n: int) -> bytes:
    source.seek(start)
    return source.read(n)


def _edges(source, through: int) -> tuple[str, str]:
    n = min(EDGE, through)
    return _digest(_at(source, 0, n)), _digest(_at(source, through - n, n))


def complete_bytes(source, size: int) -> int:
    """Bytes up to the last line end, found from the end backwards."""
    end = size
    while end > 0:
        start = max(0, end - CHUNK)
        cut = _at(source, start, end - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


def discover(root: str, pattern: str) -> dict[str, tuple[str, int, int]]:
    """transcript name -> (file, size, modified): the newer one of a plain file and its archive."""
    _, base = files.store(root)
    found: dict[str, tuple[str, int, int]] = {}
    for f in sorted(files.below(root), key=lambda f: (f.mtime_ns or 0, not f.path.endswith(PACKED))):
        name = f.path.removeprefix(base.rstrip("/") + "/").removesuffix(PACKED)
        if fnmatch.fnmatch(name.rpartition("/")[2], pattern):
            found[name] = (f.path, f.size, f.mtime_ns or 0)
    return found


def advance(root: str, before: dict[str, Taken], now: dict[str, tuple[str, int, int]]) -> dict[str, Taken]:
    """The ledger after ``before``; transcripts that are gone keep their entry."""
    system, _ = files.store(root)
    after = dict(before)
    for name, (file, size, modified) in now.items():
        old = before.get(name)
        if old and (old.file, old.size, old.modified) == (file, size, modified):
            continue
        if file.endswith(PACKED):
            # The number after the last one stays free: the task may find that the archive holds other bytes.
            after[name] = Taken(file, size, modified, old.epoch + 1 if old else 0, -1)
            continue
        with system.open_input_file(file) as source:
            goes_on = old and 0 <= old.through <= size and _edges(source, old.through) == (old.head, old.seam)
            through = complete_bytes(source, size)
            epoch = 0 if not old else old.epoch if goes_on else old.epoch + 1
            after[name] = Taken(file, size, modified, epoch, through, *_edges(source, through))
    return after


def segments(before: dict[str, Taken], after: dict[str, Taken], split: int) -> list[Segment]:
    """What lies between two ledgers."""
    out = []
    for name, new in sorted(after.items()):
        old = before.get(name)
        if old == new:
            continue
        if new.through < 0:
            out.append(Segment(name, new.file, new.epoch, 0, 0, -1, old if old and old.through > 0 else None))
            continue
        first = old.through if old and old.epoch == new.epoch else 0
        out += [Segment(name, new.file, new.epoch, first, at, min(at + split, new.through), new) for at in range(first, new.through, split)]
    return out


def _lines(chunks: Iterator[bytes], at: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, line) of every line that ends; chunks begin at ``at``."""
    rest: list[bytes] = []
    for chunk in chunks:
        *ended, last = chunk.split(b"\n")
        for line in ended:
            whole = b"".join([*rest, line])
            rest = []
            yield at, whole
            at += len(whole) + 1
        rest.append(last)


def _plain(part: Segment, root: str) -> Iterator[tuple[int, bytes]]:
    system, _ = files.store(root)
    with system.open_input_file(part.file) as source:
        if source.size() < part.taken.through or _edges(source, part.taken.through) != (part.taken.head, part.taken.seam):
            return  # replaced since it was planned
        inner = part.start > part.first  # a line that reaches over the split's start belongs to the split before
        start = part.start - inner
        source.seek(start)

        def chunks():
            left = part.taken.through - start
            while left > 0 and (data := source.read(min(CHUNK, left))):
                left -= len(data)
                yield data

        for at, line in _lines(chunks(), start):
            if at >= part.end:
                return
            if at > start or not inner:
                yield at, line


def _unpacked(part: Segment, root: str) -> Iterator[bytes]:
    import zstandard

    system, _ = files.store(root)
    with system.open_input_stream(part.file, compression=None) as source:
        reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
        try:
            while data := reader.read(CHUNK):
                yield data
        except zstandard.ZstdError:
            return


def _behind(part: Segment, root: str) -> bool:
    """Whether an archive begins with the bytes that were taken of the plain file."""
    old, seen, head, tail = part.taken, 0, b"", b""
    n = min(EDGE, old.through)
    for data in _unpacked(part, root):
        data = data[: old.through - seen]
        seen += len(data)
        head = head if len(head) >= n else (head + data)[:n]
        tail = (tail + data)[-n:]
        if seen == old.through:
            return (_digest(head), _digest(tail)) == (old.head, old.seam)
    return False


def read_segment(part: Segment, root: str):
    """Arrow batches of bounded size."""
    import pyarrow as pa

    epoch, skip = part.epoch, 0
    if part.end < 0:
        if part.taken and _behind(part, root):
            epoch, skip = part.taken.epoch, part.taken.through
        rows = ((at, line) for at, line in _lines(_unpacked(part, root), 0) if at >= skip)
    else:
        rows = _plain(part, root)
    at_, lines, size = [], [], 0

    def batch():
        n = len(at_)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array([epoch] * n, pa.int32()), pa.array(at_, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["path", "epoch", "at", "line"])

    for at, line in rows:
        at_.append(at)
        lines.append(line)
        size += len(line) + 64
        if size >= BATCH_BYTES:
            yield batch()
            at_, lines, size = [], [], 0
    if at_:
        yield batch()


class _Options:
    def __init__(self, options):
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.split, self.ledger = int(options.get("splitBytes", SPLIT_BYTES)), options.get("ledger")


class TranscriptReader(DataSourceReader):
    """Every transcript as it is now."""

    def __init__(self, options: _Options):
        self.o = options

    def partitions(self):
        return segments({}, advance(self.o.root, {}, discover(self.o.root, self.o.pattern)), self.o.split)

    def read(self, partition):
        if partition is not None:
            yield from read_segment(partition, self.o.root)


class TranscriptStreamReader(DataSourceStreamReader):
    """What is new since the last ledger."""

    def __init__(self, options: _Options):
        if not options.ledger:
            raise ValueError("a stream of transcripts needs the option ledger, a folder that driver and executors share")
        self.o = options

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for f in files.below(self.o.ledger) if (n := f.path.rpartition("/")[2]).endswith(".json"))

    def _load(self, number: int) -> dict[str, Taken]:
        raw = files.read(f"{self.o.ledger}/{number}.json") if number > 0 else b"{}"
        if raw is None:
            raise FileNotFoundError(f"ledger {number} is gone from {self.o.ledger}")
        return {name: Taken(*entry) for name, entry in json.loads(raw).items()}

    def initialOffset(self) -> dict:
        return {"ledger": 0}

    def latestOffset(self) -> dict:
        newest = max(self._numbers(), default=0)
        before = self._load(newest)
        after = advance(self.o.root, before, discover(self.o.root, self.o.pattern))
        if after != before:
            newest += 1
            rows = {name: [t.file, t.size, t.modified, t.epoch, t.through, t.head, t.seam] for name, t in after.items()}
            files.publish(f"{self.o.ledger}/{newest}.json", json.dumps(rows).encode())
        return {"ledger": newest}

    def partitions(self, start: dict, end: dict):
        return segments(self._load(start["ledger"]), self._load(end["ledger"]), self.o.split)

    def read(self, partition):
        yield from read_segment(partition, self.o.root)

    def commit(self, end: dict) -> None:
        """Ledgers before the last one that is done with are not asked for again."""
        for number in self._numbers():
            if number < end["ledger"]:
                files.remove(f"{self.o.ledger}/{number}.json")


class TranscriptSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TranscriptReader(_Options(self.options))

    def streamReader(self, schema):
        return TranscriptStreamReader(_Options(self.options))
