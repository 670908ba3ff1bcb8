"""Token ids in patched frame-of-reference files.

A file holds documents in ascending key order. Ids are cut into blocks of 128. A block stores its minimum and the
differences to it, packed at the width that one of the percentiles in ``PERCENTILES`` gives at the least cost; wider
differences go to the block's exception list. An index holds where each block's words and exceptions start.

Layout (little-endian): magic ``PFR1``, counts of ids, documents, blocks, packed words, exceptions (u64); keys i64,
lengths u64; block minima u32, widths u8, word starts u32, exception starts u32; words u64; exception positions u8,
differences u32.

Null texts are empty and hold only the end id. A null key sorts first (the file marks it by the top bit of its length)
and comes back null. Equal keys keep all their rows, in an order of their own. An empty table gives no files and
no rows. Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.bpe import byte_slices, shared_bpe
from threadloom.llm.common import materialize, partitions_for, read_bytes, shared_dir, text_or_empty, write_bytes

BLOCK = 128
PERCENTILES = (0.90, 0.95, 0.99, 1.0)
FILE_IDS = 4_000_000
NULL_KEY = np.uint64(1 << 63)
_HEAD = struct.Struct("<4s5Q")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) values below 2**width -> (n, 2 * width) words."""
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    bits = np.unpackbits(np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), BLOCK, kind.itemsize), axis=2, bitorder="little", count=width)
    return np.packbits(bits.reshape(len(values), BLOCK * width), axis=1, bitorder="little").view("<u8")


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Reverses ``_pack``."""
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").reshape(len(words), BLOCK, width)
    wide = np.zeros((len(words), BLOCK, kind.itemsize * 8), dtype=np.uint8)
    wide[:, :, :width] = bits
    return np.packbits(wide, axis=2, bitorder="little").view(kind).reshape(len(words), BLOCK).astype(np.uint32)


def _by_width(widths: np.ndarray, step: int = 4096):
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), step):
            yield width, rows[at : at + step]


def encode_blocks(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file for documents with these keys and id counts; ``ids`` are theirs, one after the other."""
    n, n_blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, dtype=np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    grid = padded.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    # The exponent of a float is the bit length of a whole number; zero has none.
    exponent = (diff.astype(np.float64).view(np.uint64) >> np.uint64(52)).astype(np.int16)
    bits = np.maximum(exponent - 1022, 0).astype(np.uint8)
    counts = np.bincount((np.arange(n_blocks, dtype=np.int64)[:, None] * 33 + bits).ravel(), minlength=33 * n_blocks)
    within = np.cumsum(counts.reshape(n_blocks, 33), axis=1)
    best, widths = np.full(n_blocks, 1 << 30), np.zeros(n_blocks, dtype=np.uint8)
    for p in PERCENTILES:
        w = (within >= int(np.ceil(p * BLOCK))).argmax(axis=1)
        cost = 16 * w + 5 * (BLOCK - within[np.arange(n_blocks), w])
        better = cost < best
        best[better], widths[better] = cost[better], w[better]
    rows, cols = np.nonzero(bits > widths[:, None])
    word_at = np.concatenate([[0], np.cumsum(2 * widths.astype(np.int64))])
    exc_at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_blocks))])
    words = np.zeros(int(word_at[-1]), dtype="<u8")
    for width, at in _by_width(widths):
        if width:
            mask = np.uint32((1 << width) - 1)
            words[(word_at[at][:, None] + np.arange(2 * width)).ravel()] = _pack(diff[at] & mask, width).ravel()
    parts = [
        _HEAD.pack(b"PFR1", n, len(keys), n_blocks, len(words), len(rows)),
        keys.astype("<i8"), lengths.astype("<u8"),
        low.astype("<u4"), widths, word_at[:-1].astype("<u4"), exc_at[:-1].astype("<u4"),
        words, cols.astype(np.uint8), diff[rows, cols].astype("<u4"),
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def decode_blocks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a file."""
    magic, n, n_docs, n_blocks, n_words, n_exc = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a token block file")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    keys, lengths = take("<i8", n_docs), take("<u8", n_docs)
    low, widths, word_at, exc_at = take("<u4", n_blocks), take("u1", n_blocks), take("<u4", n_blocks), take("<u4", n_blocks)
    words, cols, diffs = take("<u8", n_words), take("u1", n_exc), take("<u4", n_exc)
    grid = np.zeros((n_blocks, BLOCK), dtype=np.uint32)
    for width, rows in _by_width(widths):
        if width:
            grid[rows] = _unpack(words[(word_at[rows].astype(np.int64)[:, None] + np.arange(2 * width)).ravel()].reshape(len(rows), 2 * width), width)
    blocks = np.repeat(np.arange(n_blocks), np.diff(np.append(exc_at.astype(np.int64), n_exc)))
    grid[blocks, cols] = diffs
    grid += low[:, None]
    return keys, lengths, grid.reshape(-1)[:n]


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, through the index of block starts."""
    _, n, n_docs, n_blocks, n_words, n_exc = _HEAD.unpack_from(data)
    base = _HEAD.size + 16 * n_docs
    low = struct.unpack_from("<I", data, base + 4 * block)[0]
    width = data[base + 4 * n_blocks + block]
    starts = base + 5 * n_blocks
    word = struct.unpack_from("<I", data, starts + 4 * block)[0]
    exc = struct.unpack_from("<I", data, starts + 4 * (n_blocks + block))[0]
    end = struct.unpack_from("<I", data, starts + 4 * (n_blocks + block + 1))[0] if block + 1 < n_blocks else n_exc
    body = starts + 8 * n_blocks
    row = np.zeros((1, BLOCK), dtype=np.uint32)
    if width:
        row = _unpack(np.frombuffer(data, "<u8", 2 * width, body + 8 * word).reshape(1, -1), width)
    cols = np.frombuffer(data, "u1", end - exc, body + 8 * n_words + exc)
    row[0, cols] = np.frombuffer(data, "<u4", end - exc, body + 8 * n_words + n_exc + 4 * exc)
    return (row[0] + np.uint32(low))[: n - BLOCK * block]


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str, out_dir: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write block files in ascending key order; returns the manifest, one row per file.

    One range shuffle of the texts; each task encodes its sorted range and flushes a file when ``FILE_IDS`` ids
    or more have gathered, so memory stays bounded. Only files that the manifest names count: what a lost attempt wrote is
    never read. Files are in order by (part, seq).
    """
    # Rows of one key, null ones too, are told apart by a hash of their text, so that many of them fill many ranges.
    rows = docs.select(docs[key].cast("long").alias("key"), text_or_empty(text)).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions_for(docs), "key", "tie").sortWithinPartitions("key", "tie")
    with open(tokenizer_path) as src:
        tokenizer = docs.sparkSession.sparkContext.broadcast(src.read())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = shared_bpe(tokenizer.value, pattern)
        part, seq = TaskContext.get().partitionId(), 0
        held, count = [], 0

        def flush():
            nonlocal seq, held, count
            keys, lengths, ids = (np.concatenate(column) for column in zip(*held))
            data = encode_blocks(keys, lengths, ids)
            uri = f"{out_dir}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.pfor"
            write_bytes(uri, data)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [uri], "n_docs": [len(keys)], "n_ids": [len(ids)], "n_bytes": [len(data)]})
            held, count, seq = [], 0, seq + 1
            return row

        for piece in byte_slices(batches, 1):
            ids, counts = bpe.encode_batch(piece.column(1))
            closed = np.full(len(ids) + len(counts), end_id, dtype="<u4")
            own = np.ones(len(closed), dtype=bool)
            own[np.cumsum(counts + 1) - 1] = False
            closed[own] = ids
            nulls = piece.column(0).is_null().to_numpy(zero_copy_only=False)
            held.append((piece.column(0).fill_null(0).to_numpy(), (counts + 1).astype(np.uint64) | NULL_KEY * nulls, closed))
            count += len(closed)
            if count >= FILE_IDS:
                yield flush()
        if held:
            yield flush()

    manifest = ranged.mapInArrow(run, "part bigint, seq bigint, uri string, n_docs bigint, n_ids bigint, n_bytes bigint")
    return materialize(manifest, "token-manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document, from the files alone; start counts all ids before it."""
    files = manifest.count()
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, lengths, ids = decode_blocks(read_bytes(uri))
                nulls, lengths = lengths >= NULL_KEY, (lengths & ~NULL_KEY).astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, mask=nulls), "start": pa.array(base + starts), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64())})

    return placed.select("uri", "base").repartition(max(1, min(files, 4096))).mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def token_files(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to shared storage, then read them back."""
    out = shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer_path, pattern, out, end_id, key, text), key)
