"""Byte-level BPE over Arrow batches.

Text is cut before every space between two characters that are no spaces. Every alternative of the splitting pattern
starts a new match there, so pieces can be encoded apart and their ids joined. Arrow cuts a batch and finds its
distinct pieces; the pattern splits these into words, each is looked up once in a bounded cache, and NumPy copies the ids
to where the pieces stand. Words that the cache lacks are written in the byte alphabet and merged by the ``tokenizers`` model. Texts
with other runs of white space, and those that hold an added token of the tokenizer file (cut out first, as the library
does; it stands for its own id), are encoded one by one.

Nulls count as the empty text, which has no ids. Repeated rows are encoded alike. Input columns other than the key and
the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
from functools import lru_cache
from itertools import accumulate, chain, repeat

import numpy as np
from pyspark.sql import DataFrame

from threadloom.llm.common import text_or_empty

CACHE_WORDS = 500_000
CACHE_IDS = 8_000_000
BATCH_BYTES = 8 << 20
_SIGNS = "".join(chr(c) for c in range(33, 127) if chr(c) != "'" and not chr(c).isalnum())
# Letters of Latin-1, a space before them, other signs of ASCII than the apostrophe after them: one or two matches.
_LETTERS = r"^ ?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+"
_PLAIN = _LETTERS + r"[!-&(-/:-@\[-`{-~]*$"
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r"(?<=\S) (?=\S)")
# The same for Arrow, whose \s is that of ASCII: a space before the end or before any white space of Unicode.
_ODD_SPACE_ARROW = r" (?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stays, the others follow from code point 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = (b for b in range(256) if b not in set(keep))
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as src:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in src if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by lower ranks leaves of a token (None: they never meet)."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_from_ranks(ranks: dict[bytes, int]) -> str:
    """JSON of a ``tokenizers`` BPE that merges as the ranks say; whole pieces in the vocabulary are taken as they are."""
    to_char = byte_alphabet()
    spell = lambda raw: "".join(to_char[b] for b in raw)
    merges = [[spell(p) for p in pair] for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (pair := _last_merge(t, ranks))]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {spell(t): r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model})


def _strings(array) -> list[str]:
    """``to_pylist`` without a scalar object for each string."""
    return array.to_numpy(zero_copy_only=False).tolist()


def runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (lengths[0] numbers), then those of begins[1], and so on."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()), dtype=begins.dtype)


def byte_slices(batches, column: int, size: int = BATCH_BYTES):
    """Pieces of the Arrow batches whose strings in ``column`` hold about ``size`` bytes, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


class ByteBPE:
    """Encode and decode with a ``tokenizers`` BPE model and the pattern that splits text before merging."""

    def __init__(self, tokenizer_json: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenize = Tokenizer.from_str(tokenizer_json).model.tokenize
        self.split = regex.compile(pattern).findall
        self.to_char = byte_alphabet()
        self.spelling = np.array([ord(self.to_char[b]) for b in range(256)], dtype="<u2")
        self._forget()
        size, from_char = 0, {c: b for b, c in self.to_char.items()}
        parsed = json.loads(tokenizer_json)
        vocab, added = parsed["model"]["vocab"], parsed.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_added = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if added else None
        size = 1 + max([*vocab.values(), *(t["id"] for t in added)], default=-1)
        self.token_bytes = [b""] * size
        for spelled, i in vocab.items():
            if spelled not in self.added:
                self.token_bytes[i] = bytes(from_char[c] for c in spelled)
        for t in added:
            self.token_bytes[t["id"]] = t["content"].encode()
        self.token_len = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)

    def _forget(self) -> None:
        """Empty the cache: ``known`` numbers the words, whose ids stand in ``ids`` from ``begins`` on."""
        self.known: dict[str, int] = {}
        self.ids, self.begins, self.sizes = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.n_ids = self.n_words = 0

    def _learn(self, words: list[str]) -> None:
        """Merge distinct words that the cache lacks; a word is one match of the pattern."""
        for at in range(0, len(words), 16384):
            part = words[at : at + 16384]
            raw = [w.encode() for w in part]
            spelled = self.spelling[np.frombuffer(b"".join(raw), dtype=np.uint8)].tobytes().decode("utf-16-le")
            ends = list(accumulate(map(len, raw)))
            tokens = [self.tokenize(spelled[a:b]) for a, b in zip([0, *ends], ends)]
            sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
            ids = np.fromiter((t.id for own in tokens for t in own), dtype="<u4", count=int(sizes.sum()))
            n, m = self.n_words, self.n_ids
            while n + len(part) > len(self.sizes):
                self.begins, self.sizes = np.resize(self.begins, 2 * len(self.begins)), np.resize(self.sizes, 2 * len(self.sizes))
            while m + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[m : m + len(ids)] = ids
            self.sizes[n : n + len(part)] = sizes
            self.begins[n : n + len(part)] = m + np.cumsum(sizes) - sizes
            self.known.update(zip(part, range(n, n + len(part))))
            self.n_words, self.n_ids = n + len(part), m + len(ids)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers in the cache, new words learned."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(map(words.__getitem__, new))))
            at[new] = np.fromiter(map(self.known.__getitem__, map(words.__getitem__, new)), dtype=np.int64, count=len(new))
        return at

    def _words(self, pieces) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, how many each piece has) for an Arrow array of distinct pieces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(pieces, _PLAIN)
        split = [self.split(p) for p in _strings(pieces.filter(pc.invert(plain)))]
        stems = pc.if_else(plain, pc.utf8_rtrim(pieces, _SIGNS), pa.scalar("", pieces.type)).dictionary_encode()
        tails = pc.if_else(plain, pc.replace_substring_regex(pieces, _LETTERS, ""), pa.scalar("", pieces.type)).dictionary_encode()
        first = self._numbers(_strings(stems.dictionary))[stems.indices.to_numpy()]
        second = self._numbers(_strings(tails.dictionary))[tails.indices.to_numpy()]
        others = self._numbers(list(chain.from_iterable(split)))
        is_plain = plain.to_numpy(zero_copy_only=False)
        counts = np.where(is_plain, 2, 0)
        counts[~is_plain] = [len(own) for own in split]
        at = np.cumsum(counts) - counts
        words = np.empty(int(counts.sum()), dtype=np.int64)
        words[at[is_plain]], words[at[is_plain] + 1] = first[is_plain], second[is_plain]
        words[runs(at[~is_plain], counts[~is_plain])] = others
        return words, counts

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut_added and len(parts := self.cut_added(text)) > 1:
            return b"".join(self.added[part] if at % 2 else self.encode(part) for at, part in enumerate(parts))
        import pyarrow as pa

        first, *rest = _CUT.split(text)
        pieces = pa.array([first, *(f" {body}" for body in rest)]).dictionary_encode()
        return self._gather(pieces.dictionary, pieces.indices.to_numpy().astype(np.int64))[0].tobytes()

    def _gather(self, pieces, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has) of the pieces numbered ``at``; ``pieces`` holds each once."""
        if len(self.known) >= CACHE_WORDS or self.n_ids > CACHE_IDS:
            self._forget()
        words, counts = self._words(pieces)
        begins = np.cumsum(counts) - counts
        sizes = self.sizes[words]
        before = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[runs(self.begins[words], sizes)]
        own = (before[begins + counts] - before[begins])[at]
        return flat[runs(before[begins][at], own)], own

    def encode_batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) for an Arrow array of strings without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        single = pc.match_substring_regex(texts, _ODD_SPACE_ARROW)
        for content in self.added:
            single = pc.or_(single, pc.match_substring(texts, content))
        alone = np.flatnonzero(single.to_numpy(zero_copy_only=False))
        cut = pc.split_pattern(pc.if_else(single, pa.scalar("", texts.type), texts) if len(alone) else texts, " ")
        bodies = cut.flatten().dictionary_encode()
        offsets = cut.offsets.to_numpy().astype(np.int64)
        firsts = offsets[:-1] - offsets[0]
        slot = 2 * bodies.indices.to_numpy().astype(np.int64) + 1
        slot[firsts] -= 1  # the first piece of a text has no space before it
        used = np.flatnonzero(np.bincount(slot, minlength=2 * len(bodies.dictionary)))
        number = np.zeros(2 * len(bodies.dictionary), dtype=np.int64)
        number[used] = np.arange(len(used))
        spaces = pa.DictionaryArray.from_arrays(pa.array(used & 1), pa.array(["", " "], texts.type)).cast(texts.type)
        ids, each = self._gather(pc.binary_join_element_wise(spaces, bodies.dictionary.take(pa.array(used >> 1)), ""), number[slot])
        counts = np.add.reduceat(each, firsts)
        if not len(alone):
            return ids, counts
        own = [np.frombuffer(self.encode(t.as_py()), dtype="<u4") for t in texts.take(pa.array(alone))]
        begins = np.cumsum(counts) - counts
        counts[alone] = [len(o) for o in own]
        begins[alone] = len(ids) + np.cumsum(counts[alone]) - counts[alone]
        return np.concatenate([ids, *own])[runs(begins, counts)], counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes the ids stand for; a character split over tokens comes back whole."""
        parts = (ids[at : at + (1 << 20)] for at in range(0, len(ids), 1 << 20))
        return b"".join(self.all_bytes[runs(self.token_at[p], self.token_len[p])].tobytes() for p in parts)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """[start, end) in characters for each id; tokens that share a split character both cover it."""
        raw = np.frombuffer(self.decode(ids), dtype=np.uint8)
        if not len(raw):
            return np.zeros((len(ids), 2), dtype=np.int64)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.token_len[ids])
        starts = ends - self.token_len[ids]
        return np.stack([character[starts], character[ends - 1] + 1], axis=1)


@lru_cache(maxsize=2)
def shared_bpe(tokenizer_json: str, pattern: str) -> ByteBPE:
    """One encoder, and so one cache of pieces, for all tasks that a worker process runs."""
    return ByteBPE(tokenizer_json, pattern)


def encode_documents(docs: DataFrame, tokenizer_json: str, pattern: str, key: str = "doc_id", text: str = "text", with_offsets: bool = False) -> DataFrame:
    """(key, ids binary, decoded binary[, offsets]) per row, in input partitions: no shuffle.

    ``ids`` holds little-endian unsigned 32-bit integers, ``decoded`` what they decode to; ``offsets`` has one
    [start, end) pair of characters for each id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    types = dict(docs.dtypes)

    def run(batches):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = shared_bpe(shared.value, pattern)
        for part in byte_slices(batches, 1):
            arrays = np.split(*_ends(*bpe.encode_batch(part.column(1))))
            out = {"key": part.column(0), "ids": pa.array([a.tobytes() for a in arrays], pa.binary()), "decoded": pa.array([bpe.decode(a) for a in arrays], pa.binary())}
            if with_offsets:
                out["offsets"] = pa.array([bpe.offsets(a).tolist() for a in arrays], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"key {types[key]}, ids binary, decoded binary" + ", offsets array<array<bigint>>" * with_offsets
    return docs.select(docs[key].alias("key"), text_or_empty(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def _ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids, np.cumsum(counts)[:-1]


def encode_digests(docs: DataFrame, tokenizer_json: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row; ids and bytes are hashed where they are made."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    types = dict(docs.dtypes)

    def run(batches):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = shared_bpe(shared.value, pattern)

        def digests(raw: bytes, sizes: np.ndarray):
            view, ends = memoryview(raw), np.cumsum(sizes)
            return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip((ends - sizes).tolist(), ends.tolist())], pa.string())

        for part in byte_slices(batches, 1):
            ids, counts = bpe.encode_batch(part.column(1))
            before = np.concatenate([[0], np.cumsum(bpe.token_len[ids])])
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_pydict({"key": part.column(0), "n_tokens": pa.array(counts), "ids_sha256": digests(ids.tobytes(), 4 * counts), "decoded_sha256": digests(bpe.decode(ids), before[ends] - before[ends - counts])})

    schema = f"key {types[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[key].alias("key"), text_or_empty(text)).mapInArrow(run, schema).withColumnRenamed("key", key)
