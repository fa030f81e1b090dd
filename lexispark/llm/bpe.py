"""Byte-level BPE encoding and decoding by a public rank file.

Two tiers: a minimal perfect hash finds the pre-tokens that are in the vocabulary; for any other, a heap of candidate
merges over a linked list of its bytes joins the pair of lowest rank, leftmost first, until none is left.  What a
worker has encoded it remembers, by blank-separated chunk, up to ``MEMO`` chunks.

Defined cases: null text is empty, an empty text has no ids and decodes to no bytes; texts that look like special
tokens are ordinary text; equal rows get equal results; an empty table gives an empty one; other columns are carried,
those named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others

#: Chunks that a worker remembers: half of them new, half from before.
MEMO = 800_000
#: A blank after white space and before white space or the end: there, chunks can't be told apart at blanks alone.
_RAGGED = regex.compile(r"\s (?:\s|\Z)")
#: Only a text that has an empty chunk or one of these can be so.
_BLANK_PAIRS = [" " + c for c in map(chr, range(0x3001)) if c != " " and regex.match(r"\s", c)]


_M64 = (1 << 64) - 1
_pack = struct.Struct("<I").pack


def _slot(h: int, shift: int, n: int) -> int:
    return (((h * (2 * shift + 1)) & _M64) >> 11) % n if shift >= 0 else ~shift


class PerfectHash:
    """Minimal perfect hash by displacement: n keys in n slots; a lookup is one hash and one comparison.

    Keys fall into buckets; a bucket of several has a multiplier that sends them to free slots, found largest bucket
    first; a bucket of one has its slot itself, as its complement.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        for self.seed in range(100):
            hashes = [xxhash.xxh3_64_intdigest(k, self.seed) for k in keys]
            if self._place(keys, hashes):
                return
        raise ValueError("no perfect hash: the keys aren't distinct")

    def _place(self, keys: list[bytes], hashes: list[int]) -> bool:
        n, members = self.n, [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shifts, self.keys, self.values, free = [0] * self.buckets, [b""] * n, [-1] * n, bytearray(b"\1" * n)
        last = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not members[b]:
                break
            if len(members[b]) == 1:
                last = free.index(1, last)
                shift, slots = ~last, [last]
            for shift in range(1000 * n) if len(members[b]) > 1 else [shift]:
                slots = [_slot(hashes[i], shift, n) for i in members[b]]
                if all(free[s] for s in slots) and len({*slots}) == len(slots):
                    break
            else:
                return False
            self.shifts[b] = shift
            for i, s in zip(members[b], slots, strict=True):
                free[s], self.keys[s], self.values[s] = 0, keys[i], i
        return True

    def find(self, key: bytes) -> int:
        """The key's place in the list given, or -1."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        s = _slot(h, self.shifts[h % self.buckets], self.n)
        return self.values[s] if self.keys[s] == key else -1


class Encoder(dict):
    """Encodes and decodes; as a dict, the memo from chunk (without its leading blank) to little-endian ids."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
        self.tokens = [t for _, t in ranks]
        self.ids = [r for r, _ in ranks]
        self.by_id = dict(ranks)
        self.rank = {t: r for r, t in ranks}
        self.whole = PerfectHash(self.tokens)
        self.pattern = pattern
        self.split = regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}

    def __reduce__(self):
        return _rebuilt, (self.__dict__ | {"split": None, "old": {}},)

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.old.get(chunk)) is None:
            first, *rest = self.split(" " + chunk)
            if rest and first[0] == " " and len(first) > 1:  # the chunk's own word is worth remembering too
                out = self[first[1:]] + b"".join(map(self.encode_piece, rest))
            else:
                out = b"".join(map(self.encode_piece, (first, *rest)))
        if len(self) >= MEMO // 2:
            self.old = {**self}
            self.clear()
        self[chunk] = out
        return out

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        if (at := self.whole.find(raw)) >= 0:
            return _pack(self.ids[at])
        return struct.pack(f"<{len(ids := self.merge(raw))}I", *ids)

    def encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.encode_piece, self.split(text)))

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a piece by merging; the heap holds (rank, place of the left part, the joined bytes)."""
        rank, n = self.rank.get, len(raw)
        parts = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := rank(pair := raw[i : i + 2])) is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left, j = parts[i], after[i]
            if left is None or j >= n or len(left) + len(parts[j]) != len(pair):
                continue  # one of the two was merged since
            parts[i], parts[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(both := pair + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, both))
            if (h := before[i]) >= 0 and (r := rank(both := parts[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, both))
        return [self.rank[p] for p in parts if p is not None]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if ("" in rest or any(pair in text for pair in _BLANK_PAIRS)) and _RAGGED.search(text):
            return self.encode_pieces(text)
        return (self.encode_pieces(first) if first else b"") + b"".join(map(self.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _rebuilt(state: dict) -> Encoder:
    out = Encoder.__new__(Encoder)
    out.__dict__.update(state)
    out.split = regex.compile(state["pattern"]).findall
    return out


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def map_texts(df: DataFrame, path: str, pattern: str, fields: dict[str, tuple[str, pa.DataType]], f) -> DataFrame:
    """``df`` with columns of ``fields`` (name: Spark type, Arrow type), got by ``f(encoder, text) -> tuple`` per row.

    The encoder (a vocabulary file and its perfect hash, of fixed size) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(encoder(path, pattern))
    at = [c.lower() for c in df.columns].index("text")
    kept = others(df, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for batch in batches:
            rows = [f(enc, t.as_py()) for t in batch.column(at)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, kept + list(fields))

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{n}` {t}" for n, (t, _) in fields.items()])
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ids array<bigint> in place of any such column."""
    fields = {"ids": ("array<bigint>", pa.list_(pa.int64()))}
    return map_texts(docs, path, pattern, fields, lambda e, t: (np.frombuffer(e.encode(t), "<u4").astype(np.int64),))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` (with ids) with the decoded bytes as ``decoded``; null ids give none."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder(path, pattern))

    @F.pandas_udf("binary")
    def back(ids):
        e = shared.value
        return ids.map(lambda x: b"" if x is None else e.decode(np.asarray(x, "<u4").tobytes()))

    return rows.withColumn("decoded", back("ids"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of each text; ids stay with the worker."""

    def digests(e: Encoder, text: str | None) -> tuple[int, str, str]:
        ids = e.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

    fields = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return map_texts(docs, path, pattern, fields, digests)
