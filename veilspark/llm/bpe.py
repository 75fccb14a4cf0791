"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the pattern. Tier one is a minimal perfect hash over the vocabulary: a pre-token that
is a token itself is resolved by one probe. Tier two, for the rest, merges pairs of neighbours in rank order with a
heap over linked bytes. Pre-tokens repeat, so each worker keeps what it has resolved in a table of bounded size.
"""

from __future__ import annotations

import array
import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resolved pre-tokens that a worker keeps in each of two tables; when the newer is full, it takes the older one's place.
MEMO = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by rank; lines hold the token in base64 and its rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of distinct byte strings by hash and displace: n keys to 0 .. n - 1.

    Keys fall into buckets; from the largest on, a bucket gets the first seed that sends its keys to free slots, and a
    bucket of one key a free slot itself. `slot` of any other string is arbitrary, so callers compare the key there.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = m = max(1, n // 3)
        held: list[list[bytes]] = [[] for _ in range(m)]
        for k in keys:
            held[crc32(k) % m].append(k)
        self.seeds = seeds = [0] * m
        self.keys: list[bytes | None] = [None] * n
        taken = bytearray(n)
        by_size = sorted(range(m), key=lambda b: -len(held[b]))
        free = 0
        for b in by_size:
            if len(held[b]) > 1:
                seed = 1
                while True:
                    slots = {self._place(k, seed) for k in held[b]}
                    if len(slots) == len(held[b]) and not any(taken[s] for s in slots):
                        break
                    seed += 1
                seeds[b] = seed
                for k in held[b]:
                    s = self._place(k, seed)
                    taken[s], self.keys[s] = 1, k
            elif held[b]:
                while taken[free]:
                    free += 1
                taken[free], self.keys[free], seeds[b] = 1, held[b][0], -free - 1

    def _place(self, key: bytes, seed: int) -> int:
        return crc32(key, seed * 0x9E3779B1 & 0xFFFFFFFF) * 0x9E3779B97F4A7C15 % (1 << 64) * self.n >> 64

    def slot(self, key: bytes) -> int:
        seed = self.seeds[crc32(key) % self.buckets]
        return -seed - 1 if seed < 0 else self._place(key, seed)


class Bpe:
    """Encoder and decoder of one vocabulary; cheap to ship, its tables are built on first use in each worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self._ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "_ready": False}

    def _build(self) -> None:
        self.cut = regex.compile(self.pattern).findall
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.hash = PerfectHash(self.tokens)
        self.rank_at = [self.ranks[k] for k in self.hash.keys]
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        pairs: dict[tuple[int, int], int] = {}
        for r, t in enumerate(self.tokens):
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        self.pairs = pairs
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._ready = True

    def lookup(self, piece: bytes) -> int:
        """The rank of a whole pre-token by the perfect hash, or -1."""
        s = self.hash.slot(piece)
        return self.rank_at[s] if self.hash.keys[s] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the pair of neighbours with the lowest rank, leftmost first, is merged while there is one.

        The bytes are a linked list; a heap holds pairs by rank and place. An entry is stale if its left end is gone or
        its pair's ends have changed since. O(n log n) for any length.
        """
        n = len(piece)
        byte, pairs = self.byte, self.pairs
        ids = [byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := pairs.get((r, ids[k]))) is not None:
                    heappush(heap, (s, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (s := pairs.get((ids[h], r))) is not None:
                heappush(heap, (s, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def _resolve(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode()
            rank = self.lookup(raw)
            found = array.array("I", [rank] if rank >= 0 else self.merge(raw)).tobytes()
        if len(piece) <= 64:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self._ready:
            self._build()
        get, resolve = self.memo.get, self._resolve
        return b"".join([get(p) or resolve(p) for p in self.cut(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, given as `encode` gives them."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_bpe() -> Bpe:
    """The public 50k byte-level vocabulary, read on the driver; workers get it with the code (under 1 MB)."""
    import public_tokenizers

    return Bpe(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def _map(docs: DataFrame, id_col: str, text_col: str, bpe: Bpe, schema: str, row: Callable[[Bpe, str], tuple], kinds: list[pa.DataType]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value  # a worker keeps it between tasks
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                cols = list(zip(*(row(tool, t or "") for t in texts.slice(lo, 256).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST_KINDS = [pa.int64(), pa.string(), pa.string()]


def _digest(b: Bpe, text: str) -> tuple:
    ids = b.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b.decode(ids)).hexdigest()


def encode(docs: DataFrame, bpe: Bpe, *, id_col: str = "doc_id", text_col: str = "text", digests_too: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text; with `digests_too`, also what `digests` gives."""
    if not digests_too:
        return _map(docs, id_col, text_col, bpe, "doc_id long, ids array<int>", lambda b, t: (np.frombuffer(b.encode(t), "<i4"),), [pa.list_(pa.int32())])

    def row(b: Bpe, text: str) -> tuple:
        ids = b.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b.decode(ids)).hexdigest(), np.frombuffer(ids, "<i4")

    return _map(docs, id_col, text_col, bpe, f"{_DIGESTS}, ids array<int>", row, [*_DIGEST_KINDS, pa.list_(pa.int32())])


def digests(docs: DataFrame, bpe: Bpe, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes they decode to, of every row; other columns aren't read.

    Null text is empty: no tokens. Ids may be null or repeat. Empty tables give empty results. A text of any length is
    encoded whole; a single pre-token of n bytes takes O(n log n).
    """
    return _map(docs, id_col, text_col, bpe, _DIGESTS, _digest, _DIGEST_KINDS)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return digests(table(spark, sf_dir, "documents"), default_bpe())
