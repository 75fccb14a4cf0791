"""Words, windows and hashes of whole texts, for many texts at once, with numpy on the UTF-8 bytes of Arrow columns.

A word is a run of bytes other than space and \\t to \\r; these are ASCII, so it is also a run of such characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of pieces of `batch`; null texts are empty.

    A piece has about `most_bytes` at most, or one row. This only bounds memory: every row comes, whole.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most_bytes, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, the row it is in, and the number of words of each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(len(off) - 1, np.int64)
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]  # a row's first byte begins a word, whatever the row before ends with
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(off, starts, "right") - 1
    return starts, stops, row, np.bincount(row, minlength=len(off) - 1)


#: Bytes that are hashed at once, or one longer run; only so many powers are kept, as workers live on from stage to stage.
STRETCH = 1 << 18


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: int = STRETCH) -> np.ndarray:
    """A 64-bit hash of each byte run, from prefix sums of byte * base ** position modulo 2 ** 64.

    Starts and stops are sorted. Runs are taken in stretches of about `most` bytes, which bounds memory, not results.
    """
    if len(data) <= most:
        return _hashes(data, starts, stops)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(stops, a + most, "right")))
        out[i:j] = _hashes(data[a : stops[j - 1]], starts[i:j] - a, stops[i:j] - a)
        i = j
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    n = len(data)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first `n` powers of base and inverse at least."""
    if n <= STRETCH and _POWERS:
        return _POWERS
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, STRETCH), base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= STRETCH:
        _POWERS[:] = out
    return out


def windows(word_hash: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each `width` words in a row's text, and the index of the first word of each."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += word_hash[k : k + n] * _STEP[k]
    return mix(out[at]), at


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of `values`, one for each byte, over each row."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]
