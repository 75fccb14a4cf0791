"""Tokens, letters and features of many lower-case texts at once, with numpy on their UTF-16 units.

Characters beyond the Basic Multilingual Plane are two units of no class here; tokens and texts that hold some are left to
the caller, who has the slower way that reads characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

from .textbytes import mix

ALPHA, SPACE, STOP, ALNUM, LETTER, ONE, SEP = (1 << k for k in range(7))
#: Characters of a piece of texts, which bounds memory; and of a word that is looked up here.
PIECE, LONGEST = 200_000, 32
_WORD = np.uint64(0xA0761D6478BD642F)
_MASK = np.array([(1 << 16 * k) - 1 for k in range(5)], np.uint64)


@cache
def kinds(stops: str, ones: str, separators: str) -> np.ndarray:
    """The classes of each unit: `ones` count as single characters with letters and digits, `separators` as blanks between them."""
    out = np.zeros(1 << 16, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        alnum, space = c.isalnum(), c.isspace()
        out[k] = ALPHA * c.isalpha() | SPACE * space | STOP * (c in stops) | ALNUM * alnum | LETTER * (alnum and not c.isdecimal()) | ONE * (alnum or c in ones) | SEP * (space or c in separators)
    return out


def pieces(texts: Sequence[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of `texts` with about `most` characters at most, or one text. Every text comes, whole."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Units:
    """The units of some texts in a row, with line ends around each text."""

    def __init__(self, texts: Sequence[str], table: np.ndarray):
        some = [t.encode("utf-16-le", "surrogatepass") for t in texts]
        self.data = b"\n\0\n\0" + b"\n\0".join(some) + b"\n\0" * 5
        self.u, self.n = np.frombuffer(self.data, np.uint16), len(texts)
        self.kind = table[self.u]
        self.bounds = 2 + np.cumsum([0, *(len(b) // 2 + 1 for b in some)])
        self.wide = [i for i, (t, b) in enumerate(zip(texts, some, strict=True)) if len(b) != 2 * len(t)]  # texts with two units a character somewhere

    def row(self, at: np.ndarray) -> np.ndarray:
        """The text that each of the sorted places is in."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, self.bounds)))

    def runs(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of true; both ends of the units are false."""
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        return edges[::2], edges[1::2]

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start of each token, its end without one stop, whether it has letters only, none three times running, and the token's row."""
        starts, ends = self.runs((self.kind & SPACE) == 0)
        ends = ends - ((self.kind[ends - 1] & STOP) != 0)
        other = (self.kind & ALPHA) == 0
        again = self.u[1:] == self.u[:-1]
        other[2:] |= again[1:] & again[:-1]
        so_far = np.cumsum(other, dtype=np.int32 if len(other) < 1 << 31 else np.int64)
        return starts, ends, (so_far[ends - 1] == so_far[starts - 1]) & (ends > starts), self.row(starts)

    def doubles(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of letters after their like in the tokens at `starts`, which token each is in, and the letters around: itself, those before and after both, ^ at the edges, as 16 bits each."""
        at = np.flatnonzero((self.u[1:] == self.u[:-1]) & ((self.kind[1:] & ALPHA) != 0)) + 1
        which = np.searchsorted(starts, at, "right") - 1
        inside = (which >= 0) & (at < ends[which]) if len(starts) else np.zeros(len(at), bool)
        at, which = at[inside], which[inside]
        edge, c = np.uint64(ord("^")), self.u[at].astype(np.uint64)
        before = np.where(at - 2 >= starts[which], self.u[at - 2], edge)
        after = np.where(at + 1 < ends[which], self.u[at + 1], edge)
        return at, which, c << np.uint64(32) | before << np.uint64(16) | after

    def text(self, start: int, end: int) -> str:
        return self.data[2 * start : 2 * end].decode("utf-16-le", "surrogatepass")

    def apart(self) -> list[int]:
        """The texts where three single characters in a row may stand apart: a single one between separators, after another and before a third."""
        starts, ends = self.runs((self.kind & SEP) == 0)
        k = np.flatnonzero((ends[1:-1] - starts[1:-1] == 1) & ((self.kind[starts[1:-1]] & ONE) != 0)) + 1
        before, after, kind = ends[k - 1], starts[k + 1], self.kind
        k = k[((kind[before - 1] & ONE) != 0) & ((kind[before - 2] & ALNUM) == 0) & ((kind[after] & ONE) != 0) & ((kind[after + 1] & ALNUM) == 0)]
        return sorted({*(np.searchsorted(self.bounds, starts[k], "right") - 1).tolist(), *self.wide})

    def threes(self) -> tuple[np.ndarray, np.ndarray]:
        """Three units in a row of words of letters, ^ at the edges, as 16 bits each, and how often; words with a letter three times running don't count."""
        letter = (self.kind & LETTER) != 0
        u = self.u
        thrice = np.flatnonzero(letter[2:] & (u[2:] == u[1:-1]) & (u[2:] == u[:-2])) + 2
        if len(thrice):
            starts, ends = self.runs(letter)
            k = np.unique(np.searchsorted(starts, thrice, "right") - 1)
            change = np.zeros(len(u), np.int8)
            change[starts[k]] = 1
            change[ends[k]] = -1
            letter &= np.cumsum(change, dtype=np.int8) == 0
        there = np.zeros(1 << 16, bool)
        there[u[letter]] = True
        names = np.concatenate([[ord("^")], np.flatnonzero(there)]).astype(np.uint64)
        size = len(names)
        kind = np.uint32 if size**3 < 1 << 32 else np.uint64
        number = np.zeros(1 << 16, kind)
        number[there] = np.arange(1, size, dtype=kind)
        v = np.where(letter, number[u], kind(0))
        a, b, c = v[:-2], v[1:-1], v[2:]
        some = np.flatnonzero((b | c) != 0)
        a, b, c = a[some], b[some], c[some]
        a[b == 0] = 0
        codes = np.sort((a * kind(size) + b) * kind(size) + c)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(codes)))
        codes = codes[first].astype(np.int64)
        a, b, c = names[codes // size**2], names[codes // size % size], names[codes % size]
        return a << np.uint64(32) | b << np.uint64(16) | c, n


def word_keys(u: np.ndarray, starts: np.ndarray, sizes: np.ndarray, over: np.ndarray | int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, 64-bit keys) of the words of units at `starts`, of 1 to LONGEST, and of their beginnings of 4 to 8 that are longer than `over`; 4 units follow the last."""
    fours = np.ndarray((len(u) - 3,), "<u8", u, strides=(2,))
    which, h, words, over = np.arange(len(starts)), None, np.empty(len(starts), np.uint64), np.maximum(np.broadcast_to(over, len(starts)), 3)
    for at in range(0, LONGEST, 4):
        if at:
            left = sizes[which] > at
            which, h = which[left], h[left]
            if not len(which):
                break
        size, four = sizes[which] - at, fours[starts[which] + at]
        base = h if at else np.zeros(len(which), np.uint64)
        if at <= 4:
            for n in range(1, 5) if at else (4,):
                there = np.flatnonzero((size >= n) & (over[which] < at + n))
                yield which[there], mix((four[there] & _MASK[n]) + base[there])
        h = mix((four & _MASK[np.minimum(size, 4)]) + base)
        words[which] = h
    yield np.arange(len(starts)), words ^ _WORD


def summed(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its counts."""
    each, at = np.unique(np.concatenate(codes), return_inverse=True)
    out = np.zeros(len(each), np.int64)
    np.add.at(out, at, np.concatenate(n))
    return each, out


class Places:
    """The places of distinct 64-bit keys. Tables take one key a slot; those that find theirs taken go to the next table."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        left, self.tables = np.arange(len(keys), dtype=np.int32), []
        while len(left):
            shift = np.uint64(64 - max(8, (8 * len(left)).bit_length()))
            by = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.tables) + 1)) % (1 << 64))
            slot = (keys[left] * by) >> shift
            table = np.full(1 << (64 - int(shift)), -1, np.int32)
            table[slot] = left
            self.tables.append((shift, by, table))
            left = left[table[slot] != left]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of `keys` are there, their places)."""
        which, out = np.arange(len(keys)), []
        for shift, by, table in self.tables:
            at = table[(keys[which] * by) >> shift]
            taken = np.flatnonzero(at >= 0)  # a key that is there leaves no slot of its own empty
            which, at = which[taken], at[taken]
            same = self.keys[at] == keys[which]
            out.append((which[same], at[same]))
            which = which[~same]
            if not len(which):
                break
        none = np.zeros(0, np.int64)
        return (np.concatenate([w for w, _ in out]), np.concatenate([a for _, a in out])) if out else (none, none)
