"""Toxicity scores of deobfuscated text.

A writer may disguise a word: digits and signs for letters, separators between letters, letters repeated. That is a noisy
channel, and a disguised token is a lattice of letters that each character may stand for (or nothing). `Restorer`
finds the likeliest path under a character language model of plain words, by Viterbi. Tokens that show no sign of
disguise have one path only and pass as they are. A linear model of words and word beginnings scores the restored text:
each counts by being there, and by its share of the text's tokens.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import remainder
from .units import LONGEST, Places, Units, kinds, pieces, summed, word_keys

LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "o"}
SEPARATORS = ".-_*~'/ ,:;+"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_RUN = re.compile(r"([^\W\d_])\1\1")
_ONES = "@$!€£¡#%("
_ONE = rf"(?:[^\W_]|[{_ONES}])"
_SPACED = re.compile(rf"(?<![^\W_])(?=[^\s]){_ONE}(?:[\s{re.escape(SEPARATORS)}]++{_ONE}){{2,}}(?![^\W_])")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_STOPS = ".,;:!?\"')]}"
_MANY = re.compile(r"(.)\1+", re.S)
_SIGN = re.compile(f"[{re.escape(''.join(LEET) + SEPARATORS)}]")
_TWICE = re.compile(r"([^\W\d_])\1")


def threes(words: Counter) -> Counter:
    """Counts of three characters in a row of words, with ^ for the edges."""
    out: Counter = Counter()
    for w, n in words.items():
        s = f"^^{w}^"
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


def plain_words(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W\d_]+", text.lower()) if not _RUN.search(w)]


class Restorer:
    """Viterbi over a token's lattice; `costs` are -log probabilities of a character after two others, ^ for the edges."""

    def __init__(self, words: Counter, swap: float = 1.5, drop: float = 0.7):
        self._learn(threes(words), swap, drop)

    @classmethod
    def of_threes(cls, three: dict[str, int], swap: float = 1.5, drop: float = 0.7) -> Restorer:
        """The same from counts of three characters in a row."""
        out = cls.__new__(cls)
        out._learn(three, swap, drop)
        return out

    def _learn(self, three: dict[str, int], swap: float, drop: float):
        two: Counter = Counter()
        for k, n in three.items():
            two[k[:2]] += n
        symbols = max(2, len({k[2] for k in three}))
        self.cost = {k: -float(np.log((n + 0.1) / (two[k[:2]] + 0.1 * symbols))) for k, n in three.items()}
        self.unseen = {k: -float(np.log(0.1 / (n + 0.1 * symbols))) for k, n in two.items()}
        self.floor = float(np.log(symbols)) + 2
        self.swap, self.drop = swap, drop
        self._options: dict[tuple[str, bool], list[tuple[str, float]]] = {}

    def step(self, context: str, c: str) -> float:
        k = context + c
        return self.cost[k] if k in self.cost else self.unseen.get(context, self.floor)

    def options(self, c: str, again: bool) -> list[tuple[str, float]]:
        """What a character may stand for, with its cost; '' is nothing. `again`: it follows its like."""
        out = self._options.get((c, again))
        if out is None:
            out = [(c, 0.0)] if c.isalnum() else []
            out += [(x, self.swap) for x in LEET.get(c, "")]
            if again and c.isalpha() or c in SEPARATORS or not out:
                out.append(("", self.drop))
            self._options[c, again] = out
        return out

    def single(self, before: str, c: str, after: str) -> bool:
        """Whether `c` costs less once than twice between two other letters."""
        return self.drop + self.step(before + c, after) < self.step(before + c, c) + self.step(c + c, after)

    def _without_doubles(self, token: str) -> str:
        """`restore` for letters, none three times running: the choices are doubled letters, whose paths meet at the next letter."""
        out, at = "", 0
        for m in _TWICE.finditer(token):
            i = m.end() - 1
            c, before, after = token[i], token[i - 2] if i > 1 else "^", token[i + 1] if i + 1 < len(token) else "^"
            if self.single(before, c, after):
                out, at = out + token[at:i], i + 1
        return out + token[at:]

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        return [self.options(c, i > 0 and c == token[i - 1]) for i, c in enumerate(token)]

    def restore(self, token: str) -> str:
        """The likeliest plain form of a lower-case token; time is linear in its length.

        While there is one path only, its cost can't matter: characters before the first choice, and those after the
        last one once all paths meet, are taken as they are.
        """
        if token.isalpha() and not _RUN.search(token):
            return self._without_doubles(token)
        known, unseen, floor = self.cost.get, self.unseen.get, self.floor
        lattice = self.lattice(token)
        open_at = [i for i, options in enumerate(lattice) if len(options) > 1]
        if not open_at:
            return "".join([options[0][0] for options in lattice])
        first, last = open_at[0], open_at[-1]
        head = "".join([options[0][0] for options in lattice[:first]])
        rest = ""
        states: dict[str, tuple[float, tuple | None]] = {f"^^{head}"[-2:]: (0.0, None)}
        for i in range(first, len(lattice)):
            if i > last and len(states) == 1:
                rest = "".join([options[0][0] for options in lattice[i:]])
                break
            after: dict[str, tuple[float, tuple | None]] = {}
            for context, (cost, path) in states.items():
                for c, extra in lattice[i]:
                    if c:
                        k = context + c
                        step = known(k)
                        new, k, to = cost + extra + (unseen(context, floor) if step is None else step), k[1:], (c, path)
                    else:
                        new, k, to = cost + extra, context, path
                    if k not in after or new < after[k][0]:
                        after[k] = (new, to)
            states = after
        _, path = min(((cost + self.step(context, "^"), path) for context, (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return f"{head}{''.join(reversed(out))}{rest}"


def disguised(token: str) -> bool:
    """Whether a token has more than one path: signs, separators or digits among letters, or a letter twice running."""
    return bool(_TWICE.search(token) or (_SIGN.search(token) and _LETTER.search(token)))


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 8 letters."""
    return [f"{word}$", *(word[:n] for n in range(4, min(9, len(word) + 1)))]


#: One letter for all that may be written alike: what stands for a letter, and i for l.
_ALIKE = str.maketrans({**{k: v[0].replace("l", "i") for k, v in LEET.items() if k not in "*+"}, "l": "i"})
_OPEN = re.compile(r"[*+]")


def outline(token: str) -> str:
    """A token as its signs may be read, without separators and repetition: equal for a token without * or + and each of its paths."""
    return _MANY.sub(r"\1", re.sub(r"[\W_]+", "", token.translate(_ALIKE)))


class Reader:
    """Counts a text's features in its restored tokens: those in `known`, or all if that is None.

    With `known`, a token is only decoded if a path of its lattice may have a known feature (by `outline`). `found` reads
    many texts at once and gives places in `names`, which are `known` in their order if they have one.
    """

    def __init__(self, restorer: Restorer, known: Collection[str] | None = None, size: int = 150_000):
        self.restorer, self.size = restorer, size
        self.names = known if isinstance(known, list) else sorted(known or ())
        self.known = None if known is None else set(known)
        self._memo = self._places = None

    def __getstate__(self):
        return {"restorer": self.restorer, "known": self.known, "names": self.names, "size": self.size, "_memo": None, "_places": None}

    def _ready(self) -> None:
        self._memo, self._old, self._blank = {}, {}, set()  # tokens' features, of late and before, `size` each; up to 3 * `size` tokens without any
        known = self.known or set()
        self._same = {f: f for f in known}
        self._words = {outline(f[:-1]) for f in known if f.endswith("$")}
        self._begins = {outline(f) for f in known if not f.endswith("$")}
        self._fours = {f[:4] for f in known if not f.endswith("$")}
        self._sizes = sorted({len(f) for f in self._begins})
        self._thirds = {o[:3] for o in self._words | self._begins}
        self._heads = {o[:n] for o in self._words | self._begins for n in range(9)}
        self._short = any(len(o) < 3 for o in self._thirds)

    def _may(self, token: str) -> bool:
        if self.known is None:
            return True
        if m := _OPEN.search(token):  # all paths begin as the letters before it
            o = outline(token[: m.start()])
            return o[:8] in self._heads or any(o[:n] in self._begins for n in self._sizes)
        o = _MANY.sub(r"\1", token.replace("l", "i")) if token.isalpha() else outline(token)
        if not self._short and o[:3] not in self._thirds:
            return False
        return o in self._words or any(o[:n] in self._begins for n in self._sizes)

    def words(self, token: str) -> list[str]:
        """The words of a lower-case token, as they are and restored."""
        bare = _EDGE.sub("", token)
        if not bare:
            return []
        out = [bare] if bare.isalnum() else re.findall(r"[^\W_]+", bare)
        if disguised(bare) and self._may(bare):
            out.append(self.restorer.restore(bare))
        if (token[0] in LEET or token.rstrip(_STOPS)[-1:] in LEET) and bare != token and _LETTER.search(token):  # a sign at an edge may be a letter
            rest = token.rstrip(_STOPS)
            if self._may(rest):
                out.append(self.restorer.restore(rest))
        return out

    def _found(self, token: str) -> tuple[str, ...]:
        k = self._same if self.known is not None else None
        if token.isalpha():  # what `words` gives for letters only
            words = [token, self.restorer.restore(token)] if any(map(eq, token, token[1:])) and self._may(token) else [token]
            if k is not None and len(words) == 1 and token[:4] not in self._fours and f"{token}$" not in k:
                return ()
        else:
            words = self.words(token)
        if k is None:
            return tuple({f for word in words for f in features(word)})
        return tuple({k[f] for word in words for f in (features(word) if word[:4] in self._fours else (f"{word}$",)) if f in k})

    def _hits(self, tokens: Iterable[str]) -> dict[str, tuple[str, ...]]:
        """The features of those tokens that have any; stops at a token's end never change them."""
        if self._memo is None:
            self._ready()
        out, blank = {}, self._blank
        for token in set(tokens) - blank:
            core = token.rstrip(_STOPS)
            found = self._memo.get(core)
            if found is None:
                found = self._old.get(core) or (self._found(core) if core and core not in blank else ())
                if found and len(core) <= 64:
                    if len(self._memo) >= self.size:
                        self._memo, self._old = {}, self._memo
                    self._memo[core] = found
            if found:
                out[token] = found
            elif len(token) <= 64:
                if len(blank) >= 3 * self.size:
                    blank.clear()
                blank.add(token)
                blank.add(core)
        return out

    def _apart(self, low: str) -> Iterator[set[str]]:
        """The features of each row of letters that stand apart ("i d i-o-t"): they may be words in any way, each may begin one."""
        for m in _SPACED.finditer(low):
            run = "".join(c for c in m.group() if c not in SEPARATORS and not c.isspace())
            if sum(c.isalpha() for c in run) < 2:
                continue
            word = self.restorer.restore(run)
            if self.known is None:
                yield set(features(word))
            else:
                ends = [f"{word[a:b]}$" for a in range(len(word)) for b in range(a + 3, min(len(word), a + 24) + 1)]
                yield self.known.intersection(ends) | self.known.intersection(word[a : a + n] for a in range(len(word)) for n in range(4, 9))

    def present(self, text: str) -> set[str]:
        """The features that occur in a text."""
        low = text.lower()
        return set().union(*self._hits(low.split()).values(), *self._apart(low))

    def count(self, text: str) -> tuple[dict[str, int], int]:
        """How often each feature occurs in a text, and the number of its tokens."""
        low = text.lower()
        tokens = low.split()
        hits = self._hits(tokens)
        out: dict[str, int] = {}
        for token, n in Counter(filter(hits.__contains__, tokens)).items():
            for f in hits[token]:
                out[f] = out.get(f, 0) + n
        for some in self._apart(low):
            for f in some:
                out[f] = out.get(f, 0) + 1
        return out, len(tokens)


    def _placed(self) -> None:
        """Tables of the known features that a token of letters only may have, by keys of their units."""
        self._kinds, self._loses = kinds(_STOPS, _ONES, SEPARATORS), {}
        self._place = {f: k for k, f in enumerate(self.names)}
        keys, at = [], []
        for word in (True, False):
            some = [(f[:-1] if word else f, k) for k, f in enumerate(self.names) if f.endswith("$") == word]
            some = [(f, k) for f, k in some if f.isalpha() and max(f) < "\uffff" and len(f) <= (LONGEST if word else 8) and (word or len(f) >= 4)]
            sizes, where = np.array([len(f) for f, _ in some], np.int64), np.array([k for _, k in some], np.int32)
            units = Units([f for f, _ in some], self._kinds)
            if not some:
                continue
            *begins, words = word_keys(units.u, units.bounds[:-1], sizes)
            for n, (which, got) in zip((LONGEST,) if word else range(4, 9), [words] if word else begins, strict=False):
                whole = np.ones(len(which), bool) if word else sizes[which] == n
                keys.append(got[whole])
                at.append(where[which[whole]])
        self._at = np.concatenate([np.zeros(0, np.int32), *at])
        self._places = Places(np.concatenate([np.zeros(0, np.uint64), *keys]))

    def _single(self, units: Units, token: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """The restored words of those tokens of letters that lose any: units, starts, sizes, tokens, and for each how many letters come before the first loss."""
        at, which, around = units.doubles(starts, ends)
        codes, back = np.unique(around, return_inverse=True)
        if len(self._loses) > self.size:
            self._loses.clear()
        loses = np.zeros(len(codes), bool)
        for k, code in enumerate(codes.tolist()):
            if code not in self._loses:
                self._loses[code] = self.restorer.single(*(chr(code >> by & 0xFFFF) for by in (16, 32, 0)))
            loses[k] = self._loses[code]
        lost = loses[back]
        at, which = at[lost], which[lost]
        kept = np.ones(len(units.u), bool)
        kept[at] = False
        which, first, n = np.unique(which, return_index=True, return_counts=True)
        return units.u[kept], starts[which] - first, ends[which] - starts[which] - n, token[which], at[first] - starts[which]

    def found(self, texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """What `count` gives for each text, for some texts at a time: (first text, each one's tokens, then, sorted, texts and places of the features in them, and how often).

        Tokens of letters only, none three times running, are looked up all at once, as they are and without the doubled letters
        that cost more; the others are read one by one.
        """
        if self._places is None:
            self._placed()
        for lo, hi in pieces(texts):
            low = [t.lower() for t in texts[lo:hi]]
            units = Units(low, self._kinds)
            starts, ends, plain, row = units.tokens()
            sizes = ends - starts
            plain &= sizes <= LONGEST
            rows, places = [], []
            at = np.flatnonzero(plain)
            for u, begins, lengths, token, over in ((units.u, starts[at], sizes[at], at, 0), self._single(units, at, starts[at], ends[at])):
                for which, keys in word_keys(u, begins, lengths, over):
                    there, place = self._places.find(keys)
                    rows.append(row[token[which[there]]])
                    places.append(self._at[place])
            other = np.flatnonzero(~plain & (sizes > 0))
            tokens = [units.text(a, b) for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)]
            hits = {t: [self._place[f] for f in some] for t, some in self._hits(tokens).items()}
            in_rows, found = [], []
            for t, r in zip(tokens, row[other].tolist(), strict=True):
                if t in hits:
                    in_rows += [r] * len(hits[t])
                    found += hits[t]
            for r in units.apart():
                for some in self._apart(low[r]):
                    in_rows += [r] * len(some)
                    found += [self._place[f] for f in some]
            k = max(1, len(self.names))
            kind = np.int32 if k * len(low) < 1 << 31 else np.int64
            pairs = np.concatenate([*rows, np.array(in_rows, np.int64)]).astype(kind) * kind(k) + np.concatenate([*places, np.array(found, np.int32)]).astype(kind)
            pairs.sort()
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            times, pairs = np.diff(np.append(first, len(pairs))), pairs[first]
            in_row = pairs // kind(k)
            yield lo, np.bincount(row, minlength=len(low)), in_row, pairs - in_row * kind(k), times


class Scorer:
    """`weights` of a feature's presence, `shares` of its rate, and a bias; `score` is the logistic function of the sum."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], bias: float, shares: dict[str, float] | None = None):
        self.weights, self.shares, self.bias = weights, shares or {}, bias
        self.reader = Reader(restorer, set(weights))
        self._weight, self._share = (np.array([of.get(f, 0.0) for f in self.reader.names]) for of in (self.weights, self.shares))

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, n, row, place, times in self.reader.found(texts):
            z = self.bias + np.bincount(row, self._weight[place] + self._share[place] * rate(times, n[row]), minlength=len(n))
            out[lo : lo + len(n)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def rate(count, tokens):
    """How much of a text a feature is, 0 to about 6.7: log2 of 1 + occurrences in a hundred tokens."""
    return np.log2(1 + 100 * count / np.maximum(np.maximum(tokens, count), 1))


#: Parts of the rows' features, each summed in a fixed order, so that reruns agree; and entries of a task's counts.
PARTS, HELD = 12, 300_000


def descend(slope, w: np.ndarray, rounds: int = 200, close: float = 1e-6, memory: int = 10) -> np.ndarray:
    """The minimum of a smooth convex function by L-BFGS; `slope(w)` gives value and gradient. Ends when a step gains under `close` of the value."""
    value, g = slope(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(steps):
            kept.append(float(s @ d) / float(s @ y))
            d = d - kept[-1] * y
        d = d * (float(steps[-1][0] @ steps[-1][1]) / float(steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1e-12, float(np.abs(g).max())))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d = d + (a - float(y @ d) / float(s @ y)) * s
        down, size = float(g @ d), 1.0
        while size > 1e-6:
            new, new_g = slope(w + size * d)
            if new <= value + 1e-4 * size * down:
                break
            size /= 2
        else:
            return w
        s, y = size * d, new_g - g
        steps = [*steps, (s, y)][-memory:] if float(s @ y) > 1e-14 else steps
        gain, w, value, g = value - new, w + s, new, new_g
        if gain <= close * value:
            break
    return w


def weigh(restorer: Restorer, able: list[str], rows: DataFrame, n1: int, n0: int, ridge: float = 1e-5) -> Scorer:
    """Logistic weights of the features `able`, from all `rows`: (y, at, rate, n), each n texts with the features at places `at` and their rates.

    The rows stay in the executors; the driver gets each part's gradient.
    """
    k, total, sc = len(able), n1 + n0, rows.sparkSession.sparkContext

    def packed(i: int, part: Iterator) -> Iterator[tuple]:
        some = list(part)
        at = np.array([p for r in some for p in r["at"]], np.int64)
        yield i, np.array([r["y"] for r in some], float), np.array([r["n"] for r in some], float), np.repeat(np.arange(len(some)), [len(r["at"]) for r in some]), at, np.array([v for r in some for v in r["rate"]], float)

    parts = rows.repartition(PARTS, "at", "rate", "y").sortWithinPartitions("at", "rate", "y").rdd.mapPartitionsWithIndex(packed).coalesce(PARTS).persist()

    def slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast(w)

        def one(part: tuple) -> tuple[int, float, np.ndarray, np.ndarray]:
            i, y, n, row, at, rates = part
            v = sent.value
            z = v[-1] + np.bincount(row, v[at] + v[k + at] * rates, minlength=len(y))
            r = n * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
            g = np.concatenate([np.bincount(at, r[row], minlength=k), np.bincount(at, r[row] * rates, minlength=k), [r.sum()]])
            there = np.flatnonzero(g)
            return i, float((n * (np.logaddexp(0, z) - y * z)).sum()), there, g[there]

        value, g = 0.0, np.zeros(2 * k + 1)
        for _, loss, there, some in sorted(parts.map(one).collect(), key=lambda x: x[0]):
            value += loss
            g[there] += some
        sent.unpersist()
        held = np.append(w[:-1], 0.0)
        return value / total + ridge / 2 * float(held @ held), g / total + ridge * held

    w = descend(slope, np.append(np.zeros(2 * k), np.log(n1 / n0)))
    parts.unpersist()
    there, share = ({f: float(x) for f, x in zip(able, part, strict=True)} for part in (w[:k], w[k : 2 * k]))
    return Scorer(restorer, there, float(w[-1]), share)


def some_rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `size`.

    Python's search for cycles waits until a batch of `batches` is read: texts and tokens make none, and it would go through
    the large tables of readers again and again.
    """
    collects = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            for lo in range(0, len(batch), size):
                yield batch.slice(lo, size)
            gc.collect()
    finally:
        if collects:
            gc.enable()


def model(rows: DataFrame) -> Restorer:
    """A language model of the plain words of all `rows` (y, text)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes, n = [], []

        def done() -> pa.RecordBatch:
            out = threes(words)
            words.clear()
            if codes:
                each, times = summed(codes, n)
                codes.clear(), n.clear()
                out.update({"".join(map(chr, k)): x for k, x in zip(np.stack([each >> np.uint64(32), each >> np.uint64(16) & np.uint64(0xFFFF), each & np.uint64(0xFFFF)], 1).tolist(), times.tolist(), strict=True)})
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["k", "n"])

        for batch in some_rows(batches):
            texts = [t.lower() for t in batch.column(1).to_pylist()]
            for lo, hi in pieces(texts):
                some = Units(texts[lo:hi], kinds(_STOPS, _ONES, SEPARATORS))
                wide = {i for i in some.wide if any(c > "\uffff" and c.isalnum() for c in texts[lo + i])}
                for i in wide:
                    words.update(plain_words(texts[lo + i]))
                if wide:
                    some = Units([t for i, t in enumerate(texts[lo:hi]) if i not in wide], kinds(_STOPS, _ONES, SEPARATORS))
                each, times = some.threes()
                codes.append(each)
                n.append(times)
                if sum(map(len, codes)) > HELD:
                    codes[:], n[:] = ([x] for x in summed(codes, n))
            if len(words) > HELD or codes and len(codes[0]) > HELD:
                yield done()
        yield done()

    return Restorer.of_threes({r["k"]: r["n"] for r in rows.mapInArrow(learn, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()})


def told(rows: DataFrame, reader: Reader) -> DataFrame:
    """f, pos, neg: in how many of all `rows` (y, text) of either class a feature is present."""
    sent = rows.sparkSession.sparkContext.broadcast(reader)

    def tell_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.names
        n = np.zeros((2, len(names)), np.int64)
        for batch in some_rows(batches):
            y = batch.column(0).to_numpy()
            for lo, _, row, place, _ in sent.value.found(batch.column(1).to_pylist()):
                of = y[lo + row]
                for k in (0, 1):
                    n[k] += np.bincount(place[of == k], minlength=len(names))
        there = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in there.tolist()], pa.string()), pa.array(n[1][there]), pa.array(n[0][there])], names=["f", "pos", "neg"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def done() -> pa.RecordBatch:
            f = list(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array([n[1][x] for x in f], pa.int64()), pa.array([n[0][x] for x in f], pa.int64())], names=["f", "pos", "neg"])
            n[0].clear(), n[1].clear()
            return out

        for batch in some_rows(batches):
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y].update(sent.value.present(t))
            if len(n[0]) + len(n[1]) > HELD:
                yield done()
        yield done()

    return rows.mapInArrow(tell if reader.known is None else tell_known, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def best(rows: DataFrame, restorer: Restorer, n1: int, n0: int, most: int, at_once: int = 150_000) -> list[str]:
    """The `most` features that best tell y in all `rows` (y, text): with worth over 3, then by worth and name.

    Only what three toxic texts share can count, so those are read first. Then all rows are read for such features, about
    `at_once` of them in a pass, those in most toxic texts first. The passes end when no feature left could be among the
    best, even if no other text had it; so the result is that of all features, and what is broadcast has a bound.
    """
    from ..session import written

    def worth(pos, neg, root):
        m = (pos + neg) / (n1 + n0)
        return (pos / n1 - neg / n0) / root(m * (1 - m) * (1 / n1 + 1 / n0) + 1e-12)

    shared = written(told(rows.where("y = 1"), Reader(restorer)).where("pos >= 3").select("f", "pos"), "toxicity")
    sizes = sorted((r["pos"], r["count"]) for r in shared.groupBy("pos").count().collect())
    out: list = []
    while sizes and not (len(out) == most and worth(sizes[-1][0], 0, np.sqrt) < out[-1]["worth"] - 1e-9):
        hi, n = sizes[-1][0], 0
        while sizes and (not n or n + sizes[-1][1] <= at_once):
            lo, more = sizes.pop()
            n += more
        for k in range(parts := -(-n // at_once)):  # more than one if very many share one count
            some = shared.where(F.col("pos").between(lo, hi)).where(F.pmod(F.xxhash64("f"), F.lit(parts)) == k)
            got = told(rows, Reader(restorer, {r["f"] for r in some.collect()})).withColumn("worth", worth(F.col("pos"), F.col("neg"), F.sqrt))
            out += got.where("pos >= 3 and worth > 3").orderBy(F.desc("worth"), "f").limit(most).collect()
        out = sorted(out, key=lambda r: (-r["worth"], r["f"]))[:most]
    return [r["f"] for r in out]


def fit(rows: DataFrame, n1: int, n0: int, *, most: int = 4000) -> Scorer:
    """A language model of the plain words of `rows` (y, text), and logistic weights of the `most` features that best tell y.

    All rows are read whole in their tasks, in every step. The driver gets counts of three characters in a row, features, and
    gradients; rows with equal features count together. `n1` and `n0` are the rows of y 1 and 0.
    """
    from ..session import written

    restorer = model(rows)
    able = best(rows, restorer, n1, n0, most)
    some = rows.sparkSession.sparkContext.broadcast(Reader(restorer, able))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches):
            for lo, n, row, place, times in some.value.found(batch.column(1).to_pylist()):
                ends = pa.array(np.cumsum(np.append(0, np.bincount(row, minlength=len(n)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(place.astype(np.int32)), pa.array(rate(times, n[row])))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(n)), *lists], names=["y", "at", "rate"])

    got = rows.mapInArrow(place, "y int, at array<int>, rate array<double>").groupBy("y", "at", "rate").agg(F.count("*").alias("n"))
    return weigh(restorer, able, written(got, "toxicity"), n1, n0)


#: As many labelled ids at most are sent to the executors; beyond that the join is Spark's choice.
SENT = 2_000_000


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer from all labelled rows. Classes count as they occur, so scores are probabilities at the labels' rate.

    Texts are read whole and don't come to the driver. With one class or none there is nothing to learn: every
    score is that class's, or 0. An id with both labels counts as 1.
    """
    from ..session import written

    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = F.broadcast(labelled) if labelled.count() <= SENT else labelled
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(known, "id").select("y", "text"), "toxicity")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Scorer(Restorer(Counter()), {}, 30.0 if 1 in n else -30.0)
    return fit(rows, n[1], n[0])


def score(docs: DataFrame, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; other columns are not read.

    Null text counts as empty and gets the score of a text without evidence. Texts are read whole. A null id counts as
    empty text in held_out. Rows are scored one by one, so repeated rows get equal scores.
    """
    tool = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = tool.value
        for batch in some_rows(batches):
            found = s.scores([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, modulus) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels.where(remainder("doc_id", 5) != 0)))
