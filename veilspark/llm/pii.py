"""Personal data by patterns with checks, and by a character-level bidirectional LSTM with CRF transitions in numpy.

The patterns' spans always stay. The model learns from them, and from spellings that the patterns miss, made from the same
spans; it reads the surroundings of digits and @, up to the ends of words, in overlapping windows. Windows' emissions are
averaged where they overlap, and one Viterbi pass decodes each whole stretch; one whose spans reach its edge is widened
and decoded again. Stretches of more than PART characters are decoded in parts that overlap, a span by the part it begins
in, so that memory is bounded whatever the text; stretches of about a length are decoded side by side. The model's spans need a digit or @, so other text is all outside under that constraint and isn't
shown to it. A decoded span is added if the model is sure of it, it passes its kind's check and it overlaps no pattern's
span. Addresses spelt in words ("name at host dot org") have a rule of their own, and are added in the same way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_BLANK = re.compile(r"\s")
_LABEL, _DOTS = "[a-z0-9_-]++", ("dot", "point", "punto", "punkt")
_DOT = rf"(?:\.|\s++(?:{'|'.join(_DOTS)})\s++|\s*+[\[({{<]\s*+(?:{'|'.join(_DOTS)})\s*+[\])}}>]\s*+)"
#: The rest of an address spelt in words, from its at on. Between blanks, at is a word of English too.
_SPELT = "|".join(
    (
        rf"(?<=\s)at\s++(?!(?:the|an?|this|that|each|every|one|any)\s){_LABEL}(?:\s++(?:dot|punkt)\s++{_LABEL})++",
        rf"(?<=\s)(?:arobase|arroba|chiocciola)\s++{_LABEL}(?:{_DOT}{_LABEL})++",
        rf"[\[({{<]\s*+(?:at|arobase|arroba|chiocciola)\s*+[\])}}>]\s*+{_LABEL}(?:{_DOT}{_LABEL})++",
    )
)
_SPELT_TEXT, _SPELT_BYTES = re.compile(_SPELT, re.ASCII | re.IGNORECASE), re.compile(f"(?={_SPELT})".encode(), re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def checked(kind: str, text: str) -> bool:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in text.split("."))
    digits = "".join(_DIGIT.findall(text))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start; leftmost and non-overlapping in each kind, failing matches dropped.

    Linear in the text. An address's local part is the run of its characters before an @, from the last match's end on,
    and a match of four numbers begins where a run of digits does, so no start is tried twice.
    """
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and not _NOT_LOCAL.match(text, lo - 1):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            out.append(("email", lo, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if checked(kind, m.group())]
    return out


def spelt_spans(text: str) -> list[Span]:
    """Addresses whose at and dots are words or stand in brackets, with dots spelt in the local part too; linear in the text."""
    out: list[Span] = []
    end = 0

    def back(at: int, local: bool) -> int:
        while at > end and (not _NOT_LOCAL.match(text, at - 1) if local else text[at - 1].isspace()):
            at -= 1
        return at

    for m in _SPELT_TEXT.finditer(text):
        hi = back(m.start(), False)
        lo = back(hi, True)
        if lo == hi:
            continue
        while True:
            dot = back(lo, False)
            word = back(dot, True)
            more = back(word, False)
            before = back(more, True)
            if dot == lo or before == more or more == word or text[word:dot].lower() not in _DOTS:
                break
            lo = before
        out.append(("email", lo, m.end()))
        end = m.end()
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# == the model ==

SYMBOLS, TAGS = 130, 1 + 2 * len(KINDS)
_SYMBOL = np.full(0x110000, 129, np.uint8)
_SYMBOL[:128] = np.arange(128)
_SYMBOL[48:58] = 48  # digits are one symbol
_SYMBOL[0xC0:0x250] = 128  # other letters of Latin scripts
WINDOW, STRIDE, AROUND = 64, 32, 20
PART, HELD = 16_384, 1 << 18


def symbols(text: str) -> np.ndarray:
    return _SYMBOL[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _allowed() -> np.ndarray:
    """Which tag may follow which: inside only after begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_FORBID = np.where(_allowed(), 0.0, -1e4)
_START = np.array([0.0] + [0.0, -1e4] * len(KINDS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """A bidirectional LSTM over characters with a linear layer to tag scores and learned CRF transitions."""

    def __init__(self, embed: int = 12, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"E": rng.normal(0, 0.3, (SYMBOLS, embed)), "W": rng.normal(0, 0.2, (2 * hidden, TAGS)), "b": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        for d in "fb":
            self.p[f"{d}x"] = rng.normal(0, 0.25, (embed, 4 * hidden))
            self.p[f"{d}h"] = rng.normal(0, 0.25, (hidden, 4 * hidden))
            self.p[f"{d}c"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Outputs (time, batch, hidden), and what going back needs. Gates: in, forget, out, new."""
        steps, n, _ = x.shape
        k = self.hidden
        pre = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        h, c = np.zeros((n, k)), np.zeros((n, k))
        out, kept = np.zeros((steps, n, k)), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"{d}h"]
            g = _sigmoid(z[:, : 3 * k])
            i, f, o, new = g[:, :k], g[:, k : 2 * k], g[:, 2 * k :], np.tanh(z[:, 3 * k :])
            before, h0 = c, h
            c = f * c + i * new
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            kept[t] = (i, f, o, new, before, tc, h0)
        return out, kept

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        steps, n, _ = x.shape
        k = self.hidden
        dz = np.zeros((steps, n, 4 * k))
        dh, dc = np.zeros((n, k)), np.zeros((n, k))
        back = self.p[f"{d}h"].T
        gh = np.zeros_like(self.p[f"{d}h"])
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            i, f, o, new, before, tc, h0 = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
            gh += h0.T @ dz[t]
            dh, dc = dz[t] @ back, dc * f
        grad[f"{d}h"] = gh
        grad[f"{d}x"] = np.einsum("tne,tng->eg", x, dz)
        grad[f"{d}c"] = dz.sum((0, 1))
        return dz @ self.p[f"{d}x"].T

    def emissions(self, s: np.ndarray) -> np.ndarray:
        """(windows, time, tags) scores of symbols (windows, time)."""
        x = self.p["E"][s.T]
        both = np.concatenate([self._lstm(x, "f")[0], self._lstm(x, "b")[0]], axis=2)
        return (both @ self.p["W"] + self.p["b"]).transpose(1, 0, 2)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag marginals (time, batch, tags), summed pair marginals and log partition, by forward and backward sums."""
        steps, n, _ = e.shape
        trans, start = self.p["T"] + _FORBID, self.p["S"] + _START
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = start + e[0]
        for t in range(1, steps):
            a[t] = _lse(a[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = _lse(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = _lse(a[-1], 1)
        pairs = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            pairs += np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
        return np.exp(a + b - z[None, :, None]), pairs, z

    def fit(self, s: np.ndarray, y: np.ndarray, *, steps: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 4) -> float:
        """Adam on the CRF's negative log likelihood of tags `y` (windows, time); the last loss a character."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            at = rng.integers(0, len(s), batch)
            sb, yb = s[at].T, y[at].T
            x = self.p["E"][sb]
            f, kf = self._lstm(x, "f")
            b, kb = self._lstm(x, "b")
            both = np.concatenate([f, b], axis=2)
            e = both @ self.p["W"] + self.p["b"]
            tags, pairs, z = self.marginals(e)
            t, n = sb.shape
            hot = np.zeros_like(e)
            hot[np.arange(t)[:, None], np.arange(n)[None, :], yb] = 1
            seen = np.zeros((TAGS, TAGS))
            np.add.at(seen, (yb[:-1].ravel(), yb[1:].ravel()), 1)
            first = hot[0]
            gold = (e * hot).sum() + (self.p["T"] * seen).sum() + (first @ self.p["S"]).sum()
            loss = float((z.sum() - gold) / (t * n))
            de = (tags - hot) / n
            g = {"W": np.einsum("tnh,tnk->hk", both, de), "b": de.sum((0, 1)), "T": (pairs - seen) / n, "S": (tags[0] - first).sum(0) / n}
            dboth = de @ self.p["W"].T
            dx = self._lstm_back(x, "f", kf, dboth[:, :, : self.hidden], g) + self._lstm_back(x, "b", kb, dboth[:, :, self.hidden :], g)
            g["E"] = np.zeros_like(self.p["E"])
            np.add.at(g["E"], sb, dx)
            size = np.sqrt(sum((q * q).sum() for q in g.values()))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, q in g.items():
                q = q * min(1.0, 5 / max(size, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.99 * v[k] + 0.01 * q * q
                self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss

    def decode(self, e: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of stretches by Viterbi, and their marginal probabilities, both (time, stretches).

        `e` has scores (time, stretches, tags) of stretches in order of falling `length`; what is past a length isn't read.
        """
        steps, n, _ = e.shape
        length = np.full(n, steps) if length is None else length
        trans, columns = self.p["T"] + _FORBID, np.arange(n)
        active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
        best = self.p["S"] + _START + e[0]
        came = np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            k = active[t]
            options = best[:k, :, None] + trans
            came[t, :k] = options.argmax(1)
            best[:k] = options.max(1) + e[t, :k]
        path = np.zeros((steps, n), np.int64)
        path[length - 1, columns] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            k = active[t]
            path[t - 1, :k] = came[t, columns[:k], path[t, :k]]
        chance = np.ones((steps, n))
        some = np.flatnonzero(path.any(0))
        if len(some):
            chance[:, some] = np.take_along_axis(self.chances(e[:, some], length[some]), path[:, some, None], 2)[:, :, 0]
        return path, chance

    def chances(self, e: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tag marginals (time, stretches, tags), by forward and backward products, scaled at every step."""
        steps = len(e)
        trans = np.exp(self.p["T"] + _FORBID)
        active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
        seen = np.exp(e - e.max(2, keepdims=True))
        a, b = np.zeros_like(e), np.ones_like(e)
        a[0] = np.exp(self.p["S"] + _START) * seen[0]
        a[0] /= a[0].sum(1, keepdims=True)
        for t in range(1, steps):
            k = active[t]
            x = (a[t - 1, :k] @ trans) * seen[t, :k]
            a[t, :k] = x / np.maximum(x.sum(1, keepdims=True), 1e-300)
        for t in range(steps - 2, -1, -1):
            k = active[t + 1]
            x = (seen[t + 1, :k] * b[t + 1, :k]) @ trans.T
            b[t, :k] = x / np.maximum(x.sum(1, keepdims=True), 1e-300)
        both = a * b
        return both / np.maximum(both.sum(2, keepdims=True), 1e-300)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def stretches(text: str, around: int = AROUND) -> list[tuple[int, int]]:
    """The surroundings of digits and @ in a text to the ends of words, merged where they meet."""
    s = symbols(text)
    hits = np.flatnonzero((s == 48) | (s == 64))
    if not len(hits):
        return []
    gaps = np.flatnonzero(np.diff(hits) > 2 * around)
    first, last = hits[np.concatenate([[0], gaps + 1])], hits[np.concatenate([gaps, [len(hits) - 1]])]
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        stop = out[-1][1] if out else 0
        lo = max(stop, a - around)
        while lo > stop and not text[lo - 1].isspace():
            lo -= 1
        m = _BLANK.search(text, max(stop, b + around + 1))
        hi = m.start() if m else len(text)
        if out and lo <= stop:
            out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return out


def parts(lo: int, hi: int, around: int = AROUND) -> list[tuple[int, int, int, int]]:
    """A stretch as (first, end, core's first, core's end) of parts whose cores are all of it, with 100 * `around` more on either side."""
    if hi - lo <= PART:
        return [(lo, hi, lo, hi)]
    return [(max(lo, c - 100 * around), min(hi, c + PART + 100 * around), c, min(hi, c + PART)) for c in range(lo, hi, PART)]


def _decoded(tagger: Tagger, jobs: list[tuple[str, int, int]]) -> list[list[tuple[int, int, int, float]]]:
    """(first tag, start, end, least chance) of what is decoded in each part (text, lo, hi), about HELD characters at a time."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in jobs]
    order = sorted(range(len(jobs)), key=lambda k: jobs[k][1] - jobs[k][2])
    while order:
        longest = jobs[order[0]][2] - jobs[order[0]][1]
        now, order = order[: max(1, HELD // max(longest, WINDOW))], order[max(1, HELD // max(longest, WINDOW)) :]
        length = np.array([jobs[k][2] - jobs[k][1] for k in now])
        at = [np.arange(0, max(1, n - STRIDE), STRIDE) for n in length]
        grid = np.full((len(now), longest + WINDOW), 32, np.uint8)
        for i, k in enumerate(now):
            text, lo, hi = jobs[k]
            grid[i, : hi - lo] = symbols(text[lo:hi])
        row, first = np.repeat(np.arange(len(now)), [len(a) for a in at]), np.concatenate(at)
        ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
        total, weight = np.zeros((longest + WINDOW, len(now), TAGS)), np.zeros((longest + WINDOW, len(now), 1))
        for x in range(0, len(row), 512):
            i, a = row[x : x + 512], first[x : x + 512]
            places = a[:, None] + np.arange(WINDOW)
            scores = tagger.emissions(grid[i[:, None], places])
            np.add.at(total, (places, i[:, None]), scores * ramp)
            np.add.at(weight, (places, i[:, None]), np.broadcast_to(ramp, (len(i), WINDOW, 1)))
        path, chance = tagger.decode((total / np.maximum(weight, 1e-9))[:longest], length)
        path[np.arange(longest)[:, None] >= length] = 0
        for i in np.flatnonzero(path.any(0)):
            text, lo, hi = jobs[now[i]]
            tags = path[: hi - lo, i]
            for t in np.flatnonzero(tags % 2):
                end = int(t) + 1
                while end < len(tags) and tags[end] == tags[t] + 1:
                    end += 1
                out[now[i]].append((int(tags[t]), lo + int(t), lo + end, float(chance[t:end, i].min())))
    return out


def model_spans(tagger: Tagger, texts: list[str], sure: float = 0.9) -> list[list[Span]]:
    """Spans that the model is sure of in each text.

    A text with a span at an edge of what was read is decoded again with twice the surroundings, until no span ends where
    reading does.
    """
    out: list[list[Span]] = [[] for _ in texts]
    around, todo = AROUND, list(range(len(texts)))
    while todo:
        places = [(k, *p) for k in todo for lo, hi in stretches(texts[k], around) for p in parts(lo, hi, around)]
        cut: set[int] = set()
        for k in todo:
            out[k] = []
        for x in range(0, len(places), 50_000):
            some = places[x : x + 50_000]
            for (k, lo, hi, core, stop), found in zip(some, _decoded(tagger, [(texts[k], lo, hi) for k, lo, hi, _, _ in some]), strict=True):
                for tag, a, b, chance in found:
                    if not core <= a < stop:
                        continue
                    if (a == lo and lo > 0) or (b == hi and hi < len(texts[k])):
                        cut.add(k)
                    if chance >= sure:
                        out[k].append((KINDS[tag // 2], a, b))
        around, todo = 2 * around, sorted(cut)
    return out


def plausible(kind: str, text: str) -> bool:
    """A decoded span's check: a kind's own, with other separators allowed."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        return "@" in text.strip("@") and bool(re.search(r"[A-Za-z0-9]\s?\.\s?[A-Za-z]", text))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not text.isdigit()


def all_spans(tagger: Tagger | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """The patterns' spans, and those spelt in words and the model's that overlap none of them."""
    found = model_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, old, new in zip(texts, base, found, strict=True):
        words = [s for s in spelt_spans(text) if not any(s[1] < b and a < s[2] for _, a, b in old)]
        more = [s for s in new if plausible(s[0], text[s[1] : s[2]]) and not any(s[1] < b and a < s[2] for _, a, b in old + words)]
        out.append(old + words + more)
    return out


# == training data ==


def respelt(kind: str, text: str, rng: np.random.Generator, signs: str = "./_-") -> str:
    """A spelling of a span that its pattern misses: other separators, of `signs`, or blanks where there were none."""
    sign, blank = signs[int(rng.integers(len(signs)))], " " * int(rng.integers(0, 2))
    pick = int(rng.integers(0, 3))
    if kind == "email":
        name, _, host = text.rpartition("@")
        return (f"{name} @ {host}", f"{name}@ {host}", f"{name} @{host}")[pick]
    if kind == "ip":
        return (" . " if sign == "." else f"{blank}{sign}{blank}").join(text.split("."))
    digits = "".join(_DIGIT.findall(text))
    if kind == "card":
        join = f"{blank}{'.' if sign == '-' and not blank else sign}{blank}"
        return join.join(re.findall(".{1,4}", digits) if pick else [digits[:4], digits[4:10], digits[10:]])
    local, land = digits[-10:], digits[:-10] or "1"
    a, b, c = local[:3], local[3:6], local[6:]
    return (f"({a}){blank}{b}{sign}{c}", f"00{land}{sign}{a}{sign}{b}{sign}{c}", f"{a}{sign}{b}{sign}{c}")[pick]


def windows_of(texts: list[str], seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and tags: surroundings of digits and @ as they are, and once more with spans respelt.

    Respelt, a span may have one of another kind right after it, which patterns that read on take for more of the first.
    """
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    seen: dict[str, str] = {}  # a span of each kind, the last read
    for text in texts:
        base = sorted(base_spans(text), key=lambda s: (s[1], -s[2]))
        flat, end = [], 0
        for k, a, b in base:
            if a >= end:
                flat.append((k, a, b))
                end = b
        for again in (False, True) if flat else (False,):
            parts, marks, at, n = [], [], 0, 0
            for k, a, b in flat:
                next_to = again and rng.random() < 0.4
                new = respelt(k, text[a:b], rng) if again and not next_to else text[a:b]
                parts += [text[at:a], new]
                n += a - at
                marks.append((k, n, n + len(new)))
                n += len(new)
                at = b
                others = [x for x in seen if x != k] if next_to else []
                if others:
                    other = others[int(rng.integers(len(others)))]
                    parts.append(f" {seen[other]}")
                    marks.append((other, n + 1, n + 1 + len(seen[other])))
                    n += 1 + len(seen[other])
                seen[k] = text[a:b]
            full = "".join([*parts, text[at:]])
            tags = np.zeros(len(full), np.int64)
            for k, a, b in marks:
                tags[a:b] = 2 + 2 * KINDS.index(k)
                tags[a] -= 1
            s = symbols(full)
            for lo, hi in stretches(full):
                for a in range(lo, max(lo + 1, hi - STRIDE), STRIDE):
                    a -= int(rng.integers(0, 8)) if a > lo + 8 else 0
                    piece, y = s[a : min(hi, a + WINDOW)], tags[a : min(hi, a + WINDOW)]
                    if len(y) and y[0] and y[0] % 2 == 0:
                        y = y.copy()
                        y[0] -= 1  # a window may begin inside a span
                    xs.append(np.concatenate([piece, np.full(WINDOW - len(piece), 32, np.uint8)]))
                    ys.append(np.concatenate([y, np.zeros(WINDOW - len(y), np.int64)]))
    return (np.stack(xs), np.stack(ys)) if xs else (np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int64))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 6000, windows: int = 6000) -> Tagger | None:
    """A tagger from about `sample_rows` rows by a hash of the id and `windows` windows of them at most, or None without spans.

    Sampled texts are cut to windows whole, in their tasks; windows are drawn from all of theirs by a hash.
    """
    n = docs.count()
    if not n:
        return None
    rate = min(1.0, sample_rows / n)
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(5))
    part = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    rows = docs.where((part < rate) & F.col(text_col).rlike("[0-9@]")).select(h.alias("h"), F.col(text_col).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                key = batch.column(0)[i].as_py()
                x, y = windows_of([batch.column(1)[i].as_py()], key % (1 << 32))
                for lo in range(0, len(x), 4096):
                    xs, ys = x[lo : lo + 4096], y[lo : lo + 4096].astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(xs), pa.int64()), pa.array(range(lo, lo + len(xs)), pa.int64()), pa.array([w.tobytes() for w in xs], pa.binary()), pa.array([w.tobytes() for w in ys], pa.binary())], names=["h", "k", "x", "y"])

    every = rows.mapInArrow(cut, "h long, k long, x binary, y binary")
    got = every.orderBy(F.xxhash64("h", "k"), "h", "k", "x", "y").limit(windows).collect()
    if not got:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in got), np.uint8).reshape(-1, WINDOW)
    y = np.frombuffer(b"".join(r["y"] for r in got), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    if not y.any():
        return None
    out = Tagger()
    out.fit(x, y)
    return out


# == on documents ==

_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True


def _scan(batch: pa.RecordBatch, column: str, tagger: Tagger | None) -> Iterator[tuple[int, int, dict[int, tuple[str, list[Span], list[Span]]]]]:
    """(first row, end row, {row: (text, base spans, all spans)} of rows with digits, @ or spelt addresses); others have no spans."""
    for lo, hi, data, off in tb.chunks(batch, column):
        marks = _TRIGGER[data]
        marks[[m.start() for m in _SPELT_BYTES.finditer(data)]] = True
        hit = np.flatnonzero(tb.per_row(marks, off))
        texts = [data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in hit]
        base = [base_spans(t) for t in texts]
        yield lo, hi, dict(zip(hit.tolist(), zip(texts, base, all_spans(tagger, texts, base), strict=True), strict=True))


def digests(docs: DataFrame, tagger: Tagger | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, their digest, and all spans of every row; other columns are not read.

    n_email, n_ip, n_card and n_phone count base spans, as base_sha256 does; `spans` also has the model's. Null text is
    empty: no spans, the digest of the empty string. Texts of any length are read whole. Ids may be null or repeat.
    """
    tool = docs.sparkSession.sparkContext.broadcast(tagger)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in _scan(batch, "text", tool.value):
                rows = [found.get(i, ("", [], [])) for i in range(hi - lo)]
                counts = [pa.array([sum(s[0] == k for s in b) for _, b, _ in rows], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for _, b, _ in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *counts, sha, pa.array([joined(a) for _, _, a in rows], pa.string())], names=names)

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """`text` with each stretch of overlapping spans as its first, longest span's [KIND]."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None, *, text_col: str = "text") -> DataFrame:
    """`docs`, all rows and columns, with personal data in `text_col` as [EMAIL], [IP], [CARD] or [PHONE]; nulls stay null."""
    tool = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for lo, hi, found in _scan(batch, text_col, tool.value):
                part = batch.slice(lo, hi - lo)
                if any(f[2] for f in found.values()):
                    texts = part.column(place).to_pylist()
                    for i, (text, _, spans) in found.items():
                        if spans:
                            texts[i] = masked(text, spans)
                    part = part.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    docs = table(spark, sf_dir, "documents")
    return digests(docs, train(docs))
