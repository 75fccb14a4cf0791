"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text parses a text into the longest phrases that occur in that text. With c
phrases in n letters the cross entropy is about c * log2(size of the labelled text) / n; the language with the smallest
wins. Texts are lower-cased letters with one space for anything between. Every letter of the labelled texts is a symbol;
an automaton's edges lie in one array by displaced rows, so its size doesn't depend on how many letters there are. Many
texts are parsed at once, a letter of each in a step. Long texts are parsed in pieces of PIECE letters at once, as if a
phrase began with each; then a piece is parsed again from where the one before it ends, until both ways begin a phrase at the
same letter. So phrases are those of the whole text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import remainder, sample_by_class

PIECE = 1024


class SuffixAutomaton:
    """The minimal automaton of a text's substrings: `next[state]` maps a symbol to a state."""

    def __init__(self, text: np.ndarray):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text.tolist():
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def rows(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """(owner, next, starts): state `s` stands for its row's begin; its edge by `c` is at s + c if that place's owner is s.

        `next` holds rows' begins too. The start is 0 and has no places: any symbol there begins a phrase, at starts[c].
        """
        room = 4 * sum(map(len, self.next)) + 16
        owners = [-1] * (room + 1 + max([0, *(c for edges in self.next for c in edges)]))
        base, taken, rng = [0] * len(self.next), {0}, random.Random(1)
        for s in sorted(range(1, len(self.next)), key=lambda s: -len(self.next[s])):  # widest first, at random places that fit
            symbols = list(self.next[s])
            at = 0
            while at in taken or any(owners[at + c] >= 0 for c in symbols):
                at = rng.randrange(1, room)
            base[s] = at
            taken.add(at)
            for c in symbols:
                owners[at + c] = at
        nexts = np.zeros(len(owners), np.int32)
        for s in range(1, len(self.next)):
            for c, t in self.next[s].items():
                nexts[base[s] + c] = base[t]
        owners = np.array(owners, np.int32)
        return owners, nexts, {c: base[t] for c, t in self.next[0].items()}


class Model:
    """Languages and their automata; what is shipped is the labelled text, automata are built in each worker."""

    def __init__(self, samples: dict[str, list[str]], letters: int = 24_000):
        self.languages = sorted(samples)
        alphabet = sorted({_low(c) for texts in samples.values() for t in texts for c in t if c.isalpha()})
        self.symbol = {c: k + 1 for k, c in enumerate(alphabet)}
        self.other = len(alphabet) + 1
        self.texts = []
        self._tables = self._class = None
        for lang in self.languages:
            found = sorted((self.symbols(t) for t in samples[lang]), key=len)
            parts, left = [], letters
            for k, part in enumerate(found):  # what short texts leave of their share is the longer ones'
                part = part[: left // (len(found) - k)]
                left -= len(part)
                parts += [part, np.zeros(1, np.int32)]
            self.texts.append(np.concatenate(parts))

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_class": None}

    def _classes(self) -> np.ndarray:
        """The symbol of each code point: 0 for what is no letter."""
        if self._class is None:
            table = np.zeros(0x110000, np.int32)
            for cp in range(0x110000):
                c = chr(cp)
                if c.isalpha():
                    table[cp] = self.symbol.get(_low(c), self.other)
            self._class = table
        return self._class

    def symbols(self, text: str) -> np.ndarray:
        """A text's symbols, with runs of others than letters as one 0, none at the start."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        s = self._classes()[points]
        if not len(s):
            return s
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        keep[0] = s[0] != 0
        return s[keep]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, next, starts by language and symbol, each language's start state), all languages' rows in one array."""
        if self._tables is None:
            width, at = self.other + 1, 0
            owners, nexts, roots = [], [], []
            starts = np.zeros((len(self.texts), width), np.int32)
            for k, t in enumerate(self.texts):
                o, n, first = SuffixAutomaton(t).rows()
                roots.append(at)
                starts[k] = at
                for c, s in first.items():
                    starts[k, c] = at + s
                owners.append(np.where(o >= 0, o + at, -1))
                nexts.append(n + at)
                at += len(o)
            pad = np.full(width, -1)
            self._tables = np.concatenate([*owners, pad]).astype(np.int32), np.concatenate([*nexts, pad]).astype(np.int32), starts, np.array(roots, np.int32)
        return self._tables

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        owner, following, starts, roots = self.tables()
        flat, langs, width = starts.ravel(), len(roots), starts.shape[1]
        shift = (np.arange(langs) * width).astype(np.int32)
        out = np.zeros((len(texts), langs), np.int64)
        pieces = [(k, lo) for k, t in enumerate(texts) for lo in range(0, len(t), PIECE)]
        if not pieces:
            return out
        text, begin = (np.array(x) for x in zip(*pieces, strict=True))
        length = np.minimum(np.array([len(t) for t in texts])[text] - begin, PIECE)
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        before = np.full(len(order), -1)
        inner = np.flatnonzero(begin > 0)
        before[place[inner]] = place[inner - 1]
        text, length = text[order], length[order]
        grid = np.zeros((length[0], len(order)), np.int32)
        for k, p in enumerate(order.tolist()):
            t, lo = pieces[p]
            grid[: length[k], k] = texts[t][lo : lo + PIECE]
        fresh = np.zeros((length[0], langs, len(order)), bool)  # a phrase begins
        end = np.repeat(roots[:, None], len(order), 1)
        for step, n in enumerate(np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")):
            symbol, state = grid[step, :n], end[:, :n]
            at = state + symbol
            new = owner.take(at) != state
            fresh[step, :, :n] = new
            end[:, :n] = np.where(new, flat.take(shift[:, None] + symbol), following.take(at))
        after = np.full(len(order), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        lang, piece = np.nonzero((before >= 0)[None, :] & (end[:, before] != roots[:, None]))
        while len(piece):  # from where the piece before ends
            state = end[lang, before[piece]]
            cut_lang, cut_piece = [], []
            for step in range(length[0]):
                done = length[piece] <= step
                if done.any():  # the piece's end lies in another phrase than thought
                    moved = done & (end[lang, piece] != state)
                    end[lang[moved], piece[moved]] = state[moved]
                    cut_lang.append(lang[moved])
                    cut_piece.append(piece[moved])
                    lang, piece, state = lang[~done], piece[~done], state[~done]
                if not len(piece):
                    break
                symbol = grid[step, piece]
                at = state + symbol
                new = owner[at] != state
                old = fresh[step, lang, piece]
                fresh[step, lang, piece] = new
                state = np.where(new, flat[shift[lang] + symbol], following[at])
                on = ~(new & old)
                lang, piece, state = lang[on], piece[on], state[on]
            else:
                moved = end[lang, piece] != state
                end[lang[moved], piece[moved]] = state[moved]
                cut_lang.append(lang[moved])
                cut_piece.append(piece[moved])
            lang, piece = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (cut_lang, cut_piece))
            more = after[piece] >= 0
            lang, piece = lang[more], after[piece[more]]
        np.add.at(out, text, fresh.sum(0).T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [self.symbols(t or "") for t in texts]
        letters = np.array([np.count_nonzero(f) for f in found])
        bits = np.array([np.log2(max(2, len(t))) for t in self.texts])
        cost = self.phrases(found) * bits
        best = cost.argmin(1) if len(self.languages) else np.zeros(len(texts), int)
        ranked = np.sort(cost, 1)
        second = ranked[:, 1] if cost.shape[1] > 1 else 2 * ranked[:, 0]
        score = np.where(letters > 0, np.clip(1 - ranked[:, 0] / np.maximum(second, 1e-9) / 2, 0, 1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], score.tolist()


def _low(c: str) -> str:
    """A letter in lower case, as one letter."""
    return c.lower()[0]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = 60, letters: int = 24_000, stretch: int = 4_000) -> Model:
    """A model from at most `each` labelled rows and `letters` letters of every language: the bound of the sample.

    A row longer than `stretch` characters gives that many from a place drawn by a hash of its id.
    """
    text = F.col(text_col).cast("string")
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.greatest(F.length(text) - stretch + 1, F.lit(1)).cast("long")).cast("int")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.substring(text, place + 1, F.lit(stretch)).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sample_by_class(rows, "id", "lang", each):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model({k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)}, letters)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; other columns are not read.

    Null text and text without a letter are `und` with score 0. Texts are parsed whole. score is 1 - best / second / 2 of
    the cross entropies. Equal entropies go to the language first by code point. A null id counts as empty text. With
    no labelled rows everything is `und`.
    """
    tool = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = tool.value
        most = 8_000_000 // max(4, len(m.languages))
        for batch in batches:
            lo = 0
            sizes = np.cumsum([0, *(len(t or "") for t in batch.column(2).to_pylist())])
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                texts = part.column(2).to_pylist()
                lang, score = m.predict(texts) if m.languages else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
                lo = hi

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(remainder("doc_id", 4) != 2)))
