"""Quality rules as a short-circuit cascade.

Each rule rejects texts. On a bounded sample every rule's cost and rejection rate are measured, and the rules are then
applied in the order of rejections per cost: a text that one rule rejects is not shown to the rules after it. The order
changes only the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
WINDOW = 8


class Texts:
    """Whole texts and what rules ask about them; each figure is computed when first asked for."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self._known = data, off, {}

    def __len__(self) -> int:
        return len(self.off) - 1

    def of(self, rows: np.ndarray) -> Texts:
        """Only these rows."""
        if len(rows) == len(self):
            return self
        parts = [self.data[self.off[i] : self.off[i + 1]] for i in rows]
        out = Texts(np.concatenate(parts) if parts else self.data[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
        out._known = {k: v[rows] for k, v in self._known.items() if isinstance(v, np.ndarray)}
        return out

    def _get(self, name: str, make: Callable):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    def _words(self) -> tuple:
        return self._get("words", lambda: tb.words(self.data, self.off))

    def _hashes(self) -> np.ndarray:
        """A hash of each word; not an array with an entry for each row, so not kept by `of`."""
        if "hashes" not in self._known:
            self._known["hashes"] = (tb.hashes(self.data, *self._words()[:2]),)
        return self._known["hashes"][0]

    @property
    def n_stutter(self) -> np.ndarray:
        """Words equal to the word before."""
        row, h = self._words()[2], self._hashes()
        return np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(self))

    @property
    def n_words(self) -> np.ndarray:
        return self._get("n_words", lambda: self._words()[3].astype(np.int64))

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes that neither continue a character nor are space."""
        return self._get("word_chars", lambda: tb.per_row(((self.data & 0xC0) != 0x80) & ~tb.SPACE[self.data], self.off))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._get("n_symbols", lambda: tb.per_row(_SYMBOL[self.data], self.off))

    @property
    def n_upper(self) -> np.ndarray:
        return self._get("n_upper", lambda: tb.per_row(_UPPER[self.data], self.off))

    @property
    def n_alpha(self) -> np.ndarray:
        return self._get("n_alpha", lambda: tb.per_row(_ALPHA[self.data], self.off))

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that have a word, and those equal to an earlier one, by row."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.off[:-1], breaks + 1])
        stops = np.concatenate([self.off[1:], breaks])
        starts.sort()
        stops.sort()
        row = np.concatenate([np.arange(len(self)), np.searchsorted(self.off, breaks, "right") - 1])
        row.sort()
        solid = np.concatenate([[0], np.cumsum(~tb.SPACE[self.data])])
        has = solid[stops] > solid[starts]
        starts, stops, row = starts[has], stops[has], row[has]
        key = tb.mix(tb.hashes(self.data, starts, stops) + tb.mix(row.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[1:] = key[order][1:] == key[order][:-1]
        n = len(self)
        return np.bincount(row, minlength=n), np.bincount(row[order][again], minlength=n)

    @property
    def n_lines(self) -> np.ndarray:
        self.n_dup_lines  # noqa: B018
        return self._known["n_lines"]

    @property
    def n_dup_lines(self) -> np.ndarray:
        if "n_dup_lines" not in self._known:
            self._known["n_lines"], self._known["n_dup_lines"] = self._lines()
        return self._known["n_dup_lines"]

    def _repeats(self) -> np.ndarray:
        starts, stops, row, _ = self._words()
        shingle, at = tb.windows(self._hashes(), row, WINDOW)
        key = tb.mix(shingle + tb.mix(row[at].astype(np.uint64)))
        ranked = np.sort(key)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if not len(twice):
            return np.zeros(len(self), np.int64)
        twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
        place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        at = at[twice[place] == key]
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=len(self)).astype(np.int64)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words in WINDOW-word windows that the text has twice or more."""
        return self._get("n_repeat_words", self._repeats)


@dataclass(frozen=True)
class Rule:
    """`rejects` says for each of the texts whether it goes."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def few_words(t: Texts) -> np.ndarray:
    return t.n_words < 20


def repeated_windows(t: Texts) -> np.ndarray:
    return 100 * t.n_repeat_words > 30 * t.n_words


def symbols(t: Texts) -> np.ndarray:
    return 100 * t.n_symbols > 6 * t.word_chars


def shouting(t: Texts) -> np.ndarray:
    return (2 * t.n_upper > t.n_alpha) & (t.n_alpha > 0)


def repeated_lines(t: Texts) -> np.ndarray:
    return (100 * t.n_dup_lines > 30 * t.n_lines) & (t.n_dup_lines >= 3)


def stutter(t: Texts) -> np.ndarray:
    return 100 * t.n_stutter > 30 * t.n_words


def word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)


BASE = (Rule("few_words", few_words), Rule("repeated_windows", repeated_windows))
RULES = (*BASE, Rule("symbols", symbols), Rule("shouting", shouting), Rule("repeated_lines", repeated_lines), Rule("word_length", word_length), Rule("stutter", stutter))


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """For each text, the index in `rules` of the first that rejects it, or -1. Later rules don't see rejected texts."""
    verdict = np.full(len(texts), -1, np.int64)
    rows, left = np.arange(len(texts)), texts
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        bad = rule.rejects(left)
        verdict[rows[bad]] = k
        keep = np.flatnonzero(~bad)
        if len(keep) < len(rows):
            rows, left = rows[keep], left.of(keep)
    return verdict


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 256) -> tuple[Rule, ...]:
    """`rules` by rejections per second on the `sample_rows` rows whose ids have the smallest hashes; ties stay in order.

    Rules are tried on the sample where it is, each text whole; hits and processor time by rule are all that comes to the
    driver. First the ids' hashes are taken, so that texts are not sorted.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    edge = docs.select(h.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return tuple(rules)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, spent = np.zeros(len(rules), np.int64), np.zeros(len(rules), np.int64)
        for batch in batches:
            for _, _, data, off in tb.chunks(batch, "t"):
                for k, rule in enumerate(rules):
                    began = time.process_time_ns()
                    hits[k] += int(rule.rejects(Texts(data, off)).sum())
                    spent[k] += time.process_time_ns() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(hits), pa.array(spent)], names=["k", "hits", "spent"])

    sample = docs.where(h <= F.lit(edge)).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    got = sample.mapInArrow(tell, "k int, hits long, spent long").groupBy("k").agg(F.sum("hits").alias("hits"), F.sum("spent").alias("spent")).collect()
    figures = sorted((-(r["hits"] + 0.5) / max(r["spent"], 1000), r["k"]) for r in got)
    return tuple(rules[k] for _, k in figures) if figures else tuple(rules)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None, sample_rows: int = 256) -> DataFrame:
    """doc_id, the base figures, base_failed and kept of every row; other columns are not read.

    Null text counts as empty: no words, so base_failed. Ids may be null or repeat; each row gets its own verdict. An
    empty table gives an empty result. Figures and verdicts depend on a row's text alone.
    """
    ordered = rules or order_rules(docs, id_col=id_col, text_col=text_col, sample_rows=sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.chunks(batch, "text"):
                t = Texts(data, off)
                n, rep = t.n_words, t.n_repeat_words
                failed = few_words(t) | repeated_windows(t)
                kept = ~failed & (cascade(t, ordered) < 0)
                figures = (n, t.word_chars, t.n_symbols, t.n_dup_lines.astype(np.int64), rep)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, figures), pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None, sample_rows: int = 256) -> DataFrame:
    """The rows of `docs`, with all their columns, that no rule rejects. Null text is empty and goes."""
    ordered = rules or order_rules(docs, id_col=id_col, text_col=text_col, sample_rows=sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.chunks(batch, text_col):
                rows = np.flatnonzero(cascade(Texts(data, off), ordered) < 0)
                if len(rows):
                    yield batch.slice(lo, hi - lo).take(pa.array(rows))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return judge(table(spark, sf_dir, "documents"))


#: Words in repeated windows: a word counts if one of the up to eight windows that hold it is there twice or more.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, text, w, len(w)::BIGINT AS n_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_replace(text, '[^A-Z]', '', 'g') AS ups, regexp_replace(text, '[^A-Za-z]', '', 'g') AS alphas
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM f)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), reps AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), g AS (
  SELECT f.doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words, n_stutter, length(ups) AS n_up, length(alphas) AS n_al
  FROM f LEFT JOIN reps ON f.doc_id = reps.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 6 * word_chars OR (2 * n_up > n_al AND n_al > 0)
            OR (100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 3) OR 100 * n_stutter > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM g
"""
