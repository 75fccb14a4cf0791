"""Text helpers: matches with positions, spaces inside numbers, and name normalisation. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in ECMAScript; Java's class lacks the no-break ones.
WS = r"[\s   -     　﻿]"

SPAN = "array<struct<start:int,`end`:int,value:string>>"


_BLOCK = 256
_MARK = "'\\u001f'"


def _of(value: Column, sql: str) -> Column:
    """An SQL expression of `t`, with `value` as `t`: one call however long the expression is."""
    return F.call_function("transform", F.array(value), F.expr(f"t -> {sql}"))[0]


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold(part: str) -> str:
    return f"aggregate({part}, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, n) -> named_struct('at', acc.at + n, 'out', concat(acc.out, array(acc.at))))"


def _sums_before(sizes: str) -> str:
    """SQL: for each of an array of whole numbers, the sum of those before it.

    A fold that appends copies what it has at every step, so only blocks of fixed size are folded, and then the blocks' totals.
    """
    blocks = f"transform(sequence(1, size(s), {_BLOCK}), k -> {_fold(f'slice(s, k, {_BLOCK})')})"
    joined = f"flatten(zip_with(b, {_fold('transform(b, x -> x.at)')}.out, (x, o) -> transform(x.out, v -> v + o)))"
    return f"transform(array({sizes}), s -> CASE WHEN size(s) <= {_BLOCK} THEN {_fold('s')}.out ELSE transform(array({blocks}), b -> {joined})[0] END)[0]"


def _find(t: str, pattern: str, gate: str) -> str:
    p = _quoted(pattern)
    # `split` compiles its pattern for every text, the others once; by one character it needs none
    gaps = f"CASE WHEN contains({t}, {_MARK}) THEN split({t}, {p}, -1) ELSE split(regexp_replace({t}, {p}, {_MARK}), {_MARK}, -1) END"
    steps = f"transform(array(regexp_extract_all({t}, {p}, 0)), m -> zip_with(slice(transform({gaps}, g -> length(g)), 1, size(m)), m, (g, w) -> named_struct('gap', g, 'value', w)))[0]"
    sums = _sums_before("transform(st, q -> q.gap + length(q.value))")
    found = f"transform(array({steps}), st -> zip_with(st, {sums}, (q, z) -> named_struct('start', z + q.gap, 'end', z + q.gap + length(q.value), 'value', q.value)))[0]"
    return f"CASE WHEN {t} RLIKE {_quoted(gate)} THEN {found} ELSE cast(array() as {SPAN}) END"


def find_spans(text: Column, pattern: str, gate: str | None = None) -> Column:
    """All matches of a pattern as array<struct<start, end, value>>; positions count code points from 0, end exclusive.

    A text without a match is only searched. Otherwise the pieces between matches and the matches give the positions; time
    grows in proportion to the text. Matches must not be empty. Null text gives an empty array.
    """
    return _of(text, _find("t", pattern, gate or pattern))


_GAP = r"[ \t  ](?:(?<=[0-9][ \t  ])|(?<=[0-9][A-Z][ \t  ]))[ \t  ]*(?=[0-9]|[A-Z][0-9])"


def compact_digits(text: Column) -> Column:
    """Text without the blanks inside numbers: runs of blanks after a digit (or digit and capital) and before one."""
    return F.regexp_replace(text, _GAP, "")


BLANKS = "array<array<struct<at:int,gone:int>>>"


def removed_blanks(text: Column) -> Column:
    """What `compact_digits` takes out, in blocks: where in the compact text, and how much up to there."""
    sums = _sums_before("transform(rs, r -> r.end - r.start)")
    runs = f"transform(array({_find('t', _GAP, _GAP)}), rs -> zip_with(rs, {sums}, (r, z) -> named_struct('at', r.start - z, 'gone', z + r.end - r.start)))[0]"
    blocks = f"transform(array({runs}), rs -> transform(sequence(1, size(rs), {_BLOCK}), k -> slice(rs, k, {_BLOCK})))[0]"
    return _of(text, f"CASE WHEN t RLIKE {_quoted(_GAP)} THEN {blocks} ELSE cast(array() as {BLANKS}) END")


def original_position(at: Column, blanks: Column) -> Column:
    """Where in the text the character at `at` of the compact text stands; looks at blocks, then into one."""
    block = "try_element_at(filter(t.blanks, b -> b[0].at <= t.at), -1)"
    return _of(F.struct(at.alias("at"), blanks.alias("blanks")), f"t.at + coalesce(try_element_at(filter({block}, c -> c.at <= t.at), -1).gone, 0)")


_ACCENTS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ", "AAAAAACEEEEIIIINOOOOOUUUUYY")


def normal_name(name: Column) -> Column:
    """A place or person's name without diacritics, in capitals, with single spaces for punctuation."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.upper(name), *_ACCENTS), "Œ", "OE"), "Æ", "AE")
    return F.trim(F.regexp_replace(F.translate(plain, "'’-./", "     "), f"{WS}+", " "))


def file_extension(name: Column) -> Column:
    """What follows the last dot, in lower case; null if there is no dot or nothing after it."""
    return F.nullif(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lit(""))
