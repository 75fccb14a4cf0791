"""Span detectors and overlap resolution.

A detector is a column expression from a text column to array<struct<type, start, end, value, confidence, tier>>, sorted and
without overlaps. Positions count code points. All are expressions of the JVM except names, which is Python. `detect` runs a
list of them in one stage, without a shuffle; Python detectors, the choice between overlapping entities and what a caller
does with them are one Arrow function over the text and the other detectors' entities.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import iban_fr_valid, luhn_valid, nir_valid
from ..functions.text import compact_digits, find_spans, original_position, removed_blanks
from .names import FIRST_NAMES, find_names

ENTITY = "array<struct<type:string,start:int,end:int,value:string,confidence:double,tier:string>>"
TYPES = ("nir", "rpps", "iban", "finess", "nom", "date_naissance", "adresse", "telephone", "email", "etablissement")
TIERS = {"structural": 3, "reference": 2, "pattern": 1, "statistical": 0}


@dataclass(frozen=True)
class Detector:
    """`find` maps a text column to entities; register your own by putting it in the list given to `detect`.

    One that is `compacting` is given a `Text`, with the text without blanks inside numbers. One in Python has a `scan` from
    a text to entities (type, start, end, confidence).
    """

    name: str
    tier: str
    find: Callable[[Column], Column]
    compacting: bool = False
    scan: Callable[[str], list[tuple[str, int, int, float]]] | None = None

    def of(self, text: Column, compact: Column, blanks: Column) -> Column:
        return self.find(Text(text, compact, blanks) if self.compacting else text)


def _entities(spans: Column, kind: str, confidence: Column | float, tier: str) -> Column:
    c = confidence if callable(confidence) else lambda s: F.lit(float(confidence))
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), c(s).alias("confidence"), F.lit(tier).alias("tier")))


class Text:
    """A text and what several detectors need of it; `detect` computes the parts once, as columns."""

    def __init__(self, raw: Column, compact: Column | None = None, blanks: Column | None = None):
        self.raw = raw
        self.compact = compact_digits(raw) if compact is None else compact
        self.blanks = removed_blanks(raw) if blanks is None else blanks


def _text(text: Column | Text) -> Text:
    return text if isinstance(text, Text) else Text(text)


def _in_compact(given: Column | Text, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Matches in the text without blanks inside numbers that are valid, at their places in the text."""
    t = _text(given)
    text, compact, blanks = t.raw, t.compact, t.blanks
    found = F.filter(find_spans(compact, pattern), lambda s: valid(s["value"]))

    def back(s: Column) -> Column:
        lo, hi = original_position(s["start"], blanks), original_position(s["end"] - 1, blanks) + 1
        return F.struct(lo.alias("start"), hi.alias("end"), F.substring(text, lo + 1, hi - lo).alias("value"))

    return F.transform(found, back)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once, however often `f` has it; in a lambda it would be once an element."""
    return F.transform(F.array(value), f)[0]


def _apart(spans: Column, others: Column) -> Column:
    """`spans` that overlap none of `others`, which must be a value at hand."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda r: (s["start"] < r["end"]) & (r["start"] < s["end"])))


def _bare(value: Column, separators: str) -> Column:
    return F.upper(F.regexp_replace(value, separators, ""))


# Patterns begin with a character that is rare, and look back from there: trying a place where none begins costs little.
_SEP = r"[ .\-]?"
_NIR = rf"[1-8](?<!\d\d)(?:{_SEP}\d\d){{2}}{_SEP}(?:2[ABab]|\d\d)(?:{_SEP}\d\d\d){{2}}{_SEP}\d\d(?!\d)"
_IBAN = r"[Ff](?<![\dA-Za-z][Ff])[Rr]\d\d(?:[- ]?[\dA-Za-z]){23}(?![\dA-Za-z])"
_RPPS = r"\d(?<!\d\d) ?(?:\d ?){9}\d(?!\d)"
_FINESS = r"\d(?<!\d\d)\d{8}(?!\d)"
_PHONE = rf"[+0](?<!\d[+0])(?:(?<=0)|(?<=\+)33{_SEP})[1-9](?:{_SEP}\d\d){{4}}(?!\d)"
_EMAIL = r"[\dA-Za-z][\dA-Za-z%+._-]*@[\dA-Za-z.-]+[.][A-Za-z]{2,}"
_DATE = r"(?:[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{4}|[0-9]{1,2}[ \t]+(?:janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[ûu]t|septembre|octobre|novembre|d[ée]cembre)[ \t]+[0-9]{4})"
_BORN = r"(?iu)(?=[dn])(?:(?:ddn|date[ \t]+de[ \t]+naissance)[ \t]*:?|née?(?:[(]e[)])?[ \t]+le)[ \t]+"
_LETTER = r"A-ZÀ-ÖØ-Þa-zà-öø-ÿ"
_TOWN_WORD = rf"[{_LETTER}][0-9_{_LETTER}'’-]*"
_TOWN = rf"\d(?<!\d\d)\d{{4}}[ \t]+({_TOWN_WORD})(?:[ -]{_TOWN_WORD}){{0,3}}"
_STREET = r"(?:all[ée]e|avenue|boulevard|chemin|cours|impasse|lotissement|passage|place|quai|route|rue|square)"
_ADDRESS = rf"(?iu)[0-9]{{1,4}}[ \t]*,?[ \t]*{_STREET}[ \t]+[0-9{_LETTER}'’\- ]+?(?:,?[ \t]*|[ \t]*\r?\n[ \t]*){_TOWN}"
_TOWN_ONLY = rf"(?iu){_TOWN}"
_UNITS = "cl cm dl iu kcal kg km mcg meq mg ml mm mmol mol ng pg ui".split()
_LINK = "(?:aux|au|des|de|du|d['’]|en|les|le|la|l['’]|sur)"
_PART = rf"(?:{_LINK}[ \t]+)?[A-ZÀ-Ÿ][0-9A-Za-z_À-ÿ'’\-]*"
_PLACE = rf"(?=[CEFHILMRS])(?<![0-9A-Za-z_])(?:CH|Centre|Clinique|EHPAD|ESAT|FAM|Foyer|H[ôo]pital|IME|ITEP|Lyc[ée]e|MAS|R[ée]sidence|SSIAD)[ \t]+{_PART}(?:[ \t]+{_PART})*"


def nir(text: Column | Text) -> Column:
    return _entities(_in_compact(text, _NIR, lambda v: nir_valid(_bare(v, r"[ .\-]"))), "nir", 1.0, "structural")


def iban(text: Column | Text) -> Column:
    return _entities(_in_compact(text, _IBAN, lambda v: iban_fr_valid(_bare(v, r"[ \-]"))), "iban", 1.0, "structural")


def rpps(text: Column) -> Column:
    """Eleven digits that pass the check and don't overlap what is shaped like an IBAN."""
    valid = F.filter(find_spans(text, _RPPS), lambda s: luhn_valid(F.replace(s["value"], F.lit(" "), F.lit(""))))
    return _entities(_with(valid, lambda v: _with(find_spans(F.when(F.size(v) > 0, text), _IBAN), lambda shaped: _apart(v, shaped))), "rpps", 0.9, "structural")


def finess(given: Column | Text) -> Column:
    """Nine digits that pass the check; surer with the word within 40 characters."""
    text = _text(given).raw

    def sure(s: Column) -> Column:
        lo = F.greatest(s["start"] - 40, F.lit(0))
        near = F.lower(F.substring(text, lo + 1, s["end"] + 40 - lo))
        return F.when(F.contains(near, F.lit("finess")), 0.9).otherwise(0.5)

    return _entities(_in_compact(given, _FINESS, luhn_valid), "finess", sure, "structural")


def phone(text: Column) -> Column:
    return _entities(find_spans(text, _PHONE), "telephone", 0.8, "pattern")


def email(text: Column) -> Column:
    return _entities(F.when(F.contains(text, F.lit("@")), find_spans(text, _EMAIL)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")), "email", 0.85, "pattern")


def birth_date(text: Column) -> Column:
    """The date after a word that announces a birth; only the date is the span."""

    def only(s: Column) -> Column:
        date = F.regexp_extract(s["value"], rf"(?iu)({_DATE})$", 1)
        return F.struct((s["end"] - F.length(date)).alias("start"), s["end"].alias("end"), date.alias("value"))

    return _entities(F.transform(find_spans(text, _BORN + _DATE), only), "date_naissance", 0.7, "pattern")


def address(text: Column) -> Column:
    """Number, street, postcode and town; and postcode and town alone where that isn't part of the first."""

    def town(s: Column, pattern: str) -> Column:
        name = F.regexp_extract(s["value"], pattern + "$", 1)
        return name.rlike("^[A-ZÀ-ÖØ-Þ]") & ~F.lower(name).isin(_UNITS)

    def both(full: Column) -> Column:
        alone = _apart(F.filter(find_spans(text, _TOWN_ONLY), lambda s: town(s, _TOWN_ONLY)), full)
        return F.array_sort(F.concat(_entities(full, "adresse", 0.7, "pattern"), _entities(alone, "adresse", 0.55, "pattern")), _by_start)

    full = F.filter(find_spans(text, _ADDRESS), lambda s: town(s, _ADDRESS))
    return F.when(text.rlike(_TOWN_ONLY), _with(full, both)).otherwise(F.array().cast(ENTITY))


def establishment(text: Column) -> Column:
    return _entities(find_spans(text, _PLACE), "etablissement", 0.7, "pattern")


def names(text: Column, first_names: frozenset[str] = FIRST_NAMES) -> Column:
    """Person names by `names.find_names`, in Arrow batches."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64())]))

    @F.arrow_udf("array<struct<start:int,end:int,value:string,confidence:double>>")
    def find(col: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "value": t[a:b], "confidence": c} for a, b, c in find_names(t, first_names)] if t else [] for t in col.to_pylist()], kind)

    return F.transform(find.asNondeterministic()(text), lambda s: F.struct(F.lit("nom").alias("type"), s["start"], s["end"], s["value"], s["confidence"], F.lit("reference").alias("tier")))


def python_detector(name: str, tier: str, find: Callable[[str], list[tuple[str, int, int, float]]]) -> Detector:
    """A detector from a Python function that gives (type, start, end, confidence) of a text; runs in Arrow batches."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64()), ("tier", pa.string())]))

    @F.arrow_udf(ENTITY)
    def run(col: pa.Array) -> pa.Array:
        return pa.array([[{"type": k, "start": a, "end": b, "value": t[a:b], "confidence": c, "tier": tier} for k, a, b, c in sorted(find(t), key=lambda e: e[1])] if t else [] for t in col.to_pylist()], kind)

    return Detector(name, tier, run.asNondeterministic(), scan=lambda t: sorted(find(t), key=lambda e: e[1]))


def no_entities(text: Column) -> Column:
    """The place of a statistical recogniser; finds nothing."""
    return F.array().cast(ENTITY)


STRUCTURAL = (Detector("nir", "structural", nir, True), Detector("rpps", "structural", rpps), Detector("iban", "structural", iban, True), Detector("finess", "structural", finess, True))
DEFAULT = (
    *STRUCTURAL,
    Detector("nom", "reference", names, scan=lambda t: [("nom", a, b, c) for a, b, c in find_names(t)]),
    Detector("date_naissance", "pattern", birth_date),
    Detector("adresse", "pattern", address),
    Detector("telephone", "pattern", phone),
    Detector("email", "pattern", email),
    Detector("etablissement", "pattern", establishment),
)


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(0)


_KIND = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64()), ("tier", pa.string())]))


def resolved(entities: list[dict]) -> list[dict]:
    """Greedy choice: longest, then surest, then highest tier, then first; kept if it overlaps none kept. By start.

    Kept entities don't overlap, so only the neighbour before an entity's end is looked at.
    """
    if len(entities) < 2:
        return entities
    starts: list[int] = []
    kept: list[dict] = []
    for e in sorted(entities, key=lambda e: (e["start"] - e["end"], -e["confidence"], -TIERS.get(e["tier"], -1), e["start"], e["type"])):
        k = bisect_left(starts, e["end"])
        if k == 0 or kept[k - 1]["end"] <= e["start"]:
            starts.insert(k, e["start"])
            kept.insert(k, e)
    return kept


#: Lists of at most so many entities are resolved side by side: the first of every list, then the second, and so on.
_FEW, _FAR = 16, 1 << 40


def _ranks(col: pa.Array, rank: Callable[[list], list[int]]) -> np.ndarray:
    """Whole numbers for the values of a column, as `rank` gives them for its distinct values; -1 for null."""
    coded = col.dictionary_encode()
    return np.array([*rank(coded.dictionary.to_pylist()), -1])[coded.indices.fill_null(-1).to_numpy()]


def resolved_lists(col: pa.Array) -> pa.Array:
    """`resolved` of each list. Long lists and those with odd values (empty spans, NaN) go one by one, others all at once."""
    flat, size = col.flatten(), pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    start, end, sure, tier, kind = (flat.field(k) for k in ("start", "end", "confidence", "tier", "type"))
    if flat.null_count or any(x.null_count for x in (start, end, sure, kind)):
        return pa.array([x and resolved(x) for x in col.to_pylist()], _KIND)
    start, end, sure = start.to_numpy().astype("int64"), end.to_numpy().astype("int64"), sure.to_numpy()
    row, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    odd = size > _FEW
    odd[row[(end <= start) | np.isnan(sure)]] = True
    at = np.flatnonzero(~odd[row])
    keys = (_ranks(kind, lambda v: np.argsort(np.argsort(np.array(v, object)))), start, -_ranks(tier, lambda v: [TIERS.get(t, -1) for t in v]), -sure, start - end, row)
    order = at[np.lexsort([k[at] for k in keys])]
    few = np.flatnonzero(~odd)
    few = few[np.argsort(-size[few], kind="stable")]  # lists with a k-th entity stand before those without
    begin = (np.cumsum(size * ~odd) - size)[few]
    lo, hi = np.zeros((2, len(few), _FEW), "int64")
    keep = np.zeros(len(row), bool)
    for k in range(int(size[few].max(initial=0))):
        n = int(np.searchsorted(-size[few], -k))
        e = order[begin[:n] + k]
        a, b = start[e], end[e]
        keep[e] = ok = ~((lo[:n, :k] < b[:, None]) & (a[:, None] < hi[:n, :k])).any(1)
        lo[:n, k], hi[:n, k] = np.where(ok, a, _FAR), np.where(ok, b, -_FAR)  # what isn't kept overlaps nothing
    taken = [np.flatnonzero(keep)]
    place = [start[taken[0]]]
    for i in map(int, np.flatnonzero(odd)):
        entities = col[i].as_py()
        index = {id(e): first[i] + j for j, e in enumerate(entities)}
        taken.append(np.array([index[id(e)] for e in resolved(entities)], "int64"))
        place.append(np.arange(len(taken[-1])))
    taken = np.concatenate(taken)
    taken = taken[np.lexsort((np.concatenate(place), row[taken]))]
    offsets = np.append(0, np.cumsum(np.bincount(row[taken], minlength=len(size)))).astype("int32")
    values = pa.StructArray.from_arrays([flat.field(f.name).take(pa.array(taken)) for f in _KIND.value_type], fields=list(_KIND.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(col.is_null().to_numpy(zero_copy_only=False), False)), values)


def resolve_overlaps(entities: Column) -> Column:
    """`resolved` as a column; only arrays of several entities leave the JVM."""

    @F.arrow_udf(ENTITY)
    def run(col: pa.Array) -> pa.Array:
        return resolved_lists(col)

    return F.when(F.size(entities) > 1, run.asNondeterministic()(F.when(F.size(entities) > 1, entities))).otherwise(entities)


def entities_of(text: Column, detectors: tuple[Detector, ...] = DEFAULT) -> Column:
    """All detectors' entities, overlaps resolved; null text has none."""
    return resolve_overlaps(F.concat(*(d.find(text) for d in detectors)))


def detect(docs: DataFrame, *, text_col: str = "text", out: str = "entities", detectors: tuple[Detector, ...] = DEFAULT) -> DataFrame:
    """`docs` with the array column `out`. Candidates are found in one projection and resolved in the next."""
    found = with_candidates(docs, text_col, detectors)
    scans = [x for x in detectors if x.scan]
    if not scans:
        return found.select(*_of(docs, out), resolve_overlaps(F.col("__candidates")).alias(out))

    @F.arrow_udf(ENTITY)
    def run(texts: pa.Array, candidates: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([everything(t, c, scans) for t, c in zip(texts.to_pylist(), candidates.to_pylist(), strict=True)], _KIND)

    return found.select(*_of(docs, out), run.asNondeterministic()("__text", "__candidates", F.size("__candidates")).alias(out))


def everything(text: str, candidates: list[dict], scans: list[Detector]) -> list[dict]:
    """A text's entities: `candidates` and what `scans` find, overlaps resolved."""
    more = [{"type": k, "start": a, "end": b, "value": text[a:b], "confidence": c, "tier": x.tier} for x in scans for k, a, b, c in x.scan(text)] if text else []
    return resolved([*candidates, *more])


def _of(docs: DataFrame, *but: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c not in but]


def with_candidates(docs: DataFrame, text_col: str, detectors: tuple[Detector, ...]) -> DataFrame:
    """`docs` with __text, null as empty, and __candidates: the entities of all detectors that aren't Python.

    A Python function of __candidates must take them twice, as its size also: folded into the call, their expressions with
    lambdas would keep Spark from seeing the function.
    """
    text = F.col("__text")
    few = [x for x in detectors if not x.scan]
    found = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    if any(x.compacting for x in few):
        found = found.withColumn("__compact", compact_digits(text)).withColumn("__blanks", removed_blanks(text))
    found = found.withColumns({f"__{k}": x.of(text, F.col("__compact"), F.col("__blanks")) for k, x in enumerate(few)})
    return found.withColumn("__candidates", F.concat(*(F.col(f"__{k}") for k in range(len(few)))) if few else F.array().cast(ENTITY))
