"""For people to read: marked-up texts, counts in words, and first examples of what detection gets wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"\[([A-Z_]+)_([0-9]+)\]"


def escaped(text: Column) -> Column:
    """Text safe inside HTML."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _mark(value: Column, kind: Column, title: Column | None = None) -> Column:
    more = F.lit("") if title is None else F.concat(F.lit(' title="'), escaped(title), F.lit('"'))
    return F.concat(F.lit('<mark class="'), F.lower(kind), F.lit('"'), more, F.lit(">"), escaped(value), F.lit("</mark>"))


def marked_spans(text: Column, entities: Column) -> Column:
    """HTML of a text with its entities (by start, without overlaps) marked, type and confidence as titles."""

    def piece(e: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(entities, i - 1)["end"]).otherwise(0)
        return F.concat(escaped(F.substring(text, before + 1, e["start"] - before)), _mark(e["value"], e["type"], F.format_string("%s, %s", e["type"], e["confidence"].cast("string"))))

    last = F.coalesce(F.try_element_at(entities, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(entities, piece), ""), escaped(F.substring(text, last + 1, F.length(text))))


def marked_tokens(masked: Column) -> Column:
    """HTML of a masked text with its tokens marked."""
    return F.regexp_replace(escaped(masked), TOKEN, '<mark class="$1">$0</mark>')


def marked_values(text: Column, entities: Column) -> Column:
    """HTML of a text with every occurrence of the entities' values marked; of values that begin alike the longest counts."""
    values = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["value"])), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = F.array_join(F.transform(values, lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), "|")
    kinds = F.map_from_entries(F.transform(values, lambda v: F.struct(v, F.element_at(F.filter(entities, lambda e: e["value"] == v), -1)["type"])))
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.transform(F.split(text, pattern, -1), escaped)
    marks = F.concat(F.transform(found, lambda m: _mark(m, F.element_at(kinds, m))), F.array(F.lit("")))
    return F.when(F.size(entities) > 0, F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), "")).otherwise(escaped(text))


def type_counts(entities: Column) -> Column:
    """array<struct<type, n>>: how many entities of each type, in order of first mention."""
    types = F.transform(entities, lambda e: e["type"])
    return F.transform(F.array_distinct(types), lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).alias("n")))


def counts_sentence(entities: Column) -> Column:
    """The counts in words: "3 entities: 2 nom, 1 email"."""
    n = F.size(entities)
    parts = F.array_join(F.transform(type_counts(entities), lambda c: F.concat_ws(" ", c["n"].cast("string"), c["type"])), ", ")
    return F.when(n == 0, "0 entities").otherwise(F.concat(n.cast("string"), F.when(n == 1, " entity: ").otherwise(" entities: "), parts))


def first_examples(texts: DataFrame, gold: DataFrame, pred: DataFrame, kind: str, n: int = 20) -> DataFrame:
    """(doc_id, start, end, fragment, found): the first `n` annotated spans of a type that nothing overlaps or that are found in part.

    In order of document and place; `found` is the first overlapping prediction's text, null if there is none.
    """
    g = gold.where(F.col("type") == kind).select("doc_id", F.col("start").alias("gs"), F.col("end").alias("ge"))
    p = pred.select("doc_id", F.col("start").alias("ps"), F.col("end").alias("pe"))
    first = g.join(p, (g["doc_id"] == p["doc_id"]) & (F.col("ps") < F.col("ge")) & (F.col("gs") < F.col("pe")), "left").groupBy(g["doc_id"], "gs", "ge").agg(F.min(F.struct("ps", "pe")).alias("p"))
    bad = first.where(F.col("p.ps").isNull() | (F.col("p.ps") != F.col("gs")) | (F.col("p.pe") != F.col("ge"))).orderBy("doc_id", "gs", "ge").limit(n)

    def of(lo: Column, hi: Column) -> Column:
        return F.substring("text", lo + 1, hi - lo)

    return bad.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", F.col("gs").alias("start"), F.col("ge").alias("end"), of(F.col("gs"), F.col("ge")).alias("fragment"), of(F.col("p.ps"), F.col("p.pe")).alias("found"))
