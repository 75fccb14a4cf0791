"""Scores of predicted spans against annotated ones: strict and overlapping matches, leaked and needlessly masked characters.

Both sides are (doc_id, type, start, end). A document's spans meet in one row of arrays; the rest are folds over them, so
one shuffle by doc_id is all, and counts by type are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,type:string>>"


def paired(gold: DataFrame, predicted: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, gold, pred): arrays by start; documents without predictions, or without annotations, have empty ones."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type").alias("s"), F.lit(name).alias("side"))

    both = side(gold, "gold").unionByName(side(predicted, "pred"))
    of = {n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("s")))).cast(SPANS).alias(n) for n in ("gold", "pred")}
    out = both.groupBy("doc_id").agg(*of.values())
    if docs is None:
        return out
    none = F.array().cast(SPANS)
    return docs.join(out, "doc_id", "left").withColumn("gold", F.coalesce("gold", none)).withColumn("pred", F.coalesce("pred", none))


def matches(gold: Column, pred: Column, fits) -> Column:
    """The types of annotated spans that find a free prediction of their type, greedy in order; each prediction serves once."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("types"))

    def step(acc: Column, g: Column) -> Column:
        every = F.when(F.size(pred) > 0, F.sequence(F.lit(0), F.size(pred) - 1)).otherwise(F.array().cast("array<int>"))
        free = F.filter(every, lambda i: ~F.array_contains(acc["used"], i) & (F.get(pred, i)["type"] == g["type"]) & fits(g, F.get(pred, i)))
        hit = F.get(free, F.lit(0))
        return F.when(hit.isNotNull(), F.struct(F.concat(acc["used"], F.array(hit)).alias("used"), F.concat(acc["types"], F.array(g["type"])).alias("types"))).otherwise(acc)

    return F.aggregate(gold, start, step, lambda a: a["types"])


def strict_fit(g: Column, p: Column) -> Column:
    return (g["start"] == p["start"]) & (g["end"] == p["end"])


def overlap_fit(g: Column, p: Column) -> Column:
    return (p["start"] < g["end"]) & (g["start"] < p["end"])


def merged(spans: Column) -> Column:
    """Disjoint stretches covered by spans that are sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        apart = F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.when(F.size(acc) == 0, apart).when(s["start"] <= last["end"], longer).otherwise(apart)

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def covered(span: Column, stretches: Column) -> Column:
    """How many characters of a span lie in disjoint stretches."""
    return F.aggregate(stretches, F.lit(0), lambda n, s: n + F.greatest(F.lit(0), F.least(span["end"], s["end"]) - F.greatest(span["start"], s["start"])))


def total(stretches: Column) -> Column:
    return F.aggregate(stretches, F.lit(0), lambda n, s: n + s["end"] - s["start"])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")


def score(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """A row a type and one, TOTAL, for all: counts, strict and overlapping precision, recall and F1, and the leak rate.

    Leaked characters are those of annotated spans that no prediction of any type covers.
    """
    both = paired(gold, predicted)
    cover = both.withColumn("stretches", merged(F.col("pred")))

    def rows(array: Column, what: str, amount=lambda s: F.lit(1)) -> Column:
        return F.transform(array, lambda s: F.struct(s["type"].alias("type"), F.lit(what).alias("what"), amount(s).cast("bigint").alias("n")))

    strict = F.transform(matches(F.col("gold"), F.col("pred"), strict_fit), lambda t: F.struct(t.alias("type"), F.lit("strict_tp").alias("what"), F.lit(1).cast("bigint").alias("n")))
    loose = F.transform(matches(F.col("gold"), F.col("pred"), overlap_fit), lambda t: F.struct(t.alias("type"), F.lit("overlap_tp").alias("what"), F.lit(1).cast("bigint").alias("n")))
    parts = F.concat(
        rows(F.col("gold"), "n_gold"),
        rows(F.col("pred"), "n_pred"),
        strict,
        loose,
        rows(F.col("gold"), "gold_chars", lambda s: s["end"] - s["start"]),
        rows(F.col("gold"), "leaked_chars", lambda s: s["end"] - s["start"] - covered(s, F.col("stretches"))),
    )
    names = ("n_gold", "n_pred", "strict_tp", "overlap_tp", "gold_chars", "leaked_chars")
    flat = cover.select(F.explode(parts).alias("x")).select("x.*")
    counts = flat.rollup("type").agg(*(F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).cast("bigint").alias(n) for n in names))
    out = counts.withColumn("type", F.coalesce("type", F.lit("TOTAL")))
    for kind in ("strict", "overlap"):
        tp = F.col(f"{kind}_tp")
        out = out.withColumn(f"{kind}_precision", ratio(tp, F.col("n_pred"))).withColumn(f"{kind}_recall", ratio(tp, F.col("n_gold")))
        p, r = F.col(f"{kind}_precision"), F.col(f"{kind}_recall")
        out = out.withColumn(f"{kind}_f1", ratio(2 * p * r, p + r))
    return out.withColumn("leak_rate", ratio(F.col("leaked_chars"), F.col("gold_chars")))


def over_masking(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: characters predicted, those outside annotations, all characters, and the share masked needlessly.

    `docs` is (doc_id, text). Without any annotation, every prediction is a false one, and the same figures say how many.
    """
    both = paired(gold, predicted, docs.select("doc_id", F.length("text").alias("chars")))
    p, g = merged(F.col("pred")), merged(F.col("gold"))
    apart = both.select("chars", p.alias("p"), g.alias("g"))
    inside = F.aggregate("p", F.lit(0), lambda n, s: n + covered(s, F.col("g")))
    sums = apart.select(F.col("chars"), total(F.col("p")).alias("p"), inside.alias("both")).agg(F.sum("p").cast("bigint").alias("masked_chars"), F.sum(F.col("p") - F.col("both")).cast("bigint").alias("needless_chars"), F.sum("chars").cast("bigint").alias("text_chars"))
    return sums.withColumn("needless_share", ratio(F.col("needless_chars"), F.col("text_chars")))


def false_positives(docs: DataFrame, gold: DataFrame, predicted: DataFrame, top: int = 30) -> DataFrame:
    """The `top` most frequent texts of predictions that touch no annotation, for each type; ties by text."""
    from pyspark.sql import Window

    both = paired(gold, predicted, docs.select("doc_id", "text"))
    bad = F.filter("pred", lambda p: ~F.exists("gold", lambda g: overlap_fit(g, p)))
    rows = both.select("text", F.explode(bad).alias("p")).select("p.type", F.substring(F.col("text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("fragment"))
    counts = rows.groupBy("type", "fragment").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "fragment"))).where(F.col("place") <= top)


def boundaries(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(type, outcome, n): how the first prediction of its type that touches an annotated span is cut."""
    both = paired(gold, predicted).select(F.explode("gold").alias("g"), "pred")
    first = F.get(F.filter("pred", lambda p: (p["type"] == F.col("g.type")) & overlap_fit(F.col("g"), p)), F.lit(0))
    x = both.select("g", first.alias("p"))
    outcome = (
        F.when(F.col("p").isNull(), "missed")
        .when((F.col("p.start") == F.col("g.start")) & (F.col("p.end") == F.col("g.end")), "exact")
        .when((F.col("p.start") > F.col("g.start")) & (F.col("p.end") >= F.col("g.end")), "start cut")
        .when((F.col("p.start") <= F.col("g.start")) & (F.col("p.end") < F.col("g.end")), "end cut")
        .when((F.col("p.start") > F.col("g.start")) & (F.col("p.end") < F.col("g.end")), "both cut")
        .otherwise("wider")
    )
    return x.groupBy(F.col("g.type").alias("type"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def leaked_fragments(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(type, fragment, n): the uncovered characters of annotated spans that are covered in part."""
    both = paired(gold, predicted, docs.select("doc_id", "text")).withColumn("stretches", merged(F.col("pred")))
    x = both.select("text", "stretches", F.explode("gold").alias("g"))
    spots = F.filter(F.sequence(F.col("g.start"), F.col("g.end") - 1), lambda i: ~F.exists("stretches", lambda s: (s["start"] <= i) & (i < s["end"])))
    x = x.select(F.col("g.type").alias("type"), F.array_join(F.transform(spots, lambda i: F.substring(F.col("text"), i + 1, F.lit(1))), "").alias("fragment"), (F.col("g.end") - F.col("g.start")).alias("size"))
    return x.where("fragment <> '' and length(fragment) < size").groupBy("type", "fragment").agg(F.count(F.lit(1)).alias("n"))


def corpus_statistics(gold: DataFrame) -> DataFrame:
    """(type, n, chars)."""
    return gold.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("chars"))


def third_party(predictions: DataFrame, mapping: dict[str, str], least: float = 0.35) -> DataFrame:
    """Another engine's (doc_id, type, start, end, score) with types renamed and low scores left out; unknown types stay."""
    names = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return predictions.where(F.col("score") >= least).withColumn("type", F.coalesce(F.try_element_at(names, F.col("type")), F.col("type"))).drop("score")
