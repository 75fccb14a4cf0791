"""Re-identification risk of quasi-identifiers, and the one generalisation that helps most.

A case is (case_id, qis array<struct<type, value, level>>) with type profession, lieu or age. `estimate` gives F, how many
people share the case's values: with a profession, the count of the department's professionals (an upper bound);
otherwise the place's population times the share of the age. `explain` tries the next rung of each quasi-identifier
and keeps the best. A case that can't be estimated gets an `error`, and no job ends over one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, find_spans, normal_name
from ..sources.dimensions import ALL_SPECIALTIES, ANY_PROFESSIONAL, FRANCE, Dimensions

LOW, STANDARD, HIGH = 10, 20, 50
WITHDRAWN = ""
CONTRACT = "An order of magnitude from public French figures, with criteria taken as independent; it supports a decision and guarantees nothing."
UPPER_BOUND = "Upper bound: the exact place and role narrow it further."
NO_PLACE = "No place given: the whole of France is the reference."
NO_AGE = "No age given: the place's whole population counts."
NOTHING = "No quasi-identifier given: F is the whole population."
QI = "struct<type:string,value:string,level:int>"


def band(f: Column) -> Column:
    return F.when(f < LOW, "eleve").when(f < HIGH, "moyen").otherwise("faible")


def five_years(age: Column) -> Column:
    lo = F.floor(age / 5) * 5
    return F.concat_ws("-", lo.cast("string"), (lo + 4).cast("string"))


def ten_years(age: Column) -> Column:
    lo = F.floor(age / 10) * 10
    return F.concat_ws("-", lo.cast("string"), (lo + 9).cast("string"))


def senior(age: Column) -> Column:
    return F.when(age >= 65, "65-130").otherwise("0-64")


def bounds(value: Column) -> tuple[Column, Column]:
    parts = F.split(value, "-")
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")


def flat(cases: DataFrame) -> DataFrame:
    """Cases with p, l and a: the first quasi-identifier of each type as struct or null; error if a type is there twice."""

    def of(kind: str) -> Column:
        return F.get(F.filter("qis", lambda q: q["type"] == kind), F.lit(0))

    def twice(kind: str) -> Column:
        return F.when(F.size(F.filter("qis", lambda q: q["type"] == kind)) > 1, F.lit(f"more than one quasi-identifier of type {kind}"))

    return cases.select("*", F.coalesce(*map(twice, ("profession", "lieu", "age"))).alias("double_error"), of("profession").alias("p"), of("lieu").alias("l"), of("age").alias("a"))


def estimate_flat(df: DataFrame, dims: Dimensions) -> DataFrame:
    """`df` (with p, l, a, double_error) with f, dominant, upper_bound and error.

    All joins are with reference tables of a fixed size (at most one row a commune), each at most one row a match; ages
    need none: cumulative counts by age are one literal array.
    """
    ages = dims.age_counts
    running, cumulative = 0, []
    for age in range(131):
        running += ages.get(age, 0)
        cumulative.append(running)
    total = sum(ages.values())
    known = [*dims.profession_keys, ALL_SPECIALTIES, ANY_PROFESSIONAL]

    def active(q: str) -> Column:
        return F.when(F.col(f"{q}.value") != WITHDRAWN, F.col(q))

    d = df.withColumn("_p", active("p")).withColumn("_l", active("l")).withColumn("_a", active("a"))
    d = d.join(dims.communes.select(F.col("code").alias("_code"), F.col("dep").alias("_commune_dep"), F.col("pmun").alias("_pmun")), (F.col("_l.level") == 0) & (F.col("_l.value") == F.col("_code")), "left")
    d = d.join(dims.population_by_department().select(F.col("dep").alias("_pop_dep"), F.col("population").alias("_dep_pop")), (F.col("_l.level") == 1) & (F.col("_l.value") == F.col("_pop_dep")), "left")
    d = d.withColumn("_dep", F.when(F.col("_l.level") == 0, F.col("_commune_dep")).when(F.col("_l.level") == 1, F.col("_l.value")))
    d = d.join(dims.counts().select(F.col("dep").alias("_count_dep"), F.col("key").alias("_key"), F.col("n").alias("_n")), (F.col("_dep") == F.col("_count_dep")) & (F.col("_p.value") == F.col("_key")), "left")
    with_profession = F.col("_p").isNotNull()
    level = F.col("_l.level")
    error_a = (
        F.when(F.col("_l").isNull(), "a profession needs a place")
        .when((level < 0) | (level > 1), "the place's level gives no department")
        .when((level == 0) & F.col("_code").isNull(), "unknown commune")
        .when(~F.col("_p.value").isin(known), "unknown profession")
    )
    population = F.when(F.col("_l").isNull(), F.lit(total)).when(level == 0, F.col("_pmun")).when(level == 1, F.coalesce("_dep_pop", F.lit(0))).when(level.isin(2, 3), F.lit(None)).otherwise(F.lit(total)).cast("bigint")
    upto = F.array(*map(F.lit, cumulative))

    def below(age: Column) -> Column:
        """How many are younger than `age`."""
        at = F.when(age > 131, 131).otherwise(age)  # null stays null
        return F.when(age <= 0, F.lit(0)).otherwise(F.get(upto, at - 1)).cast("bigint")

    one = F.col("_a.value").try_cast("int")
    lo, hi = bounds(F.col("_a.value"))
    count = F.when(F.col("_a.level") == 0, below(one + 1) - below(one)).when(F.col("_a.level").isin(1, 2, 3), F.greatest(below(hi + 1) - below(lo), F.lit(0)))
    share = F.when(F.col("_a").isNull() | (F.col("_a.level") > 3), F.lit(1.0)).otherwise(count / F.lit(total))
    error_b = F.when(population.isNull(), F.when(level.isin(2, 3), "no population at this level of place").otherwise("unknown commune or population")).when(share.isNull(), "the age isn't a number or range")
    d = d.withColumn("error", F.coalesce("double_error", F.when(with_profession, error_a).otherwise(error_b)))
    d = d.withColumn("_population", population).withColumn("_share", share)
    f = F.when(with_profession, F.coalesce("_n", F.lit(0)).cast("double")).otherwise(F.col("_population") * F.col("_share"))
    both = F.when(F.col("_population") <= F.lit(total) * F.col("_share"), "lieu").otherwise("age")
    dominant = F.when(with_profession, "profession").when(F.col("_l").isNotNull() & F.col("_a").isNotNull(), both).when(F.col("_l").isNotNull(), "lieu").when(F.col("_a").isNotNull(), "age")
    fine = F.col("error").isNull()
    notes = F.filter(
        F.array(F.lit(CONTRACT), F.when(with_profession, F.lit(UPPER_BOUND)), F.when(~with_profession & F.col("_l").isNull(), F.lit(NO_PLACE)), F.when(~with_profession & F.col("_l").isNotNull() & F.col("_a").isNull(), F.lit(NO_AGE)), F.when(~with_profession & F.col("_l").isNull() & F.col("_a").isNull(), F.lit(NOTHING))),
        lambda n: n.isNotNull(),
    )
    return d.select(*df.columns, F.when(fine, f).alias("f"), F.when(fine, dominant).alias("dominant"), F.when(fine, with_profession).alias("upper_bound"), F.when(fine, notes).alias("notes"), "error")


def estimate(cases: DataFrame, dims: Dimensions) -> DataFrame:
    """`cases` with f, band, dominant, upper_bound, notes and error."""
    out = estimate_flat(flat(cases), dims)
    return out.select(*cases.columns, "f", F.when(F.col("f").isNotNull(), band(F.col("f"))).alias("band"), "dominant", "upper_bound", "notes", "error")


def strict(estimated: DataFrame) -> DataFrame:
    """Raises for the first row with an error when rows are computed."""
    return estimated.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True))


def next_rung(q: Column, commune_dep: Column) -> Column:
    """The next wider value of a quasi-identifier, or null at the top; `commune_dep` is the department of its commune."""
    value, level = q["value"], q["level"]
    low = bounds(value)[0]

    def rung(kind: str, v: Column, n: int) -> Column:
        return F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(n).alias("level"))

    return (
        F.when((q["type"] == "lieu") & (level == 0) & commune_dep.isNotNull(), rung("lieu", commune_dep, 1))
        .when((q["type"] == "lieu") & (level == 1), rung("lieu", F.lit(FRANCE), 4))
        .when((q["type"] == "age") & (level == 0), rung("age", five_years(value.try_cast("int")), 1))
        .when((q["type"] == "age") & (level == 1), rung("age", ten_years(low), 2))
        .when((q["type"] == "age") & (level == 2), rung("age", senior(low), 3))
        .when((q["type"] == "age") & (level == 3), rung("age", F.lit(WITHDRAWN), 4))
        .when((q["type"] == "profession") & (level == 0), rung("profession", F.lit(ALL_SPECIALTIES), 1))
        .when((q["type"] == "profession") & (level == 1), rung("profession", F.lit(ANY_PROFESSIONAL), 2))
        .when((q["type"] == "profession") & (level == 2), rung("profession", F.lit(WITHDRAWN), 3))
    )


def simulate(cases: DataFrame, dims: Dimensions) -> DataFrame:
    """A row for each quasi-identifier of each case: case_id, place, from, to, f_before, f_after, band_after, kept, reason.

    kept marks the candidate with the largest f_after; ties go to profession, then lieu, then age.
    """
    base = estimate_flat(flat(cases), dims).where("error is null").select("case_id", "qis", "p", "l", "a", F.col("f").alias("f_before"))
    rows = base.select("*", F.posexplode("qis").alias("place", "q"))
    home = dims.communes.select(F.col("code").alias("_c"), F.col("dep").alias("_d"))
    rows = rows.join(home, (F.col("q.type") == "lieu") & (F.col("q.level") == 0) & (F.col("q.value") == F.col("_c")), "left")
    rows = rows.withColumn("to", next_rung(F.col("q"), F.col("_d")))
    for short, kind in (("p", "profession"), ("l", "lieu"), ("a", "age")):
        rows = rows.withColumn(short, F.when(F.col("q.type") == kind, F.col("to")).otherwise(F.col(short)))
    tried = estimate_flat(rows.withColumn("double_error", F.lit(None).cast("string")).drop("_c", "_d"), dims)
    f_after = F.when(F.col("to").isNotNull(), F.col("f"))
    priority = F.when(F.col("q.type") == "profession", 0).when(F.col("q.type") == "lieu", 1).otherwise(2)
    tried = tried.withColumn("f_after", f_after).withColumn("rank", F.when(f_after.isNotNull(), F.struct(-f_after, priority, "place")))
    best = tried.groupBy("case_id").agg(F.min("rank").alias("best"), F.min_by("q.type", "rank").alias("best_type"))
    tried = tried.join(best, "case_id").withColumn("kept", F.coalesce(F.col("rank") == F.col("best"), F.lit(False)))
    reason = (
        F.when(F.col("to").isNull(), "no wider value can be computed")
        .when(F.col("f_after").isNull(), "not computable in this combination")
        .when(F.col("kept"), F.format_string("F: %.2f -> %.2f", "f_before", "f_after"))
        .otherwise(F.concat(F.lit("F grows less than by "), "best_type"))
    )
    return tried.select("case_id", "place", F.col("q").alias("from"), "to", "f_before", "f_after", F.when(F.col("f_after").isNotNull(), band(F.col("f_after"))).alias("band_after"), "kept", reason.alias("reason"))


def explain(cases: DataFrame, dims: Dimensions, threshold: int = STANDARD) -> DataFrame:
    """`cases` with the estimate, outcome (succes, suggestion, epuisement), suggestion, candidates, final_band and blocking."""
    first = estimate(cases, dims)
    tried = simulate(cases, dims)
    each = F.struct("place", "from", "to", "f_before", "f_after", "band_after", "kept", "reason")
    per_case = tried.groupBy("case_id").agg(F.array_sort(F.collect_list(each)).alias("candidates"))
    out = first.join(per_case, "case_id", "left")
    enough = ~F.col("upper_bound") & (F.col("f") >= threshold)
    winner = F.get(F.filter("candidates", lambda c: c["kept"]), F.lit(0))
    out = out.withColumn("suggestion", F.when(enough, F.lit(None)).otherwise(winner))
    outcome = F.when(F.col("error").isNotNull(), F.lit(None)).when(enough, "succes").when(F.col("suggestion.f_after") >= threshold, "suggestion").otherwise("epuisement")
    out = out.withColumn("outcome", outcome).withColumn("threshold", F.lit(threshold))
    none = F.array().cast(per_case.schema["candidates"].dataType)
    out = out.withColumn("candidates", F.when(F.col("outcome") == "succes", none).otherwise(F.coalesce("candidates", none)))
    return out.withColumn("final_band", F.coalesce("suggestion.band_after", "band")).withColumn("blocking", F.when(F.col("outcome") == "epuisement", F.transform("qis", lambda q: q["type"])).otherwise(F.array().cast("array<string>")))


def value_label(q: Column, commune: Column, specialty: Column) -> Column:
    """A quasi-identifier's value for people; `commune` and `specialty` are the labels of its codes, or null."""
    value = q["value"]
    return (
        F.when((q["type"] == "lieu") & (value == FRANCE), "France")
        .when((q["type"] == "lieu") & (q["level"] == 0), F.coalesce(commune, value))
        .when(q["type"] == "lieu", F.concat(F.lit("département "), value))
        .when((q["type"] == "age") & (value == WITHDRAWN), "(âge retiré)")
        .when(q["type"] == "age", F.concat(value, F.lit(" ans")))
        .when(value == ANY_PROFESSIONAL, "professionnel de santé")
        .when(value == ALL_SPECIALTIES, "médecin de toute spécialité")
        .when(value == WITHDRAWN, "(profession retirée)")
        .otherwise(F.coalesce(specialty, value))
    )


def labelled(qis: DataFrame, dims: Dimensions, qi_col: str = "qi") -> DataFrame:
    """`qis` with `label` for the struct column `qi_col`."""
    q = F.col(qi_col)
    c = dims.communes.select(F.col("code").alias("_c"), F.col("libelle").alias("_cl"))
    s = dims.specialties.select(F.col("code").alias("_s"), F.col("label").alias("_sl"))
    out = qis.join(c, (q["type"] == "lieu") & (q["value"] == F.col("_c")), "left").join(s, (q["type"] == "profession") & (q["value"] == F.col("_s")), "left")
    return out.withColumn("label", value_label(q, F.col("_cl"), F.col("_sl"))).drop("_c", "_cl", "_s", "_sl")


def narrative(traced: DataFrame) -> DataFrame:
    """`traced` with `narrative`: the case, its risk, what is proposed, and the notes, a line each."""
    q = F.array_join(F.transform("qis", lambda x: F.concat_ws(" ", x["type"], x["value"])), ", ")
    head = F.format_string("Case [%s]: F = %.2f, risk %s.", q, F.col("f"), F.upper("band"))
    s = F.col("suggestion")
    step = (
        F.when(F.col("outcome") == "succes", F.format_string("Nothing to generalise: F reaches %d.", F.col("threshold")))
        .when(F.col("outcome") == "suggestion", F.format_string("Suggested: %s %s -> %s (F: %.2f -> %.2f, risk %s).", s["from"]["type"], s["from"]["value"], s["to"]["value"], s["f_before"], s["f_after"], F.upper(s["band_after"])))
        .when(F.col("outcome") == "epuisement", F.format_string("The best generalisation stays under %d. Blocking: %s. A person must decide.", F.col("threshold"), F.array_join("blocking", ", ")))
    )
    return traced.withColumn("narrative", F.array_join(F.concat(F.array(head, step), F.col("notes")), "\n"))


def audit(traced: DataFrame) -> DataFrame:
    """`traced` with `audit`: the trace as JSON with null fields kept."""
    fields = F.struct("qis", "f", "band", "outcome", "threshold", "final_band", "blocking", "candidates", "notes")
    return traced.withColumn("audit", F.to_json(fields, {"ignoreNullFields": "false"}))


def generalised(dims: Dimensions) -> DataFrame:
    """(code, level, value): each commune at levels 0 name, 1 department, 2 region, 3 zone, 4 France."""
    c = dims.with_zones()
    rungs = F.array(F.col("libelle"), F.col("dep"), F.col("region"), F.col("zone"), F.lit("France"))
    return c.select("code", F.posexplode(rungs).alias("level", "value"))


# == from text ==

SPECIALTIES = {"anesthésiste": "05", "anesthésiste-réanimateur": "05", "cardiologue": "06", "chirurgien": "02", "dermatologue": "07", "gastro-entérologue": "08", "gastroentérologue": "08", "gynécologue": "09", "généraliste": "01", "médecin généraliste": "01", "ophtalmologiste": "03", "ophtalmologue": "03", "orl": "04", "oto-rhino-laryngologiste": "04", "pneumologue": "11", "psychiatre": "12", "pédiatre": "10", "radiologue": "13"}
PROFESSIONS = {"chirurgien-dentiste": "chirurgien-dentiste", "dentiste": "chirurgien-dentiste", "pharmacien": "pharmacien", "pharmacienne": "pharmacien", "podologue": "pedicure-podologue", "pédicure-podologue": "pedicure-podologue", "sage-femme": "sage-femme"}


def ages_in(text: Column) -> Column:
    """Ages of at most 120 in a text, as quasi-identifiers."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![0-9A-Za-z_])([0-9]{{1,3}}){WS}*ans(?![0-9A-Za-z_])"), F.lit(1))
    fit = F.filter(F.transform(found, lambda a: a.cast("int")), lambda a: a <= 120)
    return F.transform(fit, lambda a: F.struct(F.lit("age").alias("type"), a.cast("string").alias("value"), F.lit(0).alias("level")))


def professions_in(text: Column) -> Column:
    """Professions whose words occur anywhere in a text, specialties first; a word within another counts too."""
    words = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in [*SPECIALTIES.items(), *PROFESSIONS.items()]))
    return F.transform(F.filter(words, lambda w: F.contains(F.lower(text), w["k"])), lambda w: F.struct(F.lit("profession").alias("type"), w["v"].alias("value"), F.lit(0).alias("level")))


def place_candidates(text: Column) -> Column:
    """Stretches of one to three neighbouring capitalised words, longer first, with what is between them."""
    words = find_spans(text, r"[A-ZÀ-Ý][0-9A-Za-z_À-ÿ'-]*")
    n = F.size(words)

    def at(i: Column) -> Column:
        sizes = F.filter(F.array(F.lit(2), F.lit(1), F.lit(0)), lambda k: i + k < n)
        return F.transform(sizes, lambda k: F.substring(text, F.get(words, i)["start"] + 1, F.get(words, i + k)["end"] - F.get(words, i)["start"]))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at))).otherwise(F.array().cast("array<string>"))


def extract(docs: DataFrame, dims: Dimensions, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, qis): professions, then places that exactly one commune is named as, then ages; repeated hits stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    near = docs.select(F.col(id_col), F.posexplode(place_candidates(text)).alias("place", "name")).withColumn("norm", normal_name(F.col("name")))
    hits = near.join(dims.unique_names(), "norm").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("hits"))
    places = F.transform(F.coalesce("hits", F.array().cast("array<struct<place:int,code:string>>")), lambda h: F.struct(F.lit("lieu").alias("type"), h["code"].alias("value"), F.lit(0).alias("level")))
    own = docs.select(F.col(id_col), professions_in(text).alias("_p"), ages_in(text).alias("_a"))
    return own.join(hits, id_col, "left").select(id_col, F.concat("_p", places, "_a").cast(f"array<{QI}>").alias("qis"))
