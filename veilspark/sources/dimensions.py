"""Public reference tables for the risk estimate: communes, health professionals, ages, first names.

`read_*` take files in the published layouts. `sample` gives a small invented set of the same shape that keeps a few real
figures, for tests and examples; it isn't fit for real estimates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_name

ALL_SPECIALTIES, ANY_PROFESSIONAL, FRANCE = "TOUTE_SPECIALITE", "PROFESSIONNEL_DE_SANTE", "FR"
ZONES = {"Est": ("27", "44"), "Nord": ("11", "28", "32"), "Outre-mer": ("01", "02", "03", "04", "06"), "Ouest": ("24", "52", "53"), "Sud": ("75", "76", "84", "93", "94")}


@dataclass(frozen=True)
class Dimensions:
    """communes (code, libelle, norm, dep, reg, pmun), specialties (code, label), physicians (dep, code, n), professions
    (dep, profession, n), ages (age, n), regions (reg, label)."""

    communes: DataFrame
    specialties: DataFrame
    physicians: DataFrame
    professions: DataFrame
    ages: DataFrame
    regions: DataFrame

    @cached_property
    def age_counts(self) -> dict[int, int]:
        """How many there are of each age: about a hundred rows, read once."""
        return {r["age"]: r["n"] for r in self.ages.collect()}

    @cached_property
    def profession_keys(self) -> list[str]:
        """The codes of specialties and the names of professions: some dozens, read once."""
        return [r[0] for r in self.specialties.select("code").unionByName(self.professions.select(F.col("profession").alias("code")).distinct()).collect()]

    def population_by_department(self) -> DataFrame:
        """(dep, population); unknown populations count as 0."""
        return self.communes.groupBy("dep").agg(F.sum(F.coalesce("pmun", F.lit(0))).cast("bigint").alias("population"))

    def physicians_by_department(self) -> DataFrame:
        return self.physicians.groupBy("dep").agg(F.sum("n").cast("bigint").alias("n"))

    def professionals_by_department(self) -> DataFrame:
        """(dep, n): physicians of all specialties and the other professions together."""
        both = self.physicians.select("dep", "n").unionByName(self.professions.select("dep", "n"))
        return both.groupBy("dep").agg(F.sum("n").cast("bigint").alias("n"))

    def counts(self) -> DataFrame:
        """(dep, key, n) for every specialty, profession and the two wider groups."""
        return (
            self.physicians.select("dep", F.col("code").alias("key"), "n")
            .unionByName(self.professions.select("dep", F.col("profession").alias("key"), "n"))
            .unionByName(self.physicians_by_department().select("dep", F.lit(ALL_SPECIALTIES).alias("key"), "n"))
            .unionByName(self.professionals_by_department().select("dep", F.lit(ANY_PROFESSIONAL).alias("key"), "n"))
        )

    def unique_names(self) -> DataFrame:
        """(norm, code) of names that exactly one commune has."""
        return self.communes.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code")).where("n = 1").select("norm", "code")

    def age_shares(self) -> DataFrame:
        """(age, n, share)."""
        total = self.ages.agg(F.sum("n").alias("total"))
        return self.ages.join(total).select("age", "n", (F.col("n") / F.col("total")).alias("share"))

    def with_zones(self) -> DataFrame:
        """Communes with the label of their region, null if it has none, and the large zone."""
        zone = F.lit(None).cast("string")
        for name, regs in ZONES.items():
            zone = F.when(F.col("reg").isin(*regs), name).otherwise(zone)
        return self.communes.join(self.regions.withColumnRenamed("label", "region"), "reg", "left").withColumn("zone", zone)


def read_communes(spark: SparkSession, path: str) -> DataFrame:
    """Communes from a `;` CSV, gzip or not, with a header; an empty population is null."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    return df.select(F.col("COM").alias("code"), F.col("LIBELLE").alias("libelle"), F.col("NORM").alias("norm"), F.col("DEP").alias("dep"), F.col("REG").alias("reg"), F.col("PMUN").cast("bigint").alias("pmun"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def read_physicians(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(specialties, physicians) from nested JSON: labels by code, and counts by department and code."""
    j = _json(spark, path, "labels map<string,string>, by_dep map<string,map<string,bigint>>")
    inner = j.select(F.explode("j.by_dep").alias("dep", "m")).select("dep", F.explode("m").alias("code", "n"))
    return j.select(F.explode("j.labels").alias("code", "label")), inner


def read_professions(spark: SparkSession, path: str) -> DataFrame:
    j = _json(spark, path, "map<string,map<string,bigint>>")
    return j.select(F.explode("j").alias("profession", "m")).select("profession", F.explode("m").alias("dep", "n"))


def read_ages(spark: SparkSession, path: str) -> DataFrame:
    j = _json(spark, path, "map<string,bigint>")
    return j.select(F.explode("j").alias("a", "n")).select(F.col("a").cast("int").alias("age"), "n")


def read_hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(departments (dep, reg), regions (reg, label))."""
    j = _json(spark, path, "dep_reg map<string,string>, reg_label map<string,string>")
    return j.select(F.explode("j.dep_reg").alias("dep", "reg")), j.select(F.explode("j.reg_label").alias("reg", "label"))


def read_first_names(spark: SparkSession, path: str) -> DataFrame:
    """(norm): a name a line, gzip or not."""
    return spark.read.text(path).select(F.trim("value").alias("norm")).where("norm <> ''").distinct()


def known_first_names(names: DataFrame, gazetteer: DataFrame, name_col: str = "name") -> DataFrame:
    """The rows of `names` whose normalised name is in the gazetteer."""
    return names.withColumn("norm", normal_name(F.col(name_col))).join(gazetteer, "norm", "left_semi")


# == building the tables from raw publications ==


def department_code(raw):
    """`057 -Moselle` -> 57, 02A -> 2A, 971 as it is."""
    return F.regexp_replace(F.trim(F.element_at(F.split(raw, "-"), 1)), "^0(?=..$)", "")


def build_communes(raw: DataFrame, populations: DataFrame) -> DataFrame:
    """Communes proper (TYPECOM = COM) with the population of their code, null if there is none."""
    of = raw.where("TYPECOM = 'COM'").select(F.col("COM").alias("code"), F.col("LIBELLE").alias("libelle"), normal_name(F.col("LIBELLE")).alias("norm"), F.col("DEP").alias("dep"), F.col("REG").alias("reg"))
    return of.join(populations.select(F.col("COM").alias("code"), F.col("PMUN").cast("bigint").alias("pmun")), "code", "left")


def build_first_names(raw: DataFrame, name_col: str = "prenom") -> DataFrame:
    """Distinct normalised names of three letters or more, sorted."""
    return raw.select(normal_name(F.col(name_col)).alias("norm")).where("length(norm) >= 3").distinct().orderBy("norm")


def unknown_departments(counts: DataFrame, departments: DataFrame) -> DataFrame:
    """Departments that counts have and the hierarchy lacks; should be empty."""
    return counts.where("dep not in ('000', '999')").select("dep").distinct().join(departments, "dep", "left_anti")


def require_known_departments(counts: DataFrame, departments: DataFrame, show: int = 20) -> DataFrame:
    """`counts`, or a ValueError that names the first departments in them that the hierarchy lacks."""
    lost = [r.dep for r in unknown_departments(counts, departments).orderBy("dep").limit(show).collect()]
    if lost:
        raise ValueError(f"departments without a region: {', '.join(lost)}")
    return counts


# == a small invented set ==

_TOWNS = "Aubeville Bellerive Champfleur Dorlanges Esperelle Fontclair Grandpré Hauterive Issanges Jolival".split()


def sample_rows() -> dict[str, list[tuple]]:
    """The invented tables as rows, in the order of their columns."""
    communes = [("57672", "Thionville", "THIONVILLE", "57", "44", 42658), ("57001", "Aboncourt", "ABONCOURT", "57", "44", 320), ("54003", "Aboncourt", "ABONCOURT", "54", "44", 110), ("13055", "Marseille", "MARSEILLE", "13", "93", None), ("57999", "Val-de-Seille", "VAL DE SEILLE", "57", "44", 1_051_309 - 42658 - 320)]
    for d, (dep, reg) in enumerate([("54", "44"), ("13", "93"), ("75", "11"), ("35", "53"), ("976", "06"), ("2A", "94")]):
        communes += [(f"{dep}{100 + t}"[:5] if len(dep) == 2 else f"{dep}{10 + t}", f"{name} {dep}", f"{name.upper().replace('É', 'E')} {dep}", dep, reg, 500 * (t + 1) + 37 * d) for t, name in enumerate(_TOWNS)]
    specialties = [(f"{k:02d}", f"Spécialité {k:02d}") for k in range(1, 15)]
    physicians = [("57", f"{k:02d}", 51 if k == 11 else 218) for k in range(1, 14)] + [("57", "14", 2894 - 51 - 12 * 218)]
    physicians += [(dep, f"{k:02d}", 10 * (d + 1) + k) for d, dep in enumerate(["54", "13", "75", "35"]) for k in range(1, 15)]
    professions = [("57", "pharmacien", 976), ("57", "chirurgien-dentiste", 700), ("57", "sage-femme", 300), ("57", "pedicure-podologue", 5107 - 2894 - 1976)]
    professions += [(dep, p, 40 * (d + 1) + 7 * k) for d, dep in enumerate(["54", "13", "75", "35"]) for k, p in enumerate(("pharmacien", "chirurgien-dentiste", "sage-femme", "pedicure-podologue"))]
    fixed = {89: 231_265, 94: 105_253}
    rest = 69_079_962 - sum(fixed.values())
    ages = [(a, fixed.get(a, rest // 103 + (1 if a < rest % 103 else 0))) for a in range(105)]
    short = 69_079_962 - sum(n for _, n in ages)
    ages[0] = (0, ages[0][1] + short)
    regions = [("44", "Grand Est"), ("93", "Provence-Alpes-Côte d'Azur"), ("11", "Île-de-France"), ("53", "Bretagne"), ("94", "Corse")]
    return {"communes": communes, "specialties": specialties, "physicians": physicians, "professions": professions, "ages": ages, "regions": regions}


SCHEMAS = {
    "communes": "code string, libelle string, norm string, dep string, reg string, pmun bigint",
    "specialties": "code string, label string",
    "physicians": "dep string, code string, n bigint",
    "professions": "dep string, profession string, n bigint",
    "ages": "age int, n bigint",
    "regions": "reg string, label string",
}


def sample(spark: SparkSession) -> Dimensions:
    return Dimensions(**{k: spark.createDataFrame(rows, SCHEMAS[k]) for k, rows in sample_rows().items()})


def sample_sql() -> str:
    """The invented tables as common table expressions, without the leading WITH."""

    def cell(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    parts = []
    for k, rows in sample_rows().items():
        cols = [c.split()[0] for c in SCHEMAS[k].split(", ")]
        parts.append(f"{k}({', '.join(cols)}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")")
    return ",\n".join(parts)
