"""Patterns that begin with rare characters find what their plain forms find, and long texts take time in proportion."""

import random
import time

from pyspark.sql import functions as F

from veilspark.functions import text as tx
from veilspark.operators import detect as d

_B = "[ \\t\u00a0\u202f]"
_S = r"[ .\-]?"
PLAIN = {
    d._NIR: rf"(?<!\d)[1-8](?:{_S}\d\d){{2}}{_S}(?:2[ABab]|\d\d)(?:{_S}\d\d\d){{2}}{_S}\d\d(?!\d)",
    d._IBAN: r"(?<![\dA-Za-z])[Ff][Rr]\d\d(?:[- ]?[\dA-Za-z]){23}(?![\dA-Za-z])",
    d._RPPS: r"(?<!\d)(?:\d ?){10}\d(?!\d)",
    d._FINESS: r"(?<!\d)\d{9}(?!\d)",
    d._PHONE: rf"(?<!\d)(?:\+33{_S}|0)[1-9](?:{_S}\d\d){{4}}(?!\d)",
    d._BORN: d._BORN.replace("(?=[dn])", ""),
    d._TOWN_ONLY: d._TOWN_ONLY.replace(r"\d(?<!\d\d)\d{4}", r"(?<!\d)\d{5}"),
    d._ADDRESS: d._ADDRESS.replace(r"\d(?<!\d\d)\d{4}", r"(?<!\d)\d{5}"),
    d._PLACE: d._PLACE.replace("(?=[CEFHILMRS])", ""),
    tx._GAP: f"(?:(?<=[0-9])|(?<=[0-9][A-Z])){_B}+(?=[0-9]|[A-Z][0-9])",
}
PIECES = """1|85|057|0|33|+33|+|12345|75015 Paris|70160 Saint Rémy| |  |\u00a0|\t|.|-|,|\n|FR76|fr76 3000 6000 0112 3456 7890 189|fR|1 85 05 78 006 084 91|185057800608491|10001234565|10987 65432 3|570000125|57 0000 125|
née le 3|NÉ LE |DDN : |Date de naissance |né(e) le 1|12/05/1988|12 rue des Lilas, |5, avenue du Parc\n|10000 UI|CH de Vesoul|EHPAD Bellevue|Foyer les Tilleuls|HCH Metz|_CH Metz|RÉSIDENCE X|Clinique Pasteur|MAS d'Or|ſ|\u212a|ı|\u001f|😀|A|B7|2A|\u0663|mot|é|n|d|01 23 45 67 89|01.23.45.67.89|0123456789""".replace("\n", "", 1).split("|")


def test_patterns_find_what_their_plain_forms_find(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for ours, plain in PLAIN.items():
        assert ours != plain
        row = df.select(*(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", ours), ("b", plain))), *(F.split("t", p).alias(n) for n, p in (("c", ours), ("e", plain))))
        wrong = row.where("a <> b or c <> e").count()
        assert wrong == 0 and row.where("size(a) > 0").count() > 20, ours


def test_spans_hold_their_values_whatever_the_text_holds(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", d.phone(F.col("t")).alias("e"), tx.find_spans(F.col("t"), "[0-9]+").alias("n")).collect()
    assert sum("\u001f" in r.t and bool(r.n) for r in rows) > 100
    for r in rows:
        assert all(r.t[x.start : x.end] == x.value for x in (*r.e, *r.n))


def test_many_towns_and_numbers_take_time_in_proportion(spark):
    n = 20_000
    df = spark.createDataFrame([(" ; ".join(["75015 Paris"] * n), " ; ".join(["10001234565"] * n))], "towns string, numbers string")
    df.select(F.size(d.address(F.lit("75015 Paris"))), F.size(d.rpps(F.lit("10001234565")))).collect()
    began = time.time()
    row = df.select(F.size(d.address(F.col("towns"))).alias("a"), F.size(d.rpps(F.col("numbers"))).alias("r")).first()
    assert tuple(row) == (n, n) and time.time() - began < 30  # each looked through the whole text before
