"""Catalogue queries cover all rows of their tables."""

import re

from veilspark.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


def test_overlaps_of_every_order_are_resolved(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    want = set()
    for key, cust in orders:
        cand = []
        for j in range(5):
            a = (cust * 7 + j * 11) % 40
            tier = 3 - (key + j) % 4
            cand.append((-(3 + (key + j * 5) % 9), -((key + j) % 3), -tier, a, j))
        kept = []
        for size, _, _, a, j in sorted(cand):
            if all(a >= y or x >= a - size for _, x, y in kept):
                kept.append((j, a, a - size))
        want |= {(key, *k) for k in kept}
    got = [tuple(r) for r in catalogue.resolve_overlaps(spark, SF_DIR).select("doc_id", "j", "start_at", "end_at").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r[0] for r in got} == {r[0] for r in orders}


ONE_DETECTOR = "nir rpps iban finess name birthdate address phone email_corpus establishment".split()


def test_detectors_read_texts_of_every_type(spark, monkeypatch):
    gold = catalogue.corpus(spark, SF_DIR).collect()
    mislabelled = spark.createDataFrame([(r["doc_id"], "another", r["text"]) for r in gold], "doc_id long, type string, text string")
    monkeypatch.setattr(catalogue, "corpus", lambda *_: mislabelled)
    for name, detector in zip(ONE_DETECTOR, catalogue.d.DEFAULT, strict=True):
        want = {(r["doc_id"], r["start_at"], r["end_at"], r["value"]) for r in gold if r["type"] == detector.name}
        got = [(r["doc_id"], r["start_at"], r["end_at"], r["value"]) for r in catalogue.QUERIES[f"{name}_spans"](spark, SF_DIR).collect()]
        assert want and len(got) == len(want) and set(got) == want, name


def test_phone_numbers_inside_other_texts(spark):
    """The first digits of an IBAN written in fours may look like a telephone number."""
    sf_dir = "/root/testdata/sf0.01"
    phone = re.compile(r"(?<![0-9])(?:\+33[ .-]?|0)[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9])")
    rows = catalogue.corpus(spark, sf_dir).collect()
    want = sorted((r["doc_id"], m.start(), m.end(), m.group()) for r in rows for m in phone.finditer(r["text"]))
    got = sorted((r["doc_id"], r["start_at"], r["end_at"], r["value"]) for r in catalogue.QUERIES["phone_spans"](spark, sf_dir).collect())
    assert got == want and len(want) > sum(r["type"] == "telephone" for r in rows)
