"""Queries against their DuckDB oracles, and the entry module."""

import pytest

import __spark_entry__
from veilspark.plans import catalogue

SOME = "email_spans compact_digits nir_key iban_mod97 detect_all traps_structural resolve_overlaps redact_masked_text restore_tolerant name_coreference reid_estimate_case_a reid_estimate_case_b reid_suggest reid_candidates qi_extract_lieu score_strict score_overlap leak_rate over_masking fp_topk boundary_taxonomy ingest_formats stream_redact".split()


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_oracle(same_as_duckdb, name):
    same_as_duckdb(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"doc_id", "n_distinct", "restored_exactly", "restored_md5"}
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_redaction_is_one_stage_without_a_shuffle(spark, capsys):
    __spark_entry__.queries()["redact_documents"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
