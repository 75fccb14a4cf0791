"""Functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Registers luhn_valid(digits), risk_band(f), and the table function name_spans(text) for this session."""
    from ..operators.names import find_names

    @F.udtf(returnType="start int, end int, value string, confidence double")
    class NameSpans:
        def eval(self, text: str):
            for a, b, c in find_names(text):
                yield a, b, text[a:b], c

    spark.udtf.register("name_spans", NameSpans)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION luhn_valid(d STRING) RETURNS BOOLEAN RETURN d = '' OR luhn_check(d)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION risk_band(f DOUBLE) RETURNS STRING RETURN CASE WHEN f < 10 THEN 'eleve' WHEN f < 50 THEN 'moyen' ELSE 'faible' END")
