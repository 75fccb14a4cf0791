"""Redaction of a stream of files: the batch transformation, unchanged, as every step is within a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import DEFAULT, Detector
from ..operators.pseudonymize import redact, safe_columns


def redacted_stream(docs: DataFrame, *, text_col: str = "text", detectors: tuple[Detector, ...] = DEFAULT) -> DataFrame:
    """A streaming (or batch) frame with masked texts and places of entities, without texts, values and mappings."""
    return safe_columns(redact(docs, text_col=text_col, detectors=detectors))


def redact_folder(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *, detectors: tuple[Detector, ...] = DEFAULT) -> StreamingQuery:
    """Redacts all Parquet files now in `source`, and on the next call those that came since, exactly once each."""
    docs = spark.readStream.schema(schema).parquet(source)
    return redacted_stream(docs, detectors=detectors).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
