"""Queries on personal information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.pii import find_pii, redact_pii
from murmura.sources.tables import table


def _rows(spark: SparkSession, root: str) -> DataFrame:
    seg = table(spark, root, "segment", "id", "text").select(F.lit("segment").alias("origin"), F.col("id").cast("string").alias("item_key"), "text")
    met = table(spark, root, "meeting", "id", "summary").select(F.lit("meeting").alias("origin"), F.col("id").cast("string").alias("item_key"), F.col("summary").alias("text"))
    return seg.unionByName(met)


_KEYS = {"origin": F.col, "item_key": F.col}


def p6_values(spark: SparkSession, root: str) -> DataFrame:
    """Every value with its span."""
    return find_pii(_rows(spark, root), {k: f(k) for k, f in _KEYS.items()}, "text", table(spark, root, "participant", "display_name"), "display_name")


def p6_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every text with placeholders."""
    return redact_pii(_rows(spark, root), {k: f(k) for k, f in _KEYS.items()}, "text", table(spark, root, "participant", "display_name"), "display_name")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Type and first character of every value."""
    return p6_values(spark, root).select("origin", "item_key", "pii_type", "start_char")


QUERIES = {"p6_found": p6_found, "p6_values": p6_values, "p6_redacted": p6_redacted}
SQL: dict = {}
