"""Queries on sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.sentences import sentences
from murmura.sources.tables import table


def p9_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Every sentence of every document with its text."""
    return sentences(table(spark, root, "documents", "doc_id", "text"), {"doc_id": F.col("doc_id")}, "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Spans of the sentences."""
    return p9_sentences(spark, root).select("doc_id", "start_char", "end_char")


QUERIES = {"p9_found": p9_found, "p9_sentences": p9_sentences}
SQL: dict = {}
