"""Queries on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.bpe import encode
from murmura.sources.tables import table


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, root, "documents", "doc_id", "text"), {"doc_id": F.col("doc_id")}, "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict = {}
