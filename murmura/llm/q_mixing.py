"""Queries on mixes of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmura.llm.mixing import mix, short_rows
from murmura.sources.tables import table


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return (table(spark, root, "documents", "doc_id", "text", "source"), table(spark, root, "mix_target", "mix_id", "source", "weight", "max_repeats"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """Copies of each document in each mix."""
    return mix(*_tables(spark, root))[0]


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual tokens and shares of each source in each mix."""
    return mix(*_tables(spark, root))[1]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the mixes whose fitted rates are at their bound with tokens missing: they cannot reach their share."""
    return short_rows(*_tables(spark, root))


QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict = {}
