"""Queries on similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.neighbours import nearest
from murmura.sources.tables import table


def p5_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Of every chunk the 5 most similar other chunks."""
    return nearest(table(spark, root, "chunk", "id", "embedding"), "id", "embedding")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of chunks of which one is among the 5 most similar of the other, of cosine 0.85 or more."""
    near = nearest(table(spark, root, "chunk", "id", "embedding"), "id", "embedding", least=0.85)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL: dict = {}
