"""Queries on oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.split import split_oversized
from murmura.sources.tables import table


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of every oversized chunk and segment."""
    rows = table(spark, root, "chunk", "id", "text").withColumn("origin", F.lit("chunk"))
    rows = rows.unionByName(table(spark, root, "segment", "id", "text").withColumn("origin", F.lit("segment")))
    return split_oversized(rows, {"origin": F.col("origin"), "item_id": F.col("id")}, "text")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Oversized items, and whether they had to be cut inside a stretch without boundaries."""
    return p2_pieces(spark, root).filter("piece = 0").select("origin", "item_id", "cut")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}

SQL = {
    "p2_found": r"""
WITH t AS (SELECT 'chunk' AS origin, id AS item_id, text FROM chunk UNION ALL SELECT 'segment', id, text FROM segment),
u AS (SELECT origin, item_id, regexp_replace(text, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '', 'g') AS text FROM t)
SELECT origin, item_id, CASE WHEN regexp_matches(text, '[^\s\p{Z}\x0b\x1c-\x1f\x{85}.,;:!?…。！？；：，、．।؟،؛]{513}') THEN 'forced' ELSE 'natural' END AS cut
FROM u WHERE length(text) > 512"""
}
