"""Queries on coverage of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmura.operators.coverage import coverage
from murmura.sources.tables import table

#: A longer pause parts two sittings.
SITTING_MS = 1_800_000


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Continuous speech per meeting and the gaps below half an hour."""
    return coverage(table(spark, root, "segment", "meeting_id", "start_ms", "end_ms"), "meeting_id", "start_ms", "end_ms", SITTING_MS)


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": """
WITH r AS (SELECT meeting_id, start_ms s, end_ms e FROM segment WHERE meeting_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms),
m AS (SELECT *, max(e) OVER (PARTITION BY meeting_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM m),
p AS (SELECT meeting_id, min(s) AS start_ms, max(e) AS end_ms FROM n GROUP BY meeting_id, isle),
g AS (SELECT meeting_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms) AS end_ms FROM p)
SELECT meeting_id, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL SELECT meeting_id, 'gap', start_ms, end_ms FROM g WHERE end_ms - start_ms < 1800000"""
}
