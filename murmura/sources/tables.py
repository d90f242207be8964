"""Table access: one Parquet dataset per table below a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns) -> DataFrame:
    """``root/name.parquet`` (a file or a directory), pruned to ``columns``."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
