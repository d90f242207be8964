"""Session helpers: the shared checkpoint folder and stages written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where unset (tests, local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("murmura.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        where = tempfile.mkdtemp(prefix="murmura-")
        spark.conf.set("murmura.checkpoint.dir", where)
    return where


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, removed when the process ends."""
    path = f"{checkpoint_dir(spark)}/murmura/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; lineage ends there, so a lost executor costs only a read.

    A table is written rather than ``checkpoint()`` called, which computes the last stage twice.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a plain scan has fewer partitions than there are (a few unsplittable small files).

    Larger inputs have more partitions than cores and pass as they are, without a shuffle.
    """
    spark = df.sparkSession
    query = df._jdf.queryExecution()
    if "Exchange" in query.executedPlan().toString():
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < query.toRdd().getNumPartitions() < cores else df
