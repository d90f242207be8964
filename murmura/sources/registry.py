"""Small files beside the tables: JSON registries, the search mode, and model files with their checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("fulltext", "semantic", "hybrid")


def read_registry(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The entries of a JSON array file; a missing or unreadable file has none, fields of another kind are null."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.ArrayType(schema), {"mode": "PERMISSIVE"})).alias("x")).filter("x IS NOT NULL").select("x.*")


def write_registry(entries: DataFrame, path: str) -> None:
    """Writes a small table as one JSON array to a file; it appears whole."""
    spark = entries.sparkSession
    body = entries.agg(F.to_json(F.collect_list(F.struct(*entries.columns)))).first()[0]
    to, fresh = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.next"))
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(body.encode()))
    out.close()
    fs.delete(to, False)
    fs.rename(fresh, to)


def with_custom(catalog: DataFrame, custom: DataFrame, key: str = "id") -> DataFrame:
    """A catalog and the entries of one's own whose key it does not have."""
    return catalog.unionByName(custom.join(catalog.select(key), key, "left_anti").select(*[c for c in catalog.columns if c in custom.columns]), allowMissingColumns=True)


def installed(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """(id, installed): whether all files of a model, an array of structs with ``name``, are among ``files`` (id, name)."""
    want = catalog.select("id", F.explode_outer("files").alias("f")).select("id", F.col("f.name").alias("name"))
    have = files.select("id", "name").distinct().withColumn("there", F.lit(True))
    return want.join(have, ["id", "name"], "left").groupBy("id").agg(F.coalesce(F.every(F.col("name").isNull() | F.coalesce("there", F.lit(False))), F.lit(True)).alias("installed"))


def search_mode(stored: str | None) -> str:
    """The mode in a settings file: fulltext where it is missing or unknown."""
    mode = (stored or "").strip()
    return mode if mode in MODES else "fulltext"


def set_search_mode(mode: str) -> str:
    """The mode to store; an unknown one is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown search mode: {mode}")
    return mode


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files below ``path``, in lower-case hexadecimal; a file is a row of at most 2 GB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, ok) of every expected file (name, sha256): whether it is there with that checksum, in any case of letters."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lower("sha256").alias("is"))
    return expected.join(have, "name", "left").groupBy("name").agg(F.coalesce(F.bool_or(F.col("is") == F.lower("sha256")), F.lit(False)).alias("ok"))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
