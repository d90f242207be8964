"""Trigram postings beside the texts, so that a full-text query reads those of its own trigrams and not all texts.

``build`` writes two tables below a folder: postings (bucket, trigram, id), sorted by trigram in files of a bucket, and
rows (bucket, id, ...) with their lengths. A trigram of a third of all rows is spread over several files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators.search import occurrences, query_tokens

#: Buckets of both tables, and files into which the postings of a bucket are spread.
BUCKETS, SPREAD = 64, 4


def trigrams(low: Column) -> Column:
    """Distinct trigrams of a lower-case text, in time linear in its length."""
    chars = F.split(low, "")
    whole = F.zip_with(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), F.slice(chars, 3, F.greatest(F.size(chars) - 2, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(whole, lambda t: t.isNotNull()))


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def build(segments: DataFrame, path: str) -> None:
    """Writes the index of rows (meeting_id, idx, text); null texts are in no row. Equal rows are one with a count."""
    rows = segments.filter(F.col("text").isNotNull()).groupBy("meeting_id", "idx", "text").agg(F.count("*").alias("n"))
    rows = rows.select(F.xxhash64("meeting_id", "idx", "text").alias("id"), "meeting_id", "idx", "text", "n", F.greatest(F.char_length("text") - 2, F.lit(0)).alias("tri"))
    rows.withColumn("bucket", _bucket(F.col("id"))).repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    spark = segments.sparkSession
    kept = spark.read.parquet(f"{path}/rows").select("id", F.explode(trigrams(F.lower("text"))).alias("trigram")).withColumn("bucket", _bucket(F.col("trigram")))
    kept.repartition(BUCKETS, "bucket", F.pmod("id", F.lit(SPREAD))).sortWithinPartitions("bucket", "trigram", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def bm25(spark: SparkSession, path: str, query: str) -> DataFrame:
    """As :func:`murmura.operators.search.bm25` of the indexed rows: (meeting_id, idx, text, score); no token, no rows.

    Tokens have three characters or more. Postings of the tokens' trigrams are read by bucket and trigram; texts are
    read of the rows that have all trigrams of a token, to see which of them hold it. Statistics need lengths only.
    """
    tokens = [t.lower() for t in query_tokens(query)]
    if any(len(t) < 3 for t in tokens):
        raise ValueError("tokens of an indexed query have three characters or more")
    rows = spark.read.parquet(f"{path}/rows")
    if not tokens:
        return rows.limit(0).select("meeting_id", "idx", "text", F.lit(0.0).alias("score"))
    parts = [sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in tokens]
    wanted = sorted({p for ps in parts for p in ps})
    buckets = [r.b for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(_bucket(F.col("w")).alias("b")).distinct().collect()]
    found = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(wanted))
    may = found.groupBy("id").agg(*[(F.count_if(F.col("trigram").isin(p)) == len(p)).alias(f"m{i}") for i, p in enumerate(parts)])
    may = may.filter(" OR ".join(f"m{i}" for i in range(len(tokens)))).withColumn("bucket", _bucket(F.col("id")))
    d = rows.join(may, ["bucket", "id"]).withColumn("low", F.lower("text"))
    holds = [F.col(f"m{i}") & F.col("low").contains(t) for i, t in enumerate(tokens)]
    counts = d.agg(*[F.coalesce(F.sum(F.when(h, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, h in enumerate(holds)]).first()
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("tri")), F.lit(0)).alias("tri")).first()
    mean, score = (size.tri / size.n if size.n else 0.0), F.lit(0.0)
    for i, t in enumerate(tokens):
        d = d.filter(holds[i])
        idf = math.log((size.n - counts[f"c{i}"] + 0.5) / (counts[f"c{i}"] + 0.5))
        f = occurrences(F.col("low"), t).cast("double")
        score = score + (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("tri") / (mean or 1.0)))
    each = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return each.select("meeting_id", "idx", "text", (-score).alias("score"))
