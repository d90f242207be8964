"""Queries on languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.language import address_suffixes, fuse, language_stretches, mixed, train
from murmura.session import cut
from murmura.sources.tables import table


def _found(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(stretches of all segments, languages of all meetings)."""
    seg = table(spark, root, "segment", "id", "meeting_id", "text")
    met = table(spark, root, "meeting", "id", "language", "engine", "title", "summary")
    model = train(seg, "text")
    found = cut(language_stretches(seg, {"id": F.col("id"), "meeting_id": F.col("meeting_id")}, "text", model))
    # title and summary speak only where no segment does
    told = met.select(F.col("id").alias("meeting_id"), F.concat_ws("\n", "title", "summary").alias("t"))
    own = told.join(found.filter("nats IS NOT NULL").select("meeting_id").distinct(), "meeting_id", "left_anti")
    pieces = found.select("meeting_id", "nats").unionByName(language_stretches(own, {"meeting_id": F.col("meeting_id")}, "t", model).select("meeting_id", "nats"))
    suffixes = address_suffixes(seg.select("meeting_id", F.col("text").alias("t")).unionByName(told), "meeting_id", "t")
    docs = met.withColumnRenamed("id", "meeting_id").join(suffixes, "meeting_id", "left")
    langs = fuse(pieces, docs, "meeting_id", declared="language", suffix="suffix", host="engine")
    return found, langs


def p4_meetings(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of every meeting."""
    return _found(spark, root)[1]


def p4_stretches(spark: SparkSession, root: str) -> DataFrame:
    """Stretches of one language of every mixed segment."""
    found, _ = _found(spark, root)
    ids = mixed(found, ["id"]).select("id").distinct()
    return found.filter("sentence").join(ids, "id").select("id", "lang", "start_char", "end_char", "confidence")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Meetings with a missing or wrong label, and the languages of mixed segments."""
    found, langs = _found(spark, root)
    wrong = langs.filter(F.col("declared_code").isNull() | (F.col("declared_code") != F.col("lang")))
    wrong = wrong.select(F.lit("meeting").alias("item_kind"), F.col("meeting_id").alias("item_key"), "lang")
    mix = mixed(found, ["id"]).select(F.lit("segment").alias("item_kind"), F.col("id").cast("string").alias("item_key"), "lang")
    return wrong.unionByName(mix)


QUERIES = {"p4_found": p4_found, "p4_meetings": p4_meetings, "p4_stretches": p4_stretches}
SQL: dict = {}
