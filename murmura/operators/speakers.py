"""Speech attributed to speakers by overlap of intervals, and times mapped between gated and original clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import utrim

#: Width of the time buckets that make an interval join an equality join.
BUCKET_MS = 60_000
#: Intervals over more buckets than this meet by range instead of one row a bucket.
MOST_BUCKETS = 64


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the intersection of two intervals, 0 if there is none."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def _bucketed(df: DataFrame, s: str, e: str) -> DataFrame:
    lo, hi = F.expr(f"{s} div {BUCKET_MS}"), F.expr(f"({e} - 1) div {BUCKET_MS}")
    return df.withColumn("bucket", F.explode(F.sequence(lo, hi)))


def speaker_overlaps(items: DataFrame, spans: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, speaker, total) of items (meeting_id, start_ms, end_ms) and the spans they overlap.

    Both sides go to the minute buckets they touch, so the join is on (meeting, bucket), and each pair counts only the
    part of its overlap in the bucket. Very long intervals are first cut into parts of ``MOST_BUCKETS`` buckets.
    """
    cut_long = lambda d: (
        d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(end_ms - 1 - start_ms) div {BUCKET_MS * MOST_BUCKETS}"))))
        .withColumn("s", F.expr(f"start_ms + part * {BUCKET_MS * MOST_BUCKETS}"))
        .withColumn("e", F.expr(f"least(end_ms, start_ms + (part + 1) * {BUCKET_MS * MOST_BUCKETS})"))
        .drop("part")
    )
    good = lambda d: d.filter("start_ms IS NOT NULL AND end_ms > start_ms AND meeting_id IS NOT NULL")
    a = _bucketed(cut_long(good(items).select(*ids, "meeting_id", "start_ms", "end_ms") if "meeting_id" not in ids else good(items).select(*ids, "start_ms", "end_ms")), "s", "e").select(*ids, *([] if "meeting_id" in ids else ["meeting_id"]), "s", "e", "bucket")
    b = _bucketed(cut_long(good(spans).filter("speaker IS NOT NULL").select("meeting_id", F.col("speaker").cast("bigint").alias("speaker"), "start_ms", "end_ms")), "s", "e")
    b = b.select(F.col("meeting_id").alias("m2"), "speaker", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("bucket").alias("b2"))
    inside = lambda s, e: (F.greatest(F.col(s), F.col("bucket") * BUCKET_MS), F.least(F.col(e), (F.col("bucket") + 1) * BUCKET_MS))
    pair = a.join(b, (F.col("meeting_id") == F.col("m2")) & (F.col("bucket") == F.col("b2")))
    pair = pair.withColumn("ms", overlap(*inside("s", "e"), *inside("s2", "e2"))).filter("ms > 0")
    return pair.groupBy(*ids, "speaker").agg(F.sum("ms").alias("total"))


def majority_speaker(items: DataFrame, spans: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, speaker): the speaker with the largest total overlap, ties to the higher id; items without overlap are not there."""
    return speaker_overlaps(items, spans, ids).groupBy(*ids).agg(F.max_by("speaker", F.struct("total", "speaker")).alias("speaker"))


def assign_speakers(items: DataFrame, spans: DataFrame, ids: list[str]) -> DataFrame:
    """``items`` with the majority speaker, or their own where there is none."""
    best = majority_speaker(items, spans, ids).withColumnRenamed("speaker", "__best").select(*[F.col(i).alias(f"__{i}") for i in ids], "__best")
    on = [F.col(i).eqNullSafe(F.col(f"__{i}")) for i in ids]
    return items.join(best, on, "left").withColumn("speaker", F.coalesce("__best", F.col("speaker").cast("bigint"))).drop("__best", *[f"__{i}" for i in ids])


def split_by_speaker(segments: DataFrame, spans: DataFrame, seg: str = "id") -> DataFrame:
    """(meeting_id, seg, part, start_ms, end_ms, speaker, text): segments cut where the speaker of their words changes.

    Each word takes its majority speaker (or none); runs of equal speakers become parts. A segment of one run stays
    whole, with its own speaker if the run has none; segments without words take their own majority.
    """
    words = segments.filter(F.size("words") > 0).select("meeting_id", F.col(seg).alias("seg"), F.col("speaker").cast("bigint").alias("own"), F.posexplode("words").alias("pos", "w"))
    words = words.select("meeting_id", "seg", "own", "pos", F.col("w.text").alias("text"), F.col("w.start_ms").alias("start_ms"), F.col("w.end_ms").alias("end_ms"))
    best = majority_speaker(words, spans, ["meeting_id", "seg", "pos"])
    d = words.join(best, ["meeting_id", "seg", "pos"], "left")
    w = Window.partitionBy("meeting_id", "seg").orderBy("pos")
    change = (F.lag("pos").over(w).isNotNull() & ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).cast("int")
    d = d.withColumn("change", change).withColumn("part", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("parts", F.max("part").over(Window.partitionBy("meeting_id", "seg")))
    runs = d.groupBy("meeting_id", "seg", "part").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.first("speaker").alias("speaker"),
        F.first("own").alias("own"),
        F.max("parts").alias("parts"),
        utrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "")).alias("text"),
    )
    whole = segments.select("meeting_id", F.col(seg).alias("seg"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("text").alias("t"))
    runs = runs.join(whole, ["meeting_id", "seg"]).select(
        "meeting_id", "seg", "part",
        F.when(F.col("parts") == 0, F.col("s")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(F.col("parts") == 0, F.col("e")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(F.col("parts") == 0, F.coalesce("speaker", "own")).otherwise(F.col("speaker")).alias("speaker"),
        F.when(F.col("parts") == 0, F.col("t")).otherwise(F.col("text")).alias("text"),
    )
    plain = segments.filter(F.col("words").isNull() | (F.size("words") == 0)).select("meeting_id", F.col(seg).alias("seg"), "start_ms", "end_ms", F.col("speaker").cast("bigint").alias("speaker"), "text")
    plain = assign_speakers(plain, spans, ["meeting_id", "seg"]).select("meeting_id", "seg", F.lit(0).cast("bigint").alias("part"), "start_ms", "end_ms", "speaker", "text")
    return runs.unionByName(plain)


def several_sources(segments: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, several): whether a key's segments come from more than one source."""
    return segments.groupBy(key).agg((F.countDistinct("source") > 1).alias("several"))


def gate_map(utterances: DataFrame, key: str, order: str) -> DataFrame:
    """(key, compressed_ms, original_ms, duration_ms): where each utterance begins once the pauses are left out.

    Utterances (key, order, start_ms, duration_ms) of no duration are left out.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = utterances.filter("duration_ms > 0")
    return d.select(key, F.coalesce(F.sum("duration_ms").over(w), F.lit(0)).alias("compressed_ms"), F.col("start_ms").alias("original_ms"), "duration_ms")


def to_original(points: DataFrame, gates: DataFrame, key: str, at: str, at_end: bool = False) -> DataFrame:
    """``points`` with ``original_ms``: the time ``at`` on the clock without pauses, mapped back.

    A start takes the last utterance that begins at or before it, an end the last that begins before it, else the
    first; offsets stop at the utterance's duration. Keys without utterances keep their times, and null times stay null.
    The as-of lookup is one window over points and utterances together; rows pass it whole, so none needs a number.
    """
    kind = "struct<c:bigint,o:bigint,d:bigint>"
    gate = gates.select(F.col(key).alias("k"), F.struct(F.col("compressed_ms").cast("bigint").alias("c"), F.col("original_ms").cast("bigint").alias("o"), F.col("duration_ms").cast("bigint").alias("d")).alias("g"))
    row = F.struct(*[F.col(c) for c in points.columns])
    side = points.select(F.col(key).alias("k"), F.col(at).cast("bigint").alias("t"), F.lit(1 if not at_end else -1).alias("turn"), row.alias("row"), F.lit(None).cast(kind).alias("g"))
    mark = gate.select("k", F.col("g.c").alias("t"), F.lit(0).alias("turn"), F.lit(None).cast(side.schema["row"].dataType).alias("row"), "g")
    w = Window.partitionBy("k").orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0)
    both = side.unionByName(mark).withColumn("last", F.last("g", ignorenulls=True).over(w)).filter("row IS NOT NULL")
    first = gate.groupBy("k").agg(F.min(F.struct("g.c", "g.o", "g.d")).alias("first"))
    found = both.join(first.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left")
    g = F.coalesce("last", "first")
    original = F.when(g.isNull(), F.col("t")).when(F.col("t").isNotNull(), g.o + F.least(F.greatest(F.col("t") - g.c, F.lit(0)), g.d))
    return found.select("row.*", original.alias("original_ms"))


def remap_segments(segments: DataFrame, gates: DataFrame, key: str) -> DataFrame:
    """``segments`` (start_ms, end_ms, words) with all their times mapped back by the utterances of their key.

    The utterances of a key go into one row as an array, so a key is a clip whose utterances fit a row.
    """
    each = F.struct(F.col("compressed_ms").cast("bigint").alias("compressed_ms"), F.col("original_ms").cast("bigint").alias("original_ms"), F.col("duration_ms").cast("bigint").alias("duration_ms"))
    by = gates.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(each)).alias("__gates"))
    d = segments.join(by, F.col(key).eqNullSafe(F.col("__k")), "left")
    g = F.col("__gates")
    word = lambda w: F.struct(w.text.alias("text"), map_array(w.start_ms, g).alias("start_ms"), map_array(w.end_ms, g, True).alias("end_ms"))
    d = d.withColumn("start_ms", map_array(F.col("start_ms"), g)).withColumn("end_ms", map_array(F.col("end_ms"), g, True))
    return d.withColumn("words", F.transform("words", word)).drop("__k", "__gates")


def renumbered(parts: DataFrame, key: str, order: list[str], name: str = "id") -> DataFrame:
    """``parts`` numbered from 0 per key in ``order``, as ``name``: a cut segment is several rows, each with an id of its own."""
    return parts.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint"))


def map_array(t: Column, gates: Column, at_end: bool = False) -> Column:
    """:func:`to_original` on an array of (compressed_ms, original_ms, duration_ms) that fits a row."""
    ok = lambda g: g.compressed_ms < t if at_end else g.compressed_ms <= t
    fits = F.filter(gates, ok)
    g = F.when(F.size(fits) > 0, F.element_at(fits, -1)).otherwise(F.get(gates, F.lit(0)))
    return F.when(gates.isNull() | (F.size(gates) == 0), t).when(t.isNotNull(), g.original_ms + F.least(F.greatest(t - g.compressed_ms, F.lit(0)), g.duration_ms))
