"""Coverage periods and gaps of intervals per entity, in two levels.

Level one clips each interval to the time shards at its two ends and merges within (entity, shard); the stretch of
whole shards between the ends becomes two counter events, so that an interval over a million shards still costs four
rows. Level two sees one summary row per (entity, shard): it stitches what touches a shard's bounds, coalesces across
whole shards, and finds gaps between neighbouring shards. No task ever holds all rows of one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.session import cut

SHARD_MS = 3_600_000
#: Times are clamped to this, so that the end of the last shard is still a BIGINT.
FAR_MS = 9_200_000_000_000_000_000


def _shard(t: str, shard_ms: int) -> Column:
    """Floor of ``t / shard_ms`` in integers (a double loses digits beyond 2**53)."""
    return F.expr(f"(({t}) - pmod({t}, {shard_ms}L)) div {shard_ms}L")


def _clips(df: DataFrame, shard_ms: int) -> DataFrame:
    """(entity, shard, s, e, delta): clipped ends with null delta, and counter events of whole shards with null s."""
    d = df.withColumn("lo", _shard("s", shard_ms)).withColumn("hi", _shard("e - 1", shard_ms))
    null = F.lit(None).cast("bigint")
    w = F.lit(shard_ms).cast("bigint")
    row = lambda sh, s, e, n: F.struct(sh.alias("shard"), s.alias("s"), e.alias("e"), n.alias("delta"))
    one = F.array(row(F.col("lo"), F.col("s"), F.col("e"), null))
    two = F.array(row(F.col("lo"), F.col("s"), (F.col("lo") + 1) * w, null), row(F.col("hi"), F.col("hi") * w, F.col("e"), null))
    many = F.array(
        row(F.col("lo"), F.col("s"), (F.col("lo") + 1) * w, null),
        row(F.col("hi"), F.col("hi") * w, F.col("e"), null),
        row(F.col("lo") + 1, null, null, F.lit(1).cast("bigint")),
        row(F.col("hi"), null, null, F.lit(-1).cast("bigint")),
    )
    return d.select("entity", F.inline(F.when(F.col("lo") == F.col("hi"), one).when(F.col("lo") + 1 == F.col("hi"), two).otherwise(many)))


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching (s, e) per ``keys``."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    seen = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.sum(F.when(seen.isNull() | (F.col("s") > seen), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("isle", starts).groupBy(*keys, "isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("isle")


def periods(df: DataFrame, entity: str, start: str, end: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """Maximal continuous periods ``(entity, start, end)`` of the intervals of ``df``.

    Rows whose entity, start or end is null, or whose end is not after the start, count as no interval. Overlapping,
    nested, repeated and touching intervals merge. An empty table gives no rows; other columns of ``df`` are ignored,
    whatever their names.
    """
    far = lambda c: F.greatest(F.least(F.col(c).cast("bigint"), F.lit(FAR_MS)), F.lit(-FAR_MS))
    rows = df.filter(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.select(F.col(entity).alias("entity"), far(start).alias("s"), far(end).alias("e")).filter("e > s")
    clips = _clips(rows, shard_ms)
    local = _islands(clips.filter(F.col("delta").isNull()).select("entity", "shard", "s", "e"), ["entity", "shard"])
    w = F.lit(shard_ms).cast("bigint")
    lo, hi = F.col("shard") * w, (F.col("shard") + 1) * w

    # whole shards: one counter row per (entity, shard) where the number of intervals over it changes
    steps = clips.filter(F.col("delta").isNotNull()).groupBy("entity", "shard").agg(F.sum("delta").alias("delta")).filter("delta != 0")
    by_shard = Window.partitionBy("entity").orderBy("shard")
    whole = (
        steps.withColumn("depth", F.sum("delta").over(by_shard.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next", F.lead("shard").over(by_shard))
        .filter("depth > 0")
        .select("entity", (F.col("shard") * w).alias("s"), (F.col("next") * w).alias("e"))
    )
    # islands at a bound, and every island's shard that whole-shard coverage may swallow, go to level two
    first = cut(local.withColumn("edge", (F.col("s") == lo) | (F.col("e") == hi)))
    # an inner island of a wholly covered shard is swallowed: one counter row per (entity, shard) finds those shards
    shards = first.groupBy("entity", "shard").agg(F.lit(0).cast("bigint").alias("delta"), F.lit(1).alias("here"))
    depth = F.sum("delta").over(by_shard.rangeBetween(Window.unboundedPreceding, 0))
    covered = (
        shards.unionByName(steps.withColumn("here", F.lit(0)))
        .withColumn("depth", depth)
        .filter("here = 1 AND depth > 0")
        .select("entity", "shard")
    )
    inner = first.filter(~F.col("edge")).join(covered, ["entity", "shard"], "left_anti").select("entity", "s", "e")
    outer = _islands(first.filter("edge").select("entity", "s", "e").unionByName(whole), ["entity"])
    out = inner.unionByName(outer)
    return out.select(F.col("entity").alias(entity), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def gaps(found: DataFrame, entity: str, max_gap_ms: int | None = None, shard_ms: int = SHARD_MS) -> DataFrame:
    """Stretches between successive periods of :func:`periods`, those of ``max_gap_ms`` or longer left out.

    Starts and ends are points of (entity, shard of the point); within a shard a start follows an end directly, and the
    first start of a shard follows the last end of the entity's shard before, found on one summary row a shard.
    """
    point = F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("opens")), F.struct(F.col("end_ms").alias("t"), F.lit(0).alias("opens"))))
    pts = found.select(F.col(entity).alias("entity"), point.alias("p")).select("entity", "p.t", "p.opens", _shard("p.t", shard_ms).alias("shard"))
    before = Window.partitionBy("entity", "shard").orderBy("t")
    inside = pts.withColumn("prev", F.lag("t").over(before)).filter("opens = 1 AND prev IS NOT NULL").select("entity", F.col("prev").alias("s"), F.col("t").alias("e"))
    ends = pts.groupBy("entity", "shard").agg(F.min(F.struct("t", "opens")).alias("a"), F.max("t").alias("z"))
    across = (
        ends.withColumn("prev", F.lag("z").over(Window.partitionBy("entity").orderBy("shard")))
        .filter("a.opens = 1 AND prev IS NOT NULL")
        .select("entity", F.col("prev").alias("s"), F.col("a.t").alias("e"))
    )
    out = inside.unionByName(across)
    if max_gap_ms is not None:
        out = out.filter(F.col("e") - F.col("s") < max_gap_ms)
    return out.select(F.col("entity").alias(entity), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def coverage(df: DataFrame, entity: str, start: str, end: str, max_gap_ms: int | None = None, shard_ms: int = SHARD_MS) -> DataFrame:
    """``(entity, kind 'period'/'gap', start_ms, end_ms)`` of :func:`periods` and :func:`gaps`."""
    p = cut(periods(df, entity, start, end, shard_ms))
    kind = lambda d, k: d.select(entity, F.lit(k).alias("kind"), "start_ms", "end_ms")
    return kind(p, "period").unionByName(kind(gaps(p, entity, max_gap_ms, shard_ms), "gap"))
