"""The note store: meetings, segments and chunks as versioned Parquet tables with replace-by-key writes.

A write makes a new version directory and then adds a numbered pointer file, so readers see whole versions and a failed
write leaves the old one. One writer at a time. The tables of the last few pointers stay for readers that began earlier.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.text import is_blank, source_label, truncate_chars, utrim
from murmura.operators.shape import chunk_texts

MEETING = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("title", T.StringType()), ("started_at_ms", T.LongType()), ("duration_ms", T.LongType()), ("language", T.StringType()), ("engine", T.StringType()), ("summary", T.StringType()), ("segment_count", T.LongType()))])
SEGMENT = T.StructType([T.StructField(n, t) for n, t in (("meeting_id", T.StringType()), ("idx", T.LongType()), ("start_ms", T.LongType()), ("end_ms", T.LongType()), ("speaker", T.LongType()), ("source", T.StringType()), ("text", T.StringType()))])
CHUNK = T.StructType([T.StructField("meeting_id", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: Pointers, with their tables, that are kept behind the last.
KEEP = 3
#: Tables by the schema version that added them.
VERSIONS = [{"meeting": MEETING, "segment": SEGMENT}, {"chunk": CHUNK}]


def saved_segments(live: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows of captured ones: final and not blank, text trimmed, numbered from 0 per meeting in ``order``."""
    kept = live.filter((F.col("status") == "Final") & ~is_blank(F.col("text")))
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy(*order)) - 1
    return kept.select("meeting_id", place.cast("bigint").alias("idx"), "start_ms", "end_ms", F.col("speaker").cast("bigint").alias("speaker"), source_label(F.col("source")).alias("source"), utrim(F.col("text")).alias("text"))


def saved_meetings(meta: DataFrame, segments: DataFrame) -> DataFrame:
    """Meetings with duration (latest end, else 0), number of segments and a default title; those without segments too."""
    rolled = segments.groupBy("meeting_id").agg(F.max("end_ms").alias("d"), F.count("*").alias("n"))
    m = meta.join(rolled, meta["id"] == rolled["meeting_id"], "left")
    title = F.coalesce(F.nullif(utrim(F.col("title")), F.lit("")), F.lit("Untitled meeting"))
    return m.select("id", title.alias("title"), "started_at_ms", F.coalesce("d", F.lit(0)).alias("duration_ms"), "language", "engine", "summary", F.coalesce("n", F.lit(0)).alias("segment_count"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``new`` and those rows of ``old`` whose key is not among ``ids`` (one column)."""
    return old.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def list_notes(meetings: DataFrame, segments: DataFrame, first: int = 6, chars: int = 160) -> DataFrame:
    """Meetings, latest first, with a preview: the first segments' texts joined by spaces and cut."""
    # the smallest idx per meeting by a bounded window; only these rows are gathered
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("idx", "start_ms", "text"))
    top = segments.select("meeting_id", "idx", "start_ms", "text").withColumn("n", n).filter(F.col("n") <= first)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x.text), " ")
    seen = top.groupBy("meeting_id").agg(text.alias("preview"))
    m = meetings.join(seen, meetings["id"] == seen["meeting_id"], "left").drop("meeting_id")
    return m.withColumn("preview", truncate_chars(F.coalesce("preview", F.lit("")), chars)).orderBy(F.desc("started_at_ms"), "id")


def note_detail(meetings: DataFrame, segments: DataFrame, note: str) -> DataFrame:
    """One row per segment of a meeting, in order, with the meeting's columns; no rows for a meeting that is not there."""
    m = meetings.filter(F.col("id") == note).select("id", "title", "started_at_ms")
    s = segments.filter(F.col("meeting_id") == note).select(F.col("meeting_id").alias("m"), "idx", "start_ms", "end_ms", "speaker", "source", "text")
    return m.join(s, m["id"] == s["m"], "left").drop("m").orderBy("idx", "start_ms")


def segment_dto(live: DataFrame) -> DataFrame:
    """Rows as the interface takes them: times in milliseconds, finality as a flag."""
    names = F.create_map(*[F.lit(x) for x in ("mic", "Microphone", "system", "System", "file", "File")])
    return live.select("meeting_id", "seq", "id", "text", "start_ms", "end_ms", (F.col("status") == "Final").alias("is_final"), F.coalesce(names[source_label(F.col("source"))], F.lit("Unknown")).alias("source"), "speaker", "aux_text")


#: The column of each table that names its meeting.
KEYS = {"meeting": "id", "segment": "meeting_id", "chunk": "meeting_id"}


def without_note(tables: dict[str, DataFrame], note: str) -> dict[str, DataFrame]:
    """The tables without a meeting, its segments and chunks; rows of no meeting stay."""
    return {n: d.filter(~F.col(KEYS[n]).eqNullSafe(note)) for n, d in tables.items()}


def notes(meetings: DataFrame) -> DataFrame:
    """All meetings with their columns, the latest first, ties by id."""
    return meetings.select(*MEETING.names).orderBy(F.desc("started_at_ms"), "id")


class NoteStore:
    """Meetings, segments and chunks below a directory."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame, str], DataFrame] | None = None):
        self.spark, self.root, self.embed = spark, root.rstrip("/"), embed
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.migrate()

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _pointers(self) -> list[int]:
        """Numbers of the whole pointer files, ascending."""
        if not self._fs.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path())]
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-") and n.removeprefix("current-").isdigit())

    def _pointer(self) -> dict[str, str]:
        numbers = self._pointers()
        if not numbers:
            return {}
        rows = self.spark.read.text(f"{self.root}/current-{numbers[-1]:012d}").collect()
        return dict(r.value.split("\t") for r in rows if r.value)

    def _commit(self, pointer: dict[str, str]) -> None:
        """Adds a pointer file with the next number, whole from the moment of its rename; the highest number holds.

        No pointer is deleted before a higher one is there, so a crash at any point leaves the tables as they were or as
        they become. Of another writer's equal number one rename fails.
        """
        numbers = self._pointers()
        fresh, to = self._path(f"_next-{uuid.uuid4().hex}"), self._path(f"current-{(numbers[-1] if numbers else 0) + 1:012d}")
        out = self._fs.create(fresh, True)
        out.write(bytearray("".join(f"{k}\t{v}\n" for k, v in sorted(pointer.items())).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(fresh, to):
            self._fs.delete(fresh, False)
            raise RuntimeError("another writer committed first")
        for n in numbers[:-KEEP]:
            self._drop(n)

    def _drop(self, number: int) -> None:
        """Removes an old pointer, and its tables that no later pointer names."""
        read = lambda n: dict(r.value.split("\t") for r in self.spark.read.text(f"{self.root}/current-{n:012d}").collect() if r.value)
        later = {v for n in self._pointers() if n > number for v in read(n).values()}
        gone = [v for v in read(number).values() if v not in later]
        self._fs.delete(self._path(f"current-{number:012d}"), False)
        for v in gone:
            self._fs.delete(self._path(v), True)

    def _write(self, **tables: DataFrame) -> None:
        pointer = self._pointer()
        for name, df in tables.items():
            at = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{at}")
            pointer[name] = at
        self._commit(pointer)

    def migrate(self) -> None:
        """Adds the tables of newer schema versions; nothing is lost, and a second call does nothing."""
        have = self._pointer()
        if not have and self._fs.exists(self._path()) and any(f.isDirectory() and f.getPath().getName().split("-")[0] in {n for v in VERSIONS for n in v} for f in self._fs.listStatus(self._path())):
            raise RuntimeError(f"{self.root} has tables but no pointer file; restore one rather than starting empty")
        new = {n: s for v in VERSIONS for n, s in v.items() if n not in have}
        if new:
            self._write(**{n: self.spark.createDataFrame([], s) for n, s in new.items()})

    def table(self, name: str) -> DataFrame:
        """A table's current version."""
        return self.spark.read.parquet(f"{self.root}/{self._pointer()[name]}")

    def save(self, meta: DataFrame, live: DataFrame, order: list[str] | None = None) -> None:
        """Writes notes whole: each id's meeting, segments and (with an embedder) chunks replace what was stored."""
        seg = saved_segments(live, order or ["start_ms", "seq"])
        met = saved_meetings(meta, seg)
        ids = meta.select("id")
        out = {"meeting": replace_by_key(self.table("meeting"), met, "id", ids), "segment": replace_by_key(self.table("segment"), seg, "meeting_id", ids)}
        chunks = self._chunks(seg) if self.embed else self.spark.createDataFrame([], CHUNK)
        out["chunk"] = replace_by_key(self.table("chunk"), chunks, "meeting_id", ids)
        self._write(**out)

    def delete(self, note: str) -> bool:
        """Deletes a meeting with its segments and chunks; whether it was there."""
        there = not self.table("meeting").filter(F.col("id") == note).isEmpty()
        if there:
            self._write(**without_note({n: self.table(n) for n in KEYS}, note))
        return there

    def count(self) -> int:
        """Number of meetings."""
        return self.table("meeting").count()

    def _chunks(self, seg: DataFrame) -> DataFrame:
        return self.embed(chunk_texts(seg, "meeting_id", "idx", "text").withColumnRenamed("chunk", "idx"), "text").select(*CHUNK.names)

    def reindex(self) -> int:
        """Chunks and embeds every note anew and swaps all at once; the number of notes with chunks. Without an embedder all chunks go."""
        if self.embed is None:
            self._write(chunk=self.spark.createDataFrame([], CHUNK))
            return 0
        self._write(chunk=self._chunks(self.table("segment")))
        return self.table("chunk").select("meeting_id").distinct().count()

    def set_embedder(self, embed: Callable[[DataFrame, str], DataFrame] | None, reindex: bool = True) -> int:
        """Changes the embedder; if re-indexing fails, the former one and its chunks stay."""
        before, self.embed = self.embed, embed
        if not reindex:
            return 0
        try:
            return self.reindex()
        except Exception:
            self.embed = before
            raise
