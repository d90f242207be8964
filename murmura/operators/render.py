"""Transcripts as text, subtitles and Markdown: lines first, whole documents by ordered joins of few lines per note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import is_blank, meeting_label, short_timestamp, timestamp, utrim, yaml_scalar
from murmura.operators.shape import paragraphs as group

#: Export formats and their file extensions (fixed values).
FORMATS = {"txt": "txt", "text": "txt", "srt": "srt", "vtt": "vtt", "md": "md", "markdown": "md"}


def extension(name: str) -> str | None:
    """The extension of a format by name, in any case; None if unknown."""
    return FORMATS.get(name.strip().lower())


def _document(lines: DataFrame, key: str, order: str, line: str, sep: str, head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """(key, document): a note's lines joined in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), sep)
    parts = [p for p in (head, body, tail) if p is not None]
    return lines.groupBy(key).agg(F.concat(*parts).alias("document"))


def srt_cues(segments: DataFrame, key: str = "meeting_id", order: list[str] | None = None) -> DataFrame:
    """(key, cue, text) of SubRip: cues numbered from 1 over segments that are not blank."""
    kept = segments.filter(~is_blank(F.col("text")))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["start_ms", "idx"])))
    span = F.concat(timestamp(F.col("start_ms"), ","), F.lit(" --> "), timestamp(F.col("end_ms"), ","))
    return kept.withColumn("cue", n).select(key, F.col("cue").cast("bigint").alias("cue"), F.concat(F.col("cue").cast("string"), F.lit("\n"), span, F.lit("\n"), utrim(F.col("text")), F.lit("\n")).alias("text"))


def vtt_body(text: Column, words: Column) -> Column:
    """A cue's text with a time before each word, the first word without leading space; the plain text without words."""
    timed = F.transform(words, lambda w, i: F.concat(F.lit("<"), timestamp(w.start_ms, "."), F.lit(">"), F.when(i == 0, F.ltrim(w.text)).otherwise(w.text)))
    return F.when(words.isNull() | (F.size(words) == 0), utrim(text)).otherwise(F.array_join(timed, ""))


def vtt_cues(segments: DataFrame, key: str = "meeting_id", order: list[str] | None = None) -> DataFrame:
    """(key, cue, text) of WebVTT, words timed where there are any; the header is not a cue."""
    kept = segments.filter(~is_blank(F.col("text")))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["start_ms", "id"])))
    span = F.concat(timestamp(F.col("start_ms"), "."), F.lit(" --> "), timestamp(F.col("end_ms"), "."))
    return kept.withColumn("cue", n.cast("bigint")).select(key, "cue", F.concat(span, F.lit("\n"), vtt_body(F.col("text"), F.col("words")), F.lit("\n")).alias("text"))


def txt(paragraphs: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, document): paragraphs with speaker numbers from 1, blank lines between, a line break at the end."""
    who = F.when(F.col("speaker").isNotNull(), F.concat(F.lit("Speaker "), (F.col("speaker") + 1).cast("string"), F.lit(": "))).otherwise("")
    return _document(paragraphs.withColumn("line", F.concat(who, "text")), key, "paragraph", "line", "\n\n", tail=F.lit("\n"))


def markdown_lines(paragraphs: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, paragraph, line): a paragraph with its time and label in bold."""
    label = meeting_label(F.col("source"), F.col("speaker"))
    line = F.concat(F.lit("**["), short_timestamp(F.col("start_ms")), F.lit("]"), F.when(label.isNotNull(), F.concat(F.lit(" "), label, F.lit(":"))).otherwise(""), F.lit("** "), F.col("text"))
    return paragraphs.select(key, "paragraph", line.alias("line"))


def participants(paragraphs: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, participants): distinct labels in order of first appearance."""
    label = meeting_label(F.col("source"), F.col("speaker"))
    first = paragraphs.withColumn("label", label).filter("label IS NOT NULL").groupBy(key, "label").agg(F.min("paragraph").alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x.label).alias("participants"))


def front_matter(meetings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, front): YAML with title, optional engine and language, duration (latest paragraph end) and participants."""
    span = paragraphs.groupBy("meeting_id").agg(F.max("end_ms").alias("d"))
    m = meetings.join(span, meetings["id"] == span["meeting_id"], "left").drop("meeting_id")
    m = m.join(participants(paragraphs), F.col("id") == F.col("meeting_id"), "left")
    title = F.coalesce(F.nullif(utrim(F.col("title")), F.lit("")), F.lit("Meeting transcript"))
    line = lambda name, c: F.when(c.isNotNull() & (utrim(c) != ""), F.concat(F.lit(f"{name}: "), yaml_scalar(c), F.lit("\n"))).otherwise("")
    who = F.when(F.size("participants") > 0, F.concat(F.lit("participants:\n"), F.array_join(F.transform("participants", lambda p: F.concat(F.lit("  - "), yaml_scalar(p), F.lit("\n"))), ""))).otherwise("")
    return m.select("id", F.concat(F.lit("---\n"), line("title", title), line("engine", F.col("engine")), line("language", F.col("language")), F.lit('duration: "'), F.substring(timestamp(F.coalesce("d", F.lit(0))), 1, 8), F.lit('"\n'), who, F.lit("---\n")).alias("front"))


def markdown(meetings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, document): front matter, title, optional summary and the paragraphs."""
    body = _document(markdown_lines(paragraphs), "meeting_id", "paragraph", "line", "\n\n")
    m = front_matter(meetings, paragraphs).join(meetings.select("id", "title", "summary"), "id").join(body, F.col("id") == F.col("meeting_id"), "left")
    title = F.coalesce(F.nullif(utrim(F.col("title")), F.lit("")), F.lit("Meeting transcript"))
    summary = F.when(~is_blank(F.col("summary")), F.concat(F.lit("## Summary\n\n"), utrim(F.col("summary")), F.lit("\n\n"))).otherwise("")
    return m.select("id", F.concat("front", F.lit("\n# "), title, F.lit("\n\n"), summary, F.coalesce("document", F.lit("")), F.lit("\n")).alias("document"))


def labelled(text: Column, speaker: Column) -> Column:
    """A text with its speaker's number from 1 before it, if it has one."""
    return F.when(speaker.isNotNull(), F.concat(F.lit("Speaker "), (speaker + 1).cast("string"), F.lit(": "), text)).otherwise(text)


def srt(segments: DataFrame, key: str = "meeting_id", order: list[str] | None = None) -> DataFrame:
    """(key, document): SubRip of the segments that are not blank, numbered from 1, with speakers."""
    kept = segments.filter(~is_blank(F.col("text")))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["start_ms", "idx"])))
    span = F.concat(timestamp(F.col("start_ms"), ","), F.lit(" --> "), timestamp(F.col("end_ms"), ","))
    line = F.concat(F.col("__n").cast("string"), F.lit("\n"), span, F.lit("\n"), labelled(utrim(F.col("text")), F.col("speaker")), F.lit("\n\n"))
    return _document(kept.withColumn("__n", n).withColumn("__line", line), key, "__n", "__line", "")


def vtt(segments: DataFrame, key: str = "meeting_id", order: list[str] | None = None) -> DataFrame:
    """(key, document): WebVTT of the segments that are not blank, under its header, words timed where there are any, with speakers."""
    kept = segments.filter(~is_blank(F.col("text")))
    words = F.col("words") if "words" in segments.columns else F.lit(None).cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>")
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["start_ms", "idx"])))
    span = F.concat(timestamp(F.col("start_ms"), "."), F.lit(" --> "), timestamp(F.col("end_ms"), "."))
    line = F.concat(span, F.lit("\n"), labelled(vtt_body(F.col("text"), words), F.col("speaker")), F.lit("\n\n"))
    return _document(kept.withColumn("__n", n).withColumn("__line", line), key, "__n", "__line", "", head=F.lit("WEBVTT\n\n"))


def documents(segments: DataFrame, name: str, meetings: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """(meeting_id, document) in the format ``name`` (see FORMATS): segments in order of start, then of arrival (``order``).

    Markdown takes title, engine, language and summary from ``meetings``, none without. An unknown format is an error.
    """
    kind, order = extension(name), order or ["start_ms", "idx"]
    if kind is None:
        raise ValueError(f"unknown format: {name}")
    if kind in ("srt", "vtt"):
        return (srt if kind == "srt" else vtt)(segments, order=order)
    blocks = group(segments, "meeting_id", order)
    if kind == "txt":
        return txt(blocks)
    if meetings is None:
        none = F.lit(None).cast("string")
        meetings = segments.select(F.col("meeting_id").alias("id")).distinct().select("id", *[none.alias(c) for c in ("title", "engine", "language", "summary")])
    return markdown(meetings, blocks).withColumnRenamed("id", "meeting_id")


def export(docs: DataFrame, path: str, name: str) -> int:
    """Writes documents (meeting_id, document) below ``path``, one folder ``meeting_id=...`` with one file each; how many.

    The files hold the documents as they are; lines end as written. Nothing to write is an error, as an unknown format is.
    """
    if extension(name) is None:
        raise ValueError(f"unknown format: {name}")
    n = docs.count()
    if not n:
        raise ValueError("nothing to export")
    # the text sink ends each row with a line break, which documents have already
    docs.select("meeting_id", F.regexp_replace("document", r"\n\z", "").alias("value")).repartition("meeting_id").write.mode("overwrite").partitionBy("meeting_id").text(path)
    return n


def live_lines(segments: DataFrame) -> DataFrame:
    """(meeting_id, start_ms, id, line) of final segments: time, label and text."""
    label = F.coalesce(meeting_label(F.col("source"), F.col("speaker")), F.lit("Speaker"))
    return segments.filter(F.col("status") == "Final").select("meeting_id", "start_ms", "id", F.concat(F.lit("["), short_timestamp(F.col("start_ms")), F.lit("] "), label, F.lit(": "), utrim(F.col("text"))).alias("line"))


def duration_text(ms: Column) -> Column:
    """A length of time rounded to seconds, then as minutes, hours; halves round up."""
    s = F.floor(ms / 1000 + 0.5)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s / 60) % 60))
