"""Queries on the note store, shaping and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import text as X
from murmura.operators import render, shape, store
from murmura.sources.tables import table

#: The meeting that single-note queries look at.
NOTE = "m00standup"
#: Unicode white space for RE2.
_S = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_TRIM = rf"regexp_replace(%s, '^{_S}+|{_S}+$', '', 'g')"
_BLANK = rf"regexp_matches(coalesce(%s, ''), '[^\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]')"


def _seg(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "segment", "id", "meeting_id", "idx", "start_ms", "end_ms", "speaker", "source", "text")


def _live(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "live_segment")


def note_save_segments(spark: SparkSession, root: str) -> DataFrame:
    """Stored segments of the live changelog."""
    return store.saved_segments(_live(spark, root), ["start_ms", "seq"])


def note_save_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Meetings as they would be stored from the live changelog."""
    return store.saved_meetings(table(spark, root, "meeting"), note_save_segments(spark, root)).select("id", "title", "duration_ms", "segment_count")


def note_list_preview(spark: SparkSession, root: str) -> DataFrame:
    """All meetings with previews."""
    return store.list_notes(table(spark, root, "meeting", "id", "title", "started_at_ms"), _seg(spark, root))


def note_detail(spark: SparkSession, root: str) -> DataFrame:
    """One meeting with its segments."""
    return store.note_detail(table(spark, root, "meeting"), _seg(spark, root), NOTE)


def note_delete_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Rows left per table once a meeting is deleted."""
    left = store.without_note({n: table(spark, root, n) for n in store.KEYS}, NOTE)
    rows = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, d in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def note_replace(spark: SparkSession, root: str) -> DataFrame:
    """The segment table after the live meetings' segments replaced those stored."""
    new = note_save_segments(spark, root)
    old = _seg(spark, root).select(*new.columns)
    return store.replace_by_key(old, new, "meeting_id", new.select("meeting_id"))


def segment_dto(spark: SparkSession, root: str) -> DataFrame:
    """Live rows as the interface takes them."""
    return store.segment_dto(_live(spark, root))


def chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every meeting's segments."""
    return shape.chunk_texts(_seg(spark, root), "meeting_id", "idx", "text")


def paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs of every meeting."""
    return shape.paragraphs(_seg(spark, root), "meeting_id", ["start_ms", "idx", "id"])


def paragraphs_any_source(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs that may mix sources."""
    return shape.paragraphs(_seg(spark, root), "meeting_id", ["start_ms", "idx", "id"], by_source=False)


def chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    """Documents cut at lines into parts for a model's input."""
    return shape.chunk_lines(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text", 400)


def word_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Words merged from the timed words of live rows, taken as decoder tokens."""
    live = _live(spark, root).select(F.concat_ws("#", "meeting_id", "seq").alias("row"), F.posexplode("words").alias("pos", "w"))
    return shape.merge_tokens(live.select("row", "pos", "w.text", "w.start_ms", "w.end_ms"), "row", "pos")


def rolling_context(spark: SparkSession, root: str) -> DataFrame:
    """What each final of the live meetings was decoded after."""
    final = _live(spark, root).filter("status = 'Final'").withColumn("o", F.struct("start_ms", "seq"))
    return shape.rolling_context(final, "meeting_id", "o", "text").select("meeting_id", "seq", "context")


def merged_live(spark: SparkSession, root: str) -> DataFrame:
    """Finals of each live meeting and source as one segment."""
    final = _live(spark, root).filter("status = 'Final'").withColumn("k", F.concat_ws("#", "meeting_id", "source"))
    return shape.merge_segments(final, "k", "seq").select("k", "text", "start_ms", "end_ms")


def text_functions(spark: SparkSession, root: str) -> DataFrame:
    """Text functions over all segments."""
    t = F.col("text")
    return _seg(spark, root).select(
        "id",
        X.truncate_chars(t, 40).alias("cut"),
        X.source_label(F.col("source")).alias("label"),
        X.meeting_label(F.col("source"), F.col("speaker")).alias("who"),
        X.timestamp(F.col("start_ms"), ",").alias("long_time"),
        X.short_timestamp(F.col("start_ms")).alias("short_time"),
        X.like_escape(t).alias("escaped"),
        X.escape_html(t).alias("html"),
        X.strip_annotation(t).alias("stripped"),
        X.slug(t).alias("slug"),
        X.mask_key(t).alias("masked"),
    )


def export_srt_cues(spark: SparkSession, root: str) -> DataFrame:
    """SubRip cues of every meeting."""
    return render.srt_cues(_seg(spark, root).filter("end_ms IS NOT NULL"), order=["start_ms", "idx", "id"])


def export_vtt_cues(spark: SparkSession, root: str) -> DataFrame:
    """WebVTT cues of the live meetings' finals."""
    return render.vtt_cues(_live(spark, root).filter("status = 'Final'"), order=["start_ms", "seq"])


def export_markdown_lines(spark: SparkSession, root: str) -> DataFrame:
    """Markdown lines of every meeting."""
    return render.markdown_lines(paragraphs(spark, root))


def export_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Whole Markdown documents."""
    return render.markdown(table(spark, root, "meeting"), paragraphs(spark, root))


def export_txt(spark: SparkSession, root: str) -> DataFrame:
    """Whole text documents."""
    return render.txt(paragraphs(spark, root))


def note_participants(spark: SparkSession, root: str) -> DataFrame:
    """Labels of each meeting in order of appearance."""
    return render.participants(paragraphs(spark, root))


def live_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the live transcript."""
    return render.live_lines(_live(spark, root))


def export_srt(spark: SparkSession, root: str) -> DataFrame:
    """SubRip documents of every meeting, with speakers."""
    return render.documents(_seg(spark, root).filter("end_ms IS NOT NULL"), "SRT", order=["start_ms", "idx", "id"])


def export_vtt(spark: SparkSession, root: str) -> DataFrame:
    """WebVTT documents of the live meetings' finals, with speakers and timed words."""
    return render.documents(_live(spark, root).filter("status = 'Final'"), "vtt", order=["start_ms", "seq"])


QUERIES = {f.__name__: f for f in (note_save_segments, note_save_rollup, note_list_preview, note_detail, note_delete_cascade, note_replace, segment_dto, chunk_texts, paragraphs, paragraphs_any_source, chunk_lines, word_tokens, rolling_context, merged_live, text_functions, export_srt_cues, export_vtt_cues, export_srt, export_vtt, export_markdown_lines, export_markdown, export_txt, note_participants, live_lines)}

_SAVED = rf"""SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) - 1 AS idx, start_ms, end_ms, CAST(speaker AS BIGINT) AS speaker,
  CASE WHEN lower(source) IN ('mic', 'microphone') THEN 'mic' WHEN lower(source) IN ('system', 'file') THEN lower(source) ELSE 'unknown' END AS source, {_TRIM % 'text'} AS text
FROM live_segment WHERE status = 'Final' AND {_BLANK % 'text'}"""
_HMS = "printf('%%02d:%%02d:%%02d%s%%03d', (%s) // 3600000, ((%s) // 60000) %% 60, ((%s) // 1000) %% 60, (%s) %% 1000)"


def _ts(c: str, sep: str) -> str:
    return _HMS % (sep, c, c, c, c)


def _short(c: str) -> str:
    return f"CASE WHEN ({c}) >= 3600000 THEN printf('%d:%02d:%02d', ({c}) // 3600000, (({c}) // 60000) % 60, (({c}) // 1000) % 60) ELSE printf('%d:%02d', ({c}) // 60000, (({c}) // 1000) % 60) END"


_WHO = "CASE WHEN source = 'mic' THEN 'Me' WHEN source = 'system' AND speaker IS NOT NULL THEN 'Them (Speaker ' || CAST(speaker + 1 AS BIGINT) || ')' WHEN source = 'system' THEN 'Them' ELSE 'Speaker ' || CAST(speaker + 1 AS BIGINT) END"


def _paragraphs(by_source: bool) -> str:
    same = "c.speaker IS NOT DISTINCT FROM n.speaker" + (" AND c.source IS NOT DISTINCT FROM n.source" if by_source else "")
    goes = f"({same} AND greatest(coalesce(n.start_ms, 0) - coalesce(c.end_ms, 0), 0) <= 1500 AND length(c.text) < 240)"
    return rf"""r AS (SELECT meeting_id, start_ms, end_ms, CAST(speaker AS BIGINT) AS speaker, source, {_TRIM % 'text'} AS t, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, idx, id) AS n FROM segment WHERE {_BLANK % 'text'}),
c AS (SELECT meeting_id, n, 0 AS paragraph, start_ms, CAST(end_ms AS BIGINT) AS end_ms, speaker, source, t AS text FROM r WHERE n = 1
  UNION ALL
  SELECT n.meeting_id, n.n, CASE WHEN {goes} THEN c.paragraph ELSE c.paragraph + 1 END, CASE WHEN {goes} THEN c.start_ms ELSE n.start_ms END, CAST(n.end_ms AS BIGINT), n.speaker, CASE WHEN {goes} THEN c.source ELSE n.source END,
    CASE WHEN {goes} THEN c.text || CASE WHEN regexp_matches(n.t, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || n.t ELSE n.t END
  FROM c JOIN r n ON n.meeting_id = c.meeting_id AND n.n = c.n + 1),
p AS (SELECT meeting_id, CAST(paragraph AS BIGINT) AS paragraph, arg_max(start_ms, n) AS start_ms, arg_max(struct_pack(v := end_ms), n).v AS end_ms, arg_max(struct_pack(v := speaker), n).v AS speaker, arg_max(source, n) AS source, arg_max(text, n) AS text FROM c GROUP BY meeting_id, paragraph)"""


_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
#: Lines of documents packed into chunks of at most 400 characters: c4 (doc_id, chunk, text).
LINES = r"""l AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
c1 AS (SELECT doc_id, ls, 1 AS n, 0 AS chunk, ls[1] AS cur FROM l
  UNION ALL SELECT doc_id, ls, n + 1, CASE WHEN cur != '' AND length(cur) + 1 + length(ls[n + 1]) > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN cur = '' OR length(cur) + 1 + length(ls[n + 1]) > 400 THEN ls[n + 1] ELSE cur || chr(10) || ls[n + 1] END FROM c1 WHERE n < len(ls)),
c4 AS (SELECT doc_id, chunk, arg_max(cur, n) AS text FROM c1 GROUP BY doc_id, chunk HAVING arg_max(cur, n) != '')"""

SQL = {
    "note_save_segments": _SAVED,
    "note_save_rollup": rf"""WITH s AS ({_SAVED}) SELECT m.id, coalesce(nullif({_TRIM % 'm.title'}, ''), 'Untitled meeting') AS title, coalesce(max(s.end_ms), 0) AS duration_ms, count(s.meeting_id) AS segment_count
FROM meeting m LEFT JOIN s ON s.meeting_id = m.id GROUP BY m.id, m.title""",
    "note_list_preview": rf"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY idx, start_ms, text) AS n FROM segment),
g AS (SELECT meeting_id, {_TRIM % "string_agg(text, ' ' ORDER BY n)"} AS t FROM f WHERE n <= 6 GROUP BY meeting_id)
SELECT id, title, started_at_ms, CASE WHEN length(t) > 160 THEN substring(t, 1, 160) || '…' ELSE coalesce(t, '') END AS preview FROM meeting LEFT JOIN g ON g.meeting_id = id""",
    "note_detail": f"SELECT m.id, m.title, m.started_at_ms, s.idx, s.start_ms, s.end_ms, s.speaker, s.source, s.text FROM meeting m LEFT JOIN segment s ON s.meeting_id = m.id WHERE m.id = '{NOTE}'",
    "note_delete_cascade": f"SELECT 'meeting' AS name, count(*) AS n FROM meeting WHERE id != '{NOTE}' UNION ALL SELECT 'segment', count(*) FROM segment WHERE meeting_id != '{NOTE}' UNION ALL SELECT 'chunk', count(*) FROM chunk WHERE meeting_id != '{NOTE}'",
    "note_replace": rf"WITH s AS ({_SAVED}) SELECT * FROM s UNION ALL SELECT meeting_id, idx, start_ms, CAST(end_ms AS BIGINT), CAST(speaker AS BIGINT), source, text FROM segment WHERE meeting_id NOT IN (SELECT meeting_id FROM s)",
    "segment_dto": "SELECT meeting_id, seq, id, text, start_ms, end_ms, status = 'Final' AS is_final, CASE lower(source) WHEN 'mic' THEN 'Microphone' WHEN 'microphone' THEN 'Microphone' WHEN 'system' THEN 'System' WHEN 'file' THEN 'File' ELSE 'Unknown' END AS source, speaker, aux_text FROM live_segment",
    "chunk_texts": rf"""WITH RECURSIVE r AS (SELECT meeting_id, {_TRIM % 'text'} AS t, row_number() OVER (PARTITION BY meeting_id ORDER BY idx, {_TRIM % 'text'}) AS n FROM segment WHERE meeting_id IS NOT NULL AND {_BLANK % 'text'}),
c AS (SELECT meeting_id, n, 0 AS chunk, t AS cur FROM r WHERE n = 1
  UNION ALL SELECT r.meeting_id, r.n, CASE WHEN length(c.cur) + 1 + length(r.t) > 512 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN length(c.cur) + 1 + length(r.t) > 512 THEN r.t ELSE c.cur || ' ' || r.t END FROM c JOIN r ON r.meeting_id = c.meeting_id AND r.n = c.n + 1)
SELECT meeting_id, CAST(chunk AS BIGINT) AS chunk, arg_max(cur, n) AS text FROM c GROUP BY meeting_id, chunk""",
    "paragraphs": f"WITH RECURSIVE {_paragraphs(True)} SELECT * FROM p",
    "paragraphs_any_source": f"WITH RECURSIVE {_paragraphs(False)} SELECT * FROM p",
    "text_functions": rf"""SELECT id, CASE WHEN length({_TRIM % 'text'}) > 40 THEN substring({_TRIM % 'text'}, 1, 40) || '…' ELSE {_TRIM % 'text'} END AS cut,
  CASE WHEN lower(source) IN ('mic', 'microphone') THEN 'mic' WHEN lower(source) IN ('system', 'file') THEN lower(source) ELSE 'unknown' END AS label, {_WHO} AS who,
  {_ts('start_ms', ',')} AS long_time, {_short('start_ms')} AS short_time, replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_') AS escaped,
  replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, CASE WHEN regexp_matches({_TRIM % 'text'}, '^[\[(]') THEN '' ELSE {_TRIM % 'text'} END AS stripped,
  regexp_replace(regexp_replace(lower({_TRIM % 'text'}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN length({_TRIM % 'text'}) = 0 THEN NULL WHEN length({_TRIM % 'text'}) <= 8 THEN '…' || right({_TRIM % 'text'}, 4) ELSE left({_TRIM % 'text'}, 3) || '…' || right({_TRIM % 'text'}, 4) END AS masked FROM segment""",
    "export_srt_cues": rf"""WITH r AS (SELECT meeting_id, start_ms, CAST(end_ms AS BIGINT) AS end_ms, {_TRIM % 'text'} AS t, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, idx, id) AS cue FROM segment WHERE end_ms IS NOT NULL AND {_BLANK % 'text'})
SELECT meeting_id, cue, cue || chr(10) || {_ts('start_ms', ',')} || ' --> ' || {_ts('end_ms', ',')} || chr(10) || t || chr(10) AS text FROM r""",
    "export_vtt_cues": rf"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS cue FROM live_segment WHERE status = 'Final' AND {_BLANK % 'text'})
SELECT meeting_id, cue, {_ts('start_ms', '.')} || ' --> ' || {_ts('end_ms', '.')} || chr(10) || CASE WHEN words IS NULL OR len(words) = 0 THEN {_TRIM % 'text'}
  ELSE array_to_string(list_transform(words, lambda w, i: '<' || {_ts('w.start_ms', '.')} || '>' || CASE WHEN i = 1 THEN ltrim(w.text) ELSE w.text END), '') END || chr(10) AS text FROM r""",
    "export_srt": rf"""WITH r AS (SELECT meeting_id, start_ms, CAST(end_ms AS BIGINT) AS end_ms, speaker, {_TRIM % 'text'} AS t, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, idx, id) AS cue FROM segment WHERE end_ms IS NOT NULL AND {_BLANK % 'text'})
SELECT meeting_id, string_agg(cue || chr(10) || {_ts('start_ms', ',')} || ' --> ' || {_ts('end_ms', ',')} || chr(10) || coalesce('Speaker ' || CAST(speaker + 1 AS BIGINT) || ': ', '') || t || chr(10) || chr(10), '' ORDER BY cue) AS document FROM r GROUP BY meeting_id""",
    "export_vtt": rf"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS cue FROM live_segment WHERE status = 'Final' AND {_BLANK % 'text'}),
c AS (SELECT meeting_id, cue, {_ts('start_ms', '.')} || ' --> ' || {_ts('end_ms', '.')} || chr(10) || coalesce('Speaker ' || CAST(speaker + 1 AS BIGINT) || ': ', '') || CASE WHEN words IS NULL OR len(words) = 0 THEN {_TRIM % 'text'}
  ELSE array_to_string(list_transform(words, lambda w, i: '<' || {_ts('w.start_ms', '.')} || '>' || CASE WHEN i = 1 THEN ltrim(w.text) ELSE w.text END), '') END AS t FROM r)
SELECT meeting_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(t || chr(10) || chr(10), '' ORDER BY cue) AS document FROM c GROUP BY meeting_id""",
    "export_markdown_lines": rf"WITH RECURSIVE {_paragraphs(True)} SELECT meeting_id, paragraph, '**[' || {_short('start_ms')} || ']' || coalesce(' ' || ({_WHO}) || ':', '') || '** ' || text AS line FROM p",
    "export_txt": rf"WITH RECURSIVE {_paragraphs(True)} SELECT meeting_id, string_agg(coalesce('Speaker ' || CAST(speaker + 1 AS BIGINT) || ': ', '') || text, chr(10) || chr(10) ORDER BY paragraph) || chr(10) AS document FROM p GROUP BY meeting_id",
    "note_participants": rf"WITH RECURSIVE {_paragraphs(True)}, l AS (SELECT meeting_id, {_WHO} AS label, min(paragraph) AS seen FROM p GROUP BY ALL) SELECT meeting_id, list(label ORDER BY seen) AS participants FROM l WHERE label IS NOT NULL GROUP BY meeting_id",
    "live_lines": rf"SELECT meeting_id, start_ms, id, '[' || {_short('start_ms')} || '] ' || coalesce({_WHO}, 'Speaker') || ': ' || {_TRIM % 'text'} AS line FROM live_segment WHERE status = 'Final'",
    "merged_live": r"""SELECT concat_ws('#', meeting_id, source) AS k, string_agg(text, '' ORDER BY seq) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM live_segment WHERE status = 'Final' GROUP BY meeting_id, source HAVING regexp_matches(string_agg(text, '' ORDER BY seq), '[\p{L}\p{N}]')""",
    "chunk_lines": f"WITH RECURSIVE {LINES} SELECT doc_id, CAST(chunk AS INT) AS chunk, text FROM c4",
    "word_tokens": rf"""WITH w AS (SELECT meeting_id || '#' || seq AS row, words, unnest(range(len(words))) AS pos FROM live_segment),
t AS (SELECT row, pos, words[pos + 1].text AS t, words[pos + 1].start_ms AS s, words[pos + 1].end_ms AS e FROM w), k AS (SELECT * FROM t WHERE t IS NOT NULL AND t != '' AND NOT starts_with(t, '[')),
b AS (SELECT *, lag(t) OVER (PARTITION BY row ORDER BY pos) AS b FROM k),
o AS (SELECT *, CASE WHEN b IS NULL OR regexp_matches(t, '^[\s\p{{Z}}]') OR regexp_matches(t, '^[\s\p{{Z}}]*{_CJK}') OR regexp_matches(b, '{_CJK}[\s\p{{Z}}]*$') THEN 1 ELSE 0 END AS opens FROM b),
g AS (SELECT *, sum(opens) OVER (PARTITION BY row ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS word FROM o)
SELECT row, CAST(word AS BIGINT) AS word, string_agg(t, '' ORDER BY pos) AS text, arg_min(s, pos) AS start_ms, arg_max(e, pos) AS end_ms FROM g GROUP BY row, word""",
    "rolling_context": rf"""WITH r AS (SELECT meeting_id, seq, string_agg(CASE WHEN {_BLANK % 'text'} THEN {_TRIM % 'text'} END, ' ') OVER (PARTITION BY meeting_id ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM live_segment WHERE status = 'Final')
SELECT meeting_id, seq, CASE WHEN length(c) > 224 THEN right(c, 224) ELSE coalesce(c, '') END AS context FROM r""",
}
