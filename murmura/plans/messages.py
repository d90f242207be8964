"""Queries on service messages, requests and token times, made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import text as X
from murmura.operators import shape
from murmura.operators import signal as G
from murmura.operators import wire as J
from murmura.sources.tables import table

#: A message type for each type of event, of the three kinds of sessions that have two texts or a transcript (fixed values).
TYPES = {
    "view": ("conversation.item.input_audio_transcription.delta", "response.output_text.delta", "session.output_transcript.delta"),
    "click": ("conversation.item.input_audio_transcription.failed", "response.output_text.delta", "session.input_transcript.delta"),
    "purchase": ("conversation.item.input_audio_transcription.completed", "response.output_text.done", "session.output_audio.delta"),
    "signup": ("session.created", "response.output_text.done", "session.closed"),
    "error": ("error", "error", "error"),
}
SESSIONS = ("transcription", "model", "translation", "assist")


def server_events(spark: SparkSession, root: str) -> DataFrame:
    """Events written as messages of transcription, model, translation and assist sessions by turns, and read back."""
    e = table(spark, root, "events", "event_id", "event_type").withColumn("session", F.get(F.array(*map(F.lit, SESSIONS)), F.col("event_id") % 4))
    by = F.create_map(*[x for t, kinds in TYPES.items() for x in (F.lit(t), F.array(*map(F.lit, (*kinds, kinds[1]))))])[F.col("event_type")]
    kind, said = F.get(by, F.col("event_id") % 4), F.concat(F.lit("n"), F.col("event_id").cast("string"))
    wrong = (kind == "error") | kind.endswith("failed")
    message = F.to_json(F.struct(kind.alias("type"), F.when(kind.endswith("delta"), said).alias("delta"), F.when(kind.endswith("completed"), said).alias("transcript"), F.when(kind.endswith("done"), said).alias("text"), F.when(wrong, F.struct(said.alias("message"))).alias("error")))
    return e.select("event_id", J.server_event(message, F.col("session")).alias("e")).select("event_id", "e.kind", "e.text")


def transcript_messages(spark: SparkSession, root: str) -> DataFrame:
    """Events written as messages of a service that sends whole segments, and read back."""
    said = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    kind = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "RecognitionStarted").otherwise("AddTranscript")
    odd = F.col("event_id") % 2 == 1
    message = F.to_json(F.struct(kind.alias("message"), F.when(kind == "AddTranscript", F.struct(said.alias("transcript"))).alias("metadata"), F.when((kind == "Error") & odd, said).alias("reason"), F.when(kind == "Error", F.lit("quota")).alias("type")))
    return table(spark, root, "events", "event_id", "event_type").select("event_id", J.transcript_event(message).alias("e")).select("event_id", "e.kind", "e.text")


def content_messages(spark: SparkSession, root: str) -> DataFrame:
    """Events written as messages of a service that answers in speech, and read back."""
    said = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    t = F.col("event_type")
    heard = F.when(t.isin("view", "click"), F.struct(F.struct(said.alias("text")).alias("inputTranscription")))
    message = F.when(t == "signup", F.lit("{")).otherwise(F.to_json(F.struct(heard.alias("serverContent"), F.when(t == "error", F.struct(said.alias("message"))).alias("error"))))
    return table(spark, root, "events", "event_id", "event_type").select("event_id", J.content_event(message).alias("e")).select("event_id", "e.kind", "e.text")


def changed_settings(spark: SparkSession, root: str) -> DataFrame:
    """Of each event's parameters those that differ from the defaults, as sorted keys."""
    given = F.from_json("props", "map<string,string>")
    changed = J.changed_params(given, F.create_map(F.lit("k"), F.lit("7"), F.lit("mode"), F.lit("auto")))
    return table(spark, root, "events", "event_id", "props").select("event_id", F.array_sort(F.map_keys(changed)).alias("keys"))


def embedding_responses(spark: SparkSession, root: str) -> DataFrame:
    """Vectors written as embedding responses, one of each remainder of 50, read back by index."""
    row = F.struct(F.expr("vec_id div 50").cast("int").alias("index"), F.col("embedding").cast("array<double>").alias("embedding"))
    m = table(spark, root, "embeddings", "vec_id", "embedding").groupBy((F.col("vec_id") % 50).alias("call")).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("json"))
    e = J.embeddings(m, "call", "json", 64)
    return e.select("call", "index", F.transform("embedding", lambda x: F.round(x, 5)).alias("unit"))


def chat_requests(spark: SparkSession, root: str) -> DataFrame:
    """Chat requests of events; odd ones without a system prompt, those of low value without a limit."""
    odd = F.col("event_id") % 2 == 1
    body = J.chat_body(F.lit("m"), F.when(~odd, F.lit("be brief")), F.col("event_type"), F.lit(None).cast("double"), F.when(F.col("value") >= 100, F.lit(256)))
    return table(spark, root, "events", "event_id", "event_type", "value").select("event_id", body.alias("body"))


def token_times(spark: SparkSession, root: str) -> DataFrame:
    """Words of parallel arrays of tokens and times, the clip ending with the segment."""
    t = F.transform("words", lambda w: w.text)
    s = F.transform("words", lambda w: w.start_ms.cast("double"))
    live = table(spark, root, "live_segment", "meeting_id", "seq", "end_ms", "words").filter(F.size("words") > 0)
    return live.select("meeting_id", "seq", F.posexplode(shape.token_words(t, s, F.col("end_ms").cast("double"))).alias("pos", "w")).select("meeting_id", "seq", "pos", "w.text", "w.start", "w.end")


def positions(spark: SparkSession, root: str) -> DataFrame:
    """Token places where positive entries of a vector count as tokens that are not masked."""
    mask = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    return table(spark, root, "embeddings", "vec_id", "embedding").select("vec_id", G.position_ids(mask).alias("places"))


def near_segments(spark: SparkSession, root: str) -> DataFrame:
    """Likeness of each segment to the one before of its meeting, on letters and digits of ASCII, as its SQL has it."""
    return _likeness(spark, root, F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""))


def near_segments_unicode(spark: SparkSession, root: str) -> DataFrame:
    """Likeness of each segment to the one before of its meeting, on letters and digits of every script."""
    return _likeness(spark, root, X.echo_key(F.col("text")))


def _likeness(spark: SparkSession, root: str, key: Column) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, root, "segment", "id", "meeting_id", "start_ms", "text").select("id", "meeting_id", "start_ms", key.alias("t"))
    d = d.withColumn("before", F.lag("t").over(Window.partitionBy("meeting_id").orderBy("start_ms", "id"))).filter("before IS NOT NULL AND t IS NOT NULL")
    return d.select("id", F.round(X.similarity(F.col("t"), F.col("before")), 6).alias("likeness"))


QUERIES = {f.__name__: f for f in (server_events, transcript_messages, content_messages, changed_settings, embedding_responses, chat_requests, token_times, positions, near_segments, near_segments_unicode)}

SQL = {
    "server_events": """WITH k AS (SELECT event_id, CASE event_id % 4
WHEN 0 THEN CASE event_type WHEN 'view' THEN 'Delta' WHEN 'click' THEN 'Failed' WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Error' ELSE 'Other' END
WHEN 1 THEN CASE event_type WHEN 'view' THEN 'AuxDelta' WHEN 'click' THEN 'AuxDelta' WHEN 'error' THEN 'Error' ELSE 'AuxDone' END
WHEN 2 THEN CASE event_type WHEN 'view' THEN 'Delta' WHEN 'click' THEN 'AuxDelta' WHEN 'error' THEN 'Error' ELSE 'Other' END
ELSE CASE event_type WHEN 'view' THEN 'Delta' WHEN 'click' THEN 'Delta' WHEN 'error' THEN 'Error' ELSE 'Completed' END END AS kind FROM events)
SELECT event_id, kind, CASE WHEN kind = 'Other' THEN '' ELSE 'n' || event_id END AS text FROM k""",
    "transcript_messages": """SELECT event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Other' ELSE 'Delta' END AS kind,
CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'quota' ELSE 'n' || event_id END AS text FROM events""",
    "content_messages": "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'Delta' WHEN event_type = 'error' THEN 'Error' ELSE 'Other' END AS kind, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'n' || event_id ELSE '' END AS text FROM events",
    "changed_settings": "SELECT event_id, list_sort(list_filter(json_keys(props), lambda k: CASE k WHEN 'k' THEN json_extract_string(props, '$.k') != '7' WHEN 'mode' THEN json_extract_string(props, '$.mode') != 'auto' ELSE true END)) AS keys FROM events",
    "embedding_responses": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id % 50 AS call, CAST(vec_id // 50 AS INT) AS \"index\", list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 5) + 0.0) AS unit FROM e",
    "chat_requests": """SELECT event_id, '{"model":"m","messages":[' || CASE WHEN event_id % 2 = 0 THEN '{"role":"system","content":"be brief"},' ELSE '' END || '{"role":"user","content":"' || event_type || '"}]' || CASE WHEN value >= 100 THEN ',"max_tokens":256' ELSE '' END || '}' AS body FROM events""",
    "token_times": """WITH w AS (SELECT meeting_id, seq, end_ms, words, unnest(range(len(words))) AS pos FROM live_segment WHERE len(words) > 0)
SELECT meeting_id, seq, CAST(pos AS INT) AS pos, words[pos + 1].text AS text, greatest(CAST(words[pos + 1].start_ms AS DOUBLE), 0.0) AS start, greatest(coalesce(CAST(words[pos + 2].start_ms AS DOUBLE), CAST(end_ms AS DOUBLE)), greatest(CAST(words[pos + 1].start_ms AS DOUBLE), 0.0)) AS "end" FROM w""",
    "positions": "WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS k FROM embeddings) SELECT vec_id, list_transform(range(len(k)), lambda i: CAST(coalesce(list_sum(k[1 : i]), 0) AS BIGINT)) AS places FROM m",
    "near_segments": """WITH d AS (SELECT id, meeting_id, start_ms, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM segment),
l AS (SELECT *, lag(t) OVER (PARTITION BY meeting_id ORDER BY start_ms, id) AS before FROM d)
SELECT id, round(CASE WHEN greatest(length(t), length(before)) = 0 THEN 1.0 ELSE 1 - levenshtein(t, before)::DOUBLE / greatest(length(t), length(before)) END, 6) AS likeness FROM l WHERE before IS NOT NULL AND t IS NOT NULL""",
}
