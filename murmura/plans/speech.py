"""Queries on speakers, changelogs, signals, messages and the model catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators import assist as A
from murmura.operators import signal as G
from murmura.operators import speakers as E
from murmura.operators import wire as J
from murmura.plans.notes import LINES
from murmura.sources.tables import table
from murmura.streaming import batch as B
from murmura.streaming import folds


def _spans(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "speaker_span")


def _seg(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "segment", "id", "meeting_id", "start_ms", F.col("end_ms").cast("bigint").alias("end_ms"), F.col("speaker").cast("bigint").alias("speaker"), "text")


def _live(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "live_segment")


def speaker_majority(spark: SparkSession, root: str) -> DataFrame:
    """The speaker with the most overlap of each segment."""
    return E.majority_speaker(_seg(spark, root), _spans(spark, root), ["id"])


def assign_speakers(spark: SparkSession, root: str) -> DataFrame:
    """Segments with their majority speaker, or their own."""
    return E.assign_speakers(_seg(spark, root).select("id", "meeting_id", "start_ms", "end_ms", "speaker"), _spans(spark, root), ["id"]).select("id", "speaker")


def split_by_speaker(spark: SparkSession, root: str) -> DataFrame:
    """Live finals cut where the speaker of their words changes."""
    final = _live(spark, root).filter("status = 'Final'")
    return E.split_by_speaker(final, _spans(spark, root))


def timeline_remap(spark: SparkSession, root: str) -> DataFrame:
    """Starts of live rows, taken as times without pauses, mapped back by the speaker spans of their meeting."""
    u = _spans(spark, root).groupBy("meeting_id", "start_ms").agg(F.max(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("duration_ms"))
    gates = E.gate_map(u, "meeting_id", "start_ms")
    points = _live(spark, root).select("meeting_id", "seq", "start_ms")
    return E.to_original(points, gates, "meeting_id", "start_ms").select("meeting_id", "seq", "original_ms")


def upsert_latest(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of each live segment."""
    return B.upsert_latest(_live(spark, root).select("meeting_id", "source", "id", "seq", "text", "status", "start_ms", "end_ms"), ["meeting_id", "source", "id"])


def coalesce_burst(spark: SparkSession, root: str) -> DataFrame:
    """Bursts of fifty live rows with stale partials dropped."""
    d = _live(spark, root).withColumn("burst", F.expr("seq div 50"))
    return B.coalesce_burst(d, ["meeting_id", "burst"]).select("meeting_id", "burst", "seq", "id", "status")


def echo_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Live rows without echoes."""
    return B.drop_echoes(_live(spark, root)).select("meeting_id", "seq", "id", "source", "status")


def changed_partials(spark: SparkSession, root: str) -> DataFrame:
    """Live rows whose text differs from the row before of the same segment."""
    d = _live(spark, root).withColumn("k", F.concat_ws("#", "meeting_id", "id"))
    return B.changed_only(d, "k", "seq", "text").select("meeting_id", "seq", "text")


def queue_tail(spark: SparkSession, root: str) -> DataFrame:
    """What a queue of 16 rows would still hold of each live meeting."""
    return B.last_rows(_live(spark, root), "meeting_id", "seq", 16).select("meeting_id", "seq")


def _frames(spark: SparkSession, root: str) -> DataFrame:
    """Events as frames of 100 ms of four streams: speech where the value is 100 or more."""
    e = table(spark, root, "events", "event_id", "user_id", "event_type", "value")
    return e.select((F.col("user_id") % 4).alias("stream"), "event_id", (F.col("value") >= 100).alias("speech"), F.lit(100).cast("bigint").alias("ms"), "event_type", "value")


def utterance_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Utterances of frames by summed silence."""
    return B.utterances(_frames(spark, root), "stream", "event_id", "speech", "ms", "event_id", 200)


def streaming_ids(spark: SparkSession, root: str) -> DataFrame:
    """Decoder results made of events: purchases end an utterance, errors are empty."""
    d = _frames(spark, root).select("stream", "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.col("event_type"), F.lit(" "), F.round("value").cast("bigint").cast("string"))).alias("text"), F.col("event_type").isin("purchase", "error").alias("is_endpoint"))
    return B.streaming_ids(d, "stream", "event_id")


def accumulate_events(spark: SparkSession, root: str) -> DataFrame:
    """Messages of transcription sessions made of events, as final texts; a completed text may be empty."""
    kinds = F.create_map(*[F.lit(x) for x in ("view", "Delta", "click", "Delta", "purchase", "Completed", "signup", "Other", "error", "Error")])
    said = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit(" "), F.col("event_type"))).when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 > 0), F.concat(F.lit("whole "), F.col("event_id").cast("string")))
    d = _frames(spark, root).select("stream", "event_id", kinds[F.col("event_type")].alias("kind"), said.alias("text"), (F.col("event_id") * 100).alias("at_ms"))
    return B.accumulate(d, "stream", "event_id")


def accumulate_translation(spark: SparkSession, root: str) -> DataFrame:
    """Messages of translation sessions made of events: two texts that close after a pause, or at an error."""
    kinds = F.create_map(*[F.lit(x) for x in ("view", "Delta", "click", "AuxDelta", "purchase", "Delta", "signup", "Other", "error", "Error")])
    d = _frames(spark, root).select("stream", "event_id", kinds[F.col("event_type")].alias("kind"), F.concat(F.lit(" "), F.col("event_type")).alias("text"), (F.col("event_id") * 150).alias("at_ms"))
    return B.accumulate(d, "stream", "event_id", "translation")


def accumulate_model(spark: SparkSession, root: str) -> DataFrame:
    """Messages of model sessions made of events: closed when both texts are done, or one is and a pause went by."""
    kinds = F.create_map(*[F.lit(x) for x in ("view", "Delta", "click", "AuxDelta", "purchase", "Completed", "signup", "AuxDone", "error", "Error")])
    d = _frames(spark, root).select("stream", "event_id", kinds[F.col("event_type")].alias("kind"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("text"), (F.col("event_id") * 150).alias("at_ms"))
    return B.accumulate(d, "stream", "event_id", "model")


def polled_emissions(spark: SparkSession, root: str) -> DataFrame:
    """What is shown of polls made of events: purchases bring finals, others a volatile text that changes slowly."""
    d = _frames(spark, root)
    polls = d.select("stream", "event_id", F.when(F.col("event_type") == "purchase", F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("final"), F.when(F.col("event_type") != "error", F.concat(F.lit("v"), F.expr("event_id div 40").cast("string"))).alias("volatile"))
    return B.emissions(polls, "stream", "event_id")


def meeting_sources(spark: SparkSession, root: str) -> DataFrame:
    """Meetings whose segments come from more than one source."""
    return E.several_sources(table(spark, root, "segment", "meeting_id", "source"))


def strict_params(spark: SparkSession, root: str) -> DataFrame:
    """Typed parameters from the events' JSON; every third value is in quotes, which is no number."""
    text = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"(\d+)", '"$1"')).otherwise(F.col("props"))
    p = J.typed_params(text, {"k": ("int", -1), "limit": ("float", 0.5), "on": ("bool", True)})
    return table(spark, root, "events", "event_id", "props").select("event_id", p.alias("p")).select("event_id", "p.*")


def dictated(spark: SparkSession, root: str) -> DataFrame:
    """Each live meeting's text as dictated: its finals, and the partial that is still open."""
    return B.dictation(_live(spark, root).filter("id % 7 > 0 OR status = 'Partial'"), "meeting_id", "seq")


def sticky_language(spark: SparkSession, root: str) -> DataFrame:
    """The language each stream is locked to, with event types for detections and low values for silence."""
    d = _frames(spark, root)
    text = F.when(F.col("value") >= 150, "x")
    found = F.when(F.col("event_type") == "view", "auto").when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return B.locked_language(d, "stream", "event_id", F.lit(True), text, found).select("stream", "event_id", "language")


def capture_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Decoding jobs of frames made of events: two streams a session, partials between finals under shared ids."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream").orderBy("event_id")
    d = _frames(spark, root).withColumn("quiet", F.when(F.col("speech"), 0).otherwise(1)).withColumn("run", F.sum(F.when(F.col("quiet") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("stream", "run").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("speech_ms", F.when(F.col("speech"), F.sum(F.when(F.col("speech"), 100)).over(inside)))
    d = d.withColumn("opens_ms", F.when(F.col("speech"), F.min(F.when(F.col("speech"), F.col("event_id") * 100)).over(inside)))
    d = d.select((F.col("stream") % 2).alias("session"), "stream", "event_id", F.when(F.col("speech"), F.col("run")).alias("utterance"), "opens_ms", "speech_ms", "ms", F.lit(300).alias("decode_ms"), (~F.col("speech")).alias("closed"))
    return B.capture_jobs(d, "session", "stream", "event_id")


def colliding_slugs(spark: SparkSession, root: str) -> DataFrame:
    """Slugs of the nations' regions, many of the same name, some taken."""
    names = table(spark, root, "nation", "n_nationkey", "n_regionkey").join(table(spark, root, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("#", "r_name", "n_regionkey").alias("name"))
    return A.unique_slugs(names, "name", spark.createDataFrame([("asia-2",), ("asia-2-2",), ("europe-3",)], "slug string"))


def assist_triggers(spark: SparkSession, root: str) -> DataFrame:
    """When an assistant would be asked: errors by hand, speech every 15 s."""
    d = _frames(spark, root).select("stream", "event_id", (F.col("event_id") * 100).alias("at"), "speech", (F.col("event_type") == "error").alias("manual"))
    return B.assist_triggers(d, "stream", "event_id", "at", "speech", "manual")


def online_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Speaker numbers of the vectors of the embeddings table, one stream per label parity."""
    d = table(spark, root, "embeddings").select((F.col("label") % 2).alias("stream"), "vec_id", "embedding", (F.col("vec_id") % 3 > 0).alias("sure"))
    return B.online_clusters(d, "stream", "vec_id", "embedding", "sure", 0.5)


def mixer_shares(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of even and odd number mixed as two streams: the first one's share of each frame."""
    v = table(spark, root, "embeddings").select(F.expr("vec_id div 2").alias("frame"), (F.col("vec_id") % 2).alias("side"), "embedding")
    pair = v.groupBy("frame").agg(F.max(F.when(F.col("side") == 0, F.col("embedding"))).alias("first"), F.max(F.when(F.col("side") == 1, F.col("embedding"))).alias("second"))
    return B.replay(folds.mixer(), pair.withColumn("stream", F.lit(0)), "stream", "frame").select("frame", F.round("share", 6).alias("share"), F.size("mixed").alias("n"))


def meeting_locales(spark: SparkSession, root: str) -> DataFrame:
    """A recogniser's locale for each meeting's label."""
    return table(spark, root, "meeting", "id", "language").select("id", A.locale(F.col("language")).alias("locale"))


def document_answers(spark: SparkSession, root: str) -> DataFrame:
    """Map and reduce over documents with a stand-in model that answers with a length."""
    return A.map_reduce(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text", 400, lambda t: F.concat(F.lit("length "), F.char_length(t).cast("string")))


def title_slugs(spark: SparkSession, root: str) -> DataFrame:
    """A slug of its own for each document number's label."""
    names = table(spark, root, "meeting", "id", "title").select(F.concat_ws(" ", "title", "id").alias("name"))
    return A.unique_slugs(names, "name", spark.createDataFrame([("weekly-sync",)], "slug string"))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings", "vec_id", "embedding")


def downmix(spark: SparkSession, root: str) -> DataFrame:
    """Vectors read as two channels, mixed down."""
    return _vectors(spark, root).select("vec_id", F.transform(G.downmix(F.col("embedding"), F.lit(2)), lambda x: F.round(x, 6)).alias("mono"))


def resample_linear(spark: SparkSession, root: str) -> DataFrame:
    """Vectors at a third of their rate."""
    return _vectors(spark, root).select("vec_id", F.transform(G.resample(F.col("embedding"), F.lit(48), F.lit(16)), lambda x: F.round(x, 6)).alias("thin"))


def rms_gate(spark: SparkSession, root: str) -> DataFrame:
    """Speech decision and gated level of vectors read as samples."""
    v = F.col("embedding")
    return _vectors(spark, root).select("vec_id", B.is_speech(v, 0.125).alias("speech"), F.round(G.gated_rms(v, 400), 6).alias("level"))


def apply_gain(spark: SparkSession, root: str) -> DataFrame:
    """Vectors brought to one level without clipping."""
    v = F.col("embedding")
    return _vectors(spark, root).select("vec_id", F.transform(G.apply_gain(v, F.sqrt(G.mean_square(v)), 0.4), lambda x: F.round(x, 6)).alias("loud"))


def audio_frames(spark: SparkSession, root: str) -> DataFrame:
    """Vectors cut into frames of 100 ms at 100 samples a second."""
    f = _vectors(spark, root).select("vec_id", F.explode(G.frames(F.col("embedding"), 100)).alias("f"))
    return f.select("vec_id", "f.timestamp_ms", F.size("f.samples").alias("n"))


def high_pass(spark: SparkSession, root: str) -> DataFrame:
    """Vectors through the high pass."""
    return _vectors(spark, root).select("vec_id", F.transform(G.high_pass(F.col("embedding"), F.lit(16_000)), lambda x: F.round(x, 6)).alias("y"))


def props_params(spark: SparkSession, root: str) -> DataFrame:
    """Typed parameters read from the events' JSON, with defaults."""
    given = F.from_json("props", "map<string,string>")
    p = J.params(given, {"k": ("bigint", 7), "limit": ("double", 0.5), "mode": ("string", "auto")})
    return table(spark, root, "events", "event_id", "props").select("event_id", p.alias("p")).select("event_id", "p.*")


def diarized_index(spark: SparkSession, root: str) -> DataFrame:
    """Diarized messages made of the live finals' speakers, read back with numbers by first appearance."""
    final = _live(spark, root).filter("status = 'Final'")
    row = F.struct("seq", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("text"), F.concat(F.lit("spk"), F.col("speaker")).alias("speaker"))
    m = final.groupBy("meeting_id", F.expr("id div 20").alias("part")).agg(F.array_sort(F.collect_list(row)).alias("segments"))
    m = m.select(F.concat_ws("#", "meeting_id", F.col("part").cast("string")).alias("k"), F.to_json(F.struct("segments")).alias("json"))
    return J.diarized(m, "k", "json")


def catalog_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Files and sizes of the models."""
    return J.catalog_sizes(table(spark, root, "model_catalog"))


def catalog_by_language(spark: SparkSession, root: str) -> DataFrame:
    """Models per language."""
    return J.catalog_by_language(table(spark, root, "model_catalog"))


QUERIES = {f.__name__: f for f in (speaker_majority, assign_speakers, split_by_speaker, timeline_remap, upsert_latest, coalesce_burst, echo_dedup, changed_partials, queue_tail, utterance_sessions, streaming_ids, accumulate_events, accumulate_translation, accumulate_model, polled_emissions, meeting_sources, strict_params, dictated, sticky_language, capture_jobs, colliding_slugs, assist_triggers, online_clusters, mixer_shares, meeting_locales, document_answers, title_slugs, downmix, resample_linear, rms_gate, apply_gain, audio_frames, high_pass, props_params, diarized_index, catalog_sizes, catalog_by_language)}

_MAJORITY = """o AS (SELECT s.id, p.speaker, sum(least(s.end_ms, p.end_ms) - greatest(s.start_ms, p.start_ms)) AS total FROM segment s JOIN speaker_span p ON p.meeting_id = s.meeting_id AND p.start_ms < s.end_ms AND s.start_ms < p.end_ms AND p.end_ms > p.start_ms AND s.end_ms > s.start_ms WHERE p.speaker IS NOT NULL GROUP BY ALL),
best AS (SELECT id, CAST(arg_max(speaker, total * 100000 + speaker) AS BIGINT) AS speaker FROM o GROUP BY id)"""
_FRAMES = "f AS (SELECT user_id % 4 AS stream, event_id, value >= 100 AS speech, event_type, value FROM events)"

SQL = {
    "accumulate_events": f"""WITH {_FRAMES}, e AS (SELECT stream, event_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN ' ' || event_type END AS said, event_type IN ('purchase', 'error') AS closes FROM f WHERE event_type != 'signup'),
g AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
t AS (SELECT stream, part, CASE WHEN bool_or(event_type = 'purchase') THEN max(CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 > 0 THEN 'whole ' || event_id ELSE '' END END) ELSE coalesce(string_agg(said, '' ORDER BY event_id), '') END AS text FROM g GROUP BY stream, part)
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY part) - 1 AS n, text, CAST(NULL AS VARCHAR) AS aux_text FROM t WHERE text != ''""",
    "accumulate_translation": f"""WITH {_FRAMES}, e AS (SELECT stream, event_id, event_type, event_id * 150 AS ms FROM f WHERE event_type != 'signup'),
o AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= 1200 OR lag(event_type) OVER w = 'error' THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY stream ORDER BY event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS part FROM o),
t AS (SELECT stream, part, coalesce(string_agg(CASE WHEN event_type IN ('view', 'purchase') THEN ' ' || event_type END, '' ORDER BY event_id), '') AS text, string_agg(CASE WHEN event_type = 'click' THEN ' click' END, '' ORDER BY event_id) AS aux_text FROM g GROUP BY stream, part)
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY part) - 1 AS n, text, aux_text FROM t WHERE text != '' OR aux_text != ''""",
    "polled_emissions": f"""WITH {_FRAMES}, p AS (SELECT stream, event_id, CASE WHEN event_type = 'purchase' THEN 'f' || event_id END AS fin, CASE WHEN event_type != 'error' THEN 'v' || (event_id // 40) END AS vol FROM f),
g AS (SELECT *, sum(CASE WHEN fin IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS part FROM p),
b AS (SELECT *, last_value(CASE WHEN fin IS NULL THEN vol END IGNORE NULLS) OVER (PARTITION BY stream, part ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT stream, event_id, CASE WHEN fin IS NOT NULL THEN 'Final' ELSE 'Partial' END AS status, coalesce(fin, vol) AS text FROM b WHERE fin IS NOT NULL OR vol IS NOT NULL AND vol IS DISTINCT FROM before""",
    "meeting_sources": "SELECT meeting_id, count(DISTINCT source) > 1 AS several FROM segment GROUP BY meeting_id",
    "strict_params": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) END AS k, 0.5::DOUBLE AS \"limit\", true AS \"on\" FROM events",
    "dictated": r"""WITH l AS (SELECT meeting_id, seq, status, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM live_segment WHERE id % 7 > 0 OR status = 'Partial'),
m AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seq DESC) AS r FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seq) AS n FROM m WHERE t != '' AND (status = 'Final' OR r = 1))
SELECT k.meeting_id, coalesce(string_agg(CASE WHEN n > 1 AND regexp_matches(t, '^[A-Za-z0-9]') THEN ' ' || t ELSE t END, '' ORDER BY seq), '') AS text FROM (SELECT DISTINCT meeting_id FROM l) k LEFT JOIN p ON p.meeting_id = k.meeting_id GROUP BY k.meeting_id""",
    "sticky_language": f"WITH {_FRAMES} SELECT stream, event_id, first_value(CASE WHEN value >= 150 AND event_type NOT IN ('view', 'click') THEN event_type END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS language FROM f",
    "colliding_slugs": """WITH n AS (SELECT r_name || '#' || n_regionkey AS name, replace(lower(r_name), ' ', '-') || '-' || n_regionkey AS s FROM nation JOIN region ON r_regionkey = n_regionkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s) AS k FROM n)
SELECT name, CASE WHEN s = 'asia-2' THEN s || '-' || (k + 2) WHEN s = 'europe-3' THEN s || '-' || (k + 1) WHEN k = 1 THEN s ELSE s || '-' || k END AS slug FROM r""",
    "high_pass": """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (1 / (2 * pi() * 70.0)) / (1 / (2 * pi() * 70.0) + 1 / 16000.0) AS a FROM embeddings),
r AS (SELECT vec_id, v, a, 1 AS i, [0.0::DOUBLE] AS y FROM e UNION ALL SELECT vec_id, v, a, i + 1, list_append(y, a * (y[i] + v[i + 1] - v[i])) FROM r WHERE i < len(v))
SELECT vec_id, list_transform(y, lambda x: round(x, 6) + 0.0) AS y FROM r WHERE i = len(v)""",
    "meeting_locales": "SELECT id, CASE WHEN language IS NULL THEN NULL ELSE coalesce(CASE lower(trim(language)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.LOCALES.items()) + " END, CASE WHEN contains(trim(language), '-') THEN trim(language) END, 'en-US') END AS locale FROM meeting",
    "speaker_majority": f"WITH {_MAJORITY} SELECT id, speaker FROM best",
    "assign_speakers": f"WITH {_MAJORITY} SELECT s.id, coalesce(b.speaker, CAST(s.speaker AS BIGINT)) AS speaker FROM segment s LEFT JOIN best b ON b.id = s.id",
    "timeline_remap": """WITH u AS (SELECT meeting_id, start_ms, max(greatest(end_ms - start_ms, 0)) AS d FROM speaker_span GROUP BY ALL),
g AS (SELECT meeting_id, start_ms AS o, d, coalesce(sum(d) OVER (PARTITION BY meeting_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM u WHERE d > 0),
p AS (SELECT l.meeting_id, l.seq, l.start_ms AS t, (SELECT arg_max(struct_pack(c := g.c, o := g.o, d := g.d), g.c) FROM g WHERE g.meeting_id = l.meeting_id AND g.c <= l.start_ms) AS a, (SELECT arg_min(struct_pack(c := g.c, o := g.o, d := g.d), g.c) FROM g WHERE g.meeting_id = l.meeting_id) AS z FROM live_segment l)
SELECT meeting_id, seq, CAST(CASE WHEN z IS NULL THEN t ELSE coalesce(a, z).o + least(greatest(t - coalesce(a, z).c, 0), coalesce(a, z).d) END AS BIGINT) AS original_ms FROM p""",
    "upsert_latest": "SELECT meeting_id, source, id, seq, text, status, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, source, id ORDER BY seq DESC) AS n FROM live_segment) WHERE n = 1",
    "coalesce_burst": """WITH d AS (SELECT *, seq // 50 AS burst FROM live_segment),
m AS (SELECT *, max(seq) FILTER (status = 'Final') OVER (PARTITION BY meeting_id, burst, id) AS fin, max(seq) FILTER (status = 'Partial') OVER (PARTITION BY meeting_id, burst, id) AS par FROM d)
SELECT meeting_id, burst, seq, id, status FROM m WHERE status = 'Final' OR seq = par AND (fin IS NULL OR par > fin)""",
    "changed_partials": "SELECT meeting_id, seq, text FROM (SELECT *, lag(text) OVER w AS before, row_number() OVER w AS n FROM live_segment WINDOW w AS (PARTITION BY meeting_id, id ORDER BY seq)) WHERE n = 1 OR text IS DISTINCT FROM before",
    "queue_tail": "SELECT meeting_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seq DESC) AS n FROM live_segment) WHERE n <= 16",
    "utterance_sessions": f"""WITH {_FRAMES}, q AS (SELECT *, sum(CASE WHEN speech THEN 0 ELSE 100 END) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS quiet FROM f),
s AS (SELECT *, lag(quiet) OVER (PARTITION BY stream ORDER BY event_id) AS before FROM q WHERE speech),
u AS (SELECT *, sum(CASE WHEN before IS NULL OR quiet - before >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS utterance FROM s)
SELECT stream, CAST(utterance AS BIGINT) AS utterance, min(event_id) AS start, count(*) AS n_frames, count(*) * 100 AS speech_ms FROM u GROUP BY stream, utterance""",
    "streaming_ids": f"""WITH {_FRAMES}, r AS (SELECT stream, event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ' ' || CAST(round(value) AS BIGINT) END AS text, event_type IN ('purchase', 'error') AS ending FROM f),
i AS (SELECT *, coalesce(sum(CASE WHEN ending AND text != '' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS id, coalesce(sum(CASE WHEN ending THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM r),
w AS (SELECT *, lag(text) OVER (PARTITION BY stream, part ORDER BY event_id) AS before FROM i),
e AS (SELECT stream, event_id, id, text, CASE WHEN ending THEN 'Final' ELSE 'Partial' END AS status, part FROM w WHERE ending AND text != '' OR NOT ending AND text != '' AND text IS DISTINCT FROM before),
l AS (SELECT stream, arg_max(event_id, event_id) AS event_id, arg_max(id, event_id) AS id, arg_max(text, event_id) AS text FROM e WHERE status = 'Partial' AND part = (SELECT max(part) FROM w x WHERE x.stream = e.stream) AND NOT EXISTS (SELECT 1 FROM w x WHERE x.stream = e.stream AND x.part = e.part AND x.ending) GROUP BY stream)
SELECT stream, event_id, CAST(id AS BIGINT) AS id, text, status FROM e UNION ALL SELECT stream, event_id, CAST(id AS BIGINT), text, 'Final' FROM l""",
    "downmix": "SELECT vec_id, list_transform(range(0, CAST(ceil(len(embedding) / 2.0) AS BIGINT)), lambda g: round(list_avg(CAST(embedding[g * 2 + 1 : g * 2 + 2] AS DOUBLE[])), 6) + 0.0) AS mono FROM embeddings",
    "rms_gate": """WITH p AS (SELECT vec_id, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding)) >= 0.125 AS speech, list_transform(range(0, CAST(ceil(len(embedding) / 8.0) AS BIGINT)), lambda i: list_avg(list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE))) AS power FROM embeddings)
SELECT vec_id, speech, CASE WHEN list_max(power) > 1e-6 THEN round(sqrt(list_avg(list_filter(power, lambda q: q >= list_max(power) * 3.16e-3))), 6) END AS level FROM p""",
    "apply_gain": """WITH p AS (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding)) AS rms, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS top FROM embeddings),
g AS (SELECT *, CASE WHEN top * least(0.4 / rms, 10.0) > 0.891 THEN 0.891 / top ELSE least(0.4 / rms, 10.0) END AS gain FROM p)
SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * gain, 6) + 0.0) AS loud FROM g""",
    "audio_frames": "SELECT vec_id, i * 100 AS timestamp_ms, len(embedding[i * 10 + 1 : i * 10 + 10]) AS n FROM (SELECT vec_id, embedding, unnest(range(0, CAST(ceil(len(embedding) / 10.0) AS BIGINT))) AS i FROM embeddings)",
    "props_params": "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 7) AS k, coalesce(try_cast(json_extract_string(props, '$.limit') AS DOUBLE), 0.5) AS \"limit\", coalesce(json_extract_string(props, '$.mode'), 'auto') AS mode FROM events",
    "catalog_sizes": "SELECT id, len(files) AS n_files, coalesce(list_sum(list_transform(files, lambda f: f.size_bytes)), 0)::BIGINT AS size_bytes, len(languages) AS n_languages FROM model_catalog",
    "catalog_by_language": "WITH d AS (SELECT id, unnest(languages) AS lang, coalesce(list_sum(list_transform(files, lambda f: f.size_bytes)), 0) AS size FROM model_catalog) SELECT lang, count(*) AS models, arg_min(id, struct_pack(s := size, i := id)) AS smallest FROM d GROUP BY lang",
    "document_answers": f"""WITH RECURSIVE {LINES}, n AS (SELECT doc_id, count(*) AS n, string_agg('=== Part ' || (chunk + 1) || '/' || m || ' ===' || chr(10) || 'length ' || length(text), chr(10) || chr(10) ORDER BY chunk) AS joined, max(length(text)) AS one FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS m FROM c4) GROUP BY doc_id)
SELECT doc_id, 'length ' || CASE WHEN n > 1 THEN length(joined) ELSE one END AS answer FROM n""",
    "title_slugs": r"SELECT concat_ws(' ', title, id) AS name, regexp_replace(regexp_replace(lower(concat_ws(' ', title, id)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM meeting",
    "resample_linear": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 16::DOUBLE / 48 AS r FROM embeddings),
x AS (SELECT vec_id, v, list_transform(range(CAST(round(len(v) * r) AS BIGINT)), lambda i: i / r) AS xs FROM e)
SELECT vec_id, list_transform(xs, lambda q: round(v[CAST(least(floor(q), len(v) - 1) AS BIGINT) + 1] + (v[CAST(least(least(floor(q), len(v) - 1) + 1, len(v) - 1) AS BIGINT) + 1] - v[CAST(least(floor(q), len(v) - 1) AS BIGINT) + 1]) * (q - floor(q)), 6) + 0.0) AS thin FROM x""",
    "diarized_index": r"""WITH r AS (SELECT meeting_id || '#' || (id // 20) AS k, seq, start_ms, end_ms, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, speaker FROM live_segment WHERE status = 'Final' AND regexp_matches(text, '[^\s\p{Z}]')),
f AS (SELECT *, CASE WHEN speaker IS NOT NULL THEN min(seq) OVER (PARTITION BY k, speaker) END AS first FROM r)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY seq) - 1 AS id, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms, CASE WHEN speaker IS NOT NULL THEN dense_rank() OVER (PARTITION BY k ORDER BY first NULLS LAST) - 1 END AS speaker, text FROM f""",
    "split_by_speaker": r"""WITH l AS (SELECT * FROM live_segment WHERE status = 'Final'),
w AS (SELECT meeting_id, id AS seg, CAST(speaker AS BIGINT) AS own, words, unnest(range(len(words))) AS pos FROM l WHERE len(words) > 0),
t AS (SELECT meeting_id, seg, own, pos, words[pos + 1].text AS text, words[pos + 1].start_ms AS s, words[pos + 1].end_ms AS e FROM w),
o AS (SELECT t.meeting_id, t.seg, t.pos, p.speaker, sum(least(t.e, p.end_ms) - greatest(t.s, p.start_ms)) AS total FROM t JOIN speaker_span p ON p.meeting_id = t.meeting_id AND p.start_ms < t.e AND t.s < p.end_ms AND t.e > t.s AND p.end_ms > p.start_ms WHERE p.speaker IS NOT NULL GROUP BY ALL),
b AS (SELECT meeting_id, seg, pos, CAST(arg_max(speaker, total * 100000 + speaker) AS BIGINT) AS speaker FROM o GROUP BY ALL),
d AS (SELECT t.*, b.speaker FROM t LEFT JOIN b USING (meeting_id, seg, pos)),
c AS (SELECT *, CASE WHEN pos > 0 AND speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY meeting_id, seg ORDER BY pos) THEN 1 ELSE 0 END AS change FROM d),
r AS (SELECT *, sum(change) OVER (PARTITION BY meeting_id, seg ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM c),
m AS (SELECT *, max(part) OVER (PARTITION BY meeting_id, seg) AS parts FROM r),
g AS (SELECT meeting_id, seg, part, any_value(parts) AS parts, min(s) AS s, max(e) AS e, max(speaker) AS speaker, any_value(own) AS own, regexp_replace(string_agg(text, '' ORDER BY pos), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM m GROUP BY meeting_id, seg, part),
q AS (SELECT l.meeting_id, l.id, l.start_ms, l.end_ms, l.text, l.speaker, sum(least(l.end_ms, p.end_ms) - greatest(l.start_ms, p.start_ms)) AS total, p.speaker AS s2 FROM l JOIN speaker_span p ON p.meeting_id = l.meeting_id AND p.start_ms < l.end_ms AND l.start_ms < p.end_ms AND p.end_ms > p.start_ms AND l.end_ms > l.start_ms WHERE p.speaker IS NOT NULL GROUP BY ALL),
z AS (SELECT meeting_id, id, CAST(arg_max(s2, total * 100000 + s2) AS BIGINT) AS best FROM q GROUP BY ALL)
SELECT g.meeting_id, g.seg, CAST(part AS BIGINT) AS part, CASE WHEN parts = 0 THEN l.start_ms ELSE g.s END AS start_ms, CASE WHEN parts = 0 THEN l.end_ms ELSE g.e END AS end_ms, CASE WHEN parts = 0 THEN coalesce(g.speaker, own) ELSE g.speaker END AS speaker, CASE WHEN parts = 0 THEN l.text ELSE g.text END AS text FROM g JOIN l ON l.meeting_id = g.meeting_id AND l.id = g.seg
UNION ALL SELECT l.meeting_id, l.id, 0, l.start_ms, l.end_ms, coalesce(z.best, CAST(l.speaker AS BIGINT)), l.text FROM l LEFT JOIN z ON z.meeting_id = l.meeting_id AND z.id = l.id WHERE l.words IS NULL OR len(l.words) = 0""",
}
