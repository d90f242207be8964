"""Stream operators over stored changelogs: the results that the streaming forms reach once all rows are in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import echo_key, similarity, utrim
from murmura.operators.shape import stream_fold
from murmura.streaming import folds
from murmura.streaming.folds import Fold

#: Echoes: letters and digits at least, time window, likeness (fixed values).
ECHO_CHARS, ECHO_MS, ECHO_LIKE = 6, 5000, 0.8


def is_speech(samples: Column, threshold: float = 0.01) -> Column:
    """Root mean square at least the threshold; an empty frame is none."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples)) >= threshold).otherwise(False)


def utterances(frames: DataFrame, key: str, order: str, speech: str, duration: str, start: str, hangover_ms: int = 700) -> DataFrame:
    """(key, utterance, start, n_frames, speech_ms): speech frames between silences of ``hangover_ms`` or more in sum.

    Silence adds up over frames since the last speech frame, not over the clock; silent frames are not stored.
    """
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    d = frames.withColumn("__quiet", F.sum(F.when(F.col(speech), 0).otherwise(F.col(duration))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.filter(F.col(speech)).withColumn("__before", F.lag("__quiet").over(w))
    d = d.withColumn("__opens", F.when(F.col("__before").isNull() | (F.col("__quiet") - F.col("__before") >= hangover_ms), 1).otherwise(0))
    d = d.withColumn("utterance", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.groupBy(key, "utterance").agg(F.min_by(start, order).alias("start"), F.count("*").alias("n_frames"), F.sum(duration).alias("speech_ms"))


def coalesce_burst(jobs: DataFrame, burst: list[str]) -> DataFrame:
    """Of each burst all finals, and of each id the newest partial that no final of the id follows."""
    w = Window.partitionBy(*burst, "id")
    d = jobs.withColumn("__final", F.max(F.when(F.col("status") == "Final", F.col("seq"))).over(w)).withColumn("__partial", F.max(F.when(F.col("status") == "Partial", F.col("seq"))).over(w))
    keep = (F.col("status") == "Final") | ((F.col("seq") == F.col("__partial")) & (F.col("__final").isNull() | (F.col("__partial") > F.col("__final"))))
    return d.filter(keep).drop("__final", "__partial")


def upsert_latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The latest row of each key; equal sequence numbers go by the whole row."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(seq, *[c for c in others if c != seq])).alias("r")).select(*keys, "r.*")


def partial_target(decode_ms: Column) -> Column:
    """Speech to gather before the next partial: the last decode's time within 300 and 1500 ms; 500 before the first."""
    return F.coalesce(F.greatest(F.lit(300), F.least(F.lit(1500), decode_ms)), F.lit(500))


def cap_partial(samples: Column, start_ms: Column, rate: int = 16_000, window_ms: int = 8000) -> Column:
    """Struct of the trailing window of samples and its start."""
    most = rate * window_ms // 1000
    extra = F.greatest(F.size(samples) - most, F.lit(0))
    return F.struct(F.slice(samples, extra + 1, most).alias("samples"), (start_ms + (extra * 1000 / rate).cast("bigint")).alias("start_ms"))


def replay(fold: Fold, rows: DataFrame, key: str, order: str, **columns: str) -> DataFrame:
    """A fold over stored rows in order; ``columns`` names the input column of a value where it differs."""
    d = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), *[F.col(columns.get(v, v)).alias(v) for v in fold.values])
    kinds = dict(d.dtypes)
    out = stream_fold(d, ["k"], ["o"], f"k {kinds['k']}, " + fold.result.format(order=kinds["o"]), fold.begin, fold.step, fold.finish)
    return out.withColumnRenamed("k", key).withColumnRenamed("o", order)


def streaming_ids(results: DataFrame, key: str, order: str) -> DataFrame:
    """:func:`folds.streaming_ids` over decoder results (text, is_endpoint)."""
    return replay(folds.streaming_ids(), results, key, order)


def drop_echoes(rows: DataFrame, key: str = "meeting_id", seq: str = "seq") -> DataFrame:
    """Rows (text, source, status, end_ms) without microphone rows that repeat what the system just said.

    A final system row of enough letters is remembered; a microphone row of enough letters is dropped if an earlier
    remembered one is alike and its latest end so far is at most the window before the latest end of all rows so far.
    """
    w = Window.partitionBy(key).orderBy(seq)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("__key", echo_key(F.col("text"))).withColumn("__now", F.max("end_ms").over(upto))
    heard = (F.col("source") == "system") & (F.col("status") == "Final") & (F.char_length("__key") >= ECHO_CHARS)
    d = d.withColumn("__pm", F.when(heard, F.max(F.when(heard, F.col("end_ms"))).over(upto)))
    said = d.filter(heard).select(F.col(key).alias("k2"), F.col(seq).alias("q2"), F.col("__key").alias("t2"), F.col("__pm").alias("pm"))
    mic = d.filter((F.col("source") == "mic") & (F.char_length("__key") >= ECHO_CHARS)).select(F.col(key).alias("k1"), F.col(seq).alias("q1"), F.col("__key").alias("t1"), F.col("__now").alias("now"))
    # pm and now never fall with seq, so rows meet within two neighbouring windows of the latest end
    said = said.withColumn("b", F.explode(F.array(F.expr(f"pm div {ECHO_MS}"), F.expr(f"pm div {ECHO_MS} + 1"))))
    mic = mic.withColumn("b1", F.expr(f"now div {ECHO_MS}"))
    near = mic.join(said, (F.col("k1") == F.col("k2")) & (F.col("b1") == F.col("b")) & (F.col("q2") < F.col("q1")) & (F.col("pm") + ECHO_MS >= F.col("now")))
    likely = F.abs(F.char_length("t1") - F.char_length("t2")) <= (1 - ECHO_LIKE) * F.greatest(F.char_length("t1"), F.char_length("t2"))
    echo = near.filter(likely).filter(similarity(F.col("t1"), F.col("t2")) >= ECHO_LIKE).select(F.col("k1").alias(key), F.col("q1").alias(seq)).distinct()
    return rows.join(echo, [key, seq], "left_anti").select(*rows.columns)


def online_clusters(vectors: DataFrame, key: str, order: str, vector: str, reliable: str, threshold: float = 0.5) -> DataFrame:
    """:func:`folds.online_clusters`; the order decides, so a key is one stream."""
    return replay(folds.online_clusters(threshold), vectors, key, order, vector=vector, reliable=reliable)


def changed_only(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null equals null); of errors and successes, the first of each run."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("__same", ~first & F.col(value).eqNullSafe(F.lag(value).over(w))).filter(~F.col("__same")).drop("__same")


def emissions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, status, text) of polls (final, volatile): a final if there is one, else the volatile text if it is new, else nothing.

    New is what was not the last volatile text emitted since the last final. Empty and null texts are nothing.
    """
    final, volatile = F.coalesce("final", F.lit("")), F.coalesce("volatile", F.lit(""))
    w = Window.partitionBy(key).orderBy(order)
    d = rows.withColumn("__part", F.coalesce(F.sum(F.when(final != "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    shown = F.when((final == "") & (volatile != ""), volatile)
    before = F.last(shown, ignorenulls=True).over(Window.partitionBy(key, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__before", before)
    status = F.when(final != "", "Final").when(shown.isNotNull() & ~shown.eqNullSafe(F.col("__before")), "Partial")
    return d.select(key, order, status.alias("status"), F.when(final != "", final).otherwise(volatile).alias("text")).filter("status IS NOT NULL")


def last_rows(rows: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """What a bounded queue that drops the oldest still holds: the last ``capacity`` rows of each stream."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__n") <= capacity).drop("__n")


def mute(samples: Column, muted: Column) -> Column:
    """Zero samples while muted; frames still flow."""
    return F.when(muted, F.transform(samples, lambda x: F.lit(0.0).cast("float"))).otherwise(samples)


def accumulate(events: DataFrame, key: str, order: str, kind: str = "transcription") -> DataFrame:
    """:func:`folds.accumulate` over engine events (kind, text, at_ms) of sessions of one kind."""
    return replay(folds.accumulate(kind), events, key, order)


def capture_jobs(frames: DataFrame, session: str, stream: str, order: str, window_ms: int = 8000) -> DataFrame:
    """(session, stream, order, id, status, start_ms, length_ms): :func:`folds.capture` of every stream.

    The ids of a session's streams come from one count, in the order in which their utterances' first jobs are sent
    (by ``order``, then stream; those that the end closes come last): one row an utterance passes the window that numbers them.
    """
    d = frames.withColumn("__key", F.struct(F.col(session).alias("session"), F.col(stream).alias("stream")))
    jobs = replay(folds.capture(window_ms), d, "__key", order)
    first = jobs.groupBy("__key", "id").agg(F.min(F.struct("flushed", F.col(order).alias("o"))).alias("__first"))
    n = F.row_number().over(Window.partitionBy("__key.session").orderBy("__first", "__key.stream", "id")) - 1
    numbered = first.select("__key", "id", n.cast("bigint").alias("__id"))
    out = jobs.join(numbered, ["__key", "id"])
    return out.select(F.col("__key.session").alias(session), F.col("__key.stream").alias(stream), order, F.col("__id").alias("id"), "status", "start_ms", "length_ms")


def dictation(segments: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): what :func:`folds.dictation` has at the end of each key's segments (text, status): a row holds a key's text."""
    said = F.when(F.col("status") == "Final", utrim(F.coalesce("text", F.lit(""))))
    last = F.max(F.struct(order, F.col("status").alias("s"), utrim(F.coalesce("text", F.lit(""))).alias("t")))
    d = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.when(said != "", F.struct(F.col(order).alias("o"), said.alias("t"))))).alias("done"), last.alias("last"))
    pieces = F.concat(F.transform("done", lambda x: x.t), F.when((F.col("last.s") != "Final") & (F.col("last.t") != ""), F.array("last.t")).otherwise(F.array().cast("array<string>")))
    spaced = F.transform(pieces, lambda t, i: F.when((i > 0) & t.rlike("^[A-Za-z0-9]"), F.concat(F.lit(" "), t)).otherwise(t))
    return d.select(key, F.array_join(spaced, "").alias("text"))


def locked_language(utterances: DataFrame, key: str, order: str, auto: Column, text: Column, detected: Column) -> DataFrame:
    """``utterances`` with ``language``: where the user left it open, the first detected language of an utterance with text, from then on."""
    good = F.when(auto & (F.coalesce(text, F.lit("")) != "") & (detected != "") & (detected != "auto"), detected)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return utterances.withColumn("language", F.first(good, ignorenulls=True).over(w))


def mixed_streams(frames: DataFrame, key: str, order: str, cap: int = 12_000) -> DataFrame:
    """(key, order, mixed, share): :func:`folds.jitter_buffer`, then :func:`folds.mixer`, of frames (side, samples) in order."""
    pairs = replay(folds.jitter_buffer(cap), frames, key, order)
    return replay(folds.mixer(), pairs, key, order)


def assist_triggers(rows: DataFrame, key: str, order: str, at: str, speech: str, manual: str, every_ms: int = 15_000) -> DataFrame:
    """:func:`folds.assist_triggers`."""
    return replay(folds.assist_triggers(every_ms), rows, key, order, at=at, speech=speech, manual=manual)
