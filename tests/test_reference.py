"""Behaviour that operators share with the engine they replace: its vectors, and sequential versions of its state machines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions.text import utrim
from murmura.operators import assist, clips, models, render, shape, signal, speakers, store, wire
from murmura.sources import registry
from murmura.streaming import batch, folds, live


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


# --- messages


@pytest.mark.parametrize(
    ("session", "message", "want"),
    [
        ("transcription", '{"type":"conversation.item.input_audio_transcription.delta","delta":"he"}', ("Delta", "he")),
        ("transcription", '{"type":"conversation.item.input_audio_transcription.completed","transcript":"hello."}', ("Completed", "hello.")),
        ("transcription", '{"type":"conversation.item.input_audio_transcription.failed","error":{"message":"no"}}', ("Failed", "no")),
        ("model", '{"type":"response.output_text.delta","delta":"x"}', ("AuxDelta", "x")),
        ("model", '{"type":"response.output_text.done","text":"xy"}', ("AuxDone", "xy")),
        ("assist", '{"type":"response.output_text.delta","delta":"x"}', ("Delta", "x")),
        ("assist", '{"type":"response.output_text.done","text":"xy"}', ("Completed", "xy")),
        ("translation", '{"type":"session.output_transcript.delta","delta":"a"}', ("Delta", "a")),
        ("translation", '{"type":"session.input_transcript.delta","delta":"b"}', ("AuxDelta", "b")),
        ("translation", '{"type":"session.output_audio.delta","delta":"AAAA"}', ("Other", "")),
        ("model", '{"type":"response.audio_transcript.delta","delta":"x"}', ("Other", "")),
        ("model", '{"type":"error","error":{"message":"quota"}}', ("Error", "quota")),
        ("model", '{"type":"error"}', ("Error", "")),
        ("model", "no json", ("Other", "")),
        ("model", None, ("Other", "")),
    ],
)
def test_server_events(spark, session, message, want):
    assert tuple(one(spark, wire.server_event(F.lit(message).cast("string"), session))) == want


def test_other_services(spark):
    of = lambda f, m: tuple(one(spark, f(F.lit(m))))
    assert of(wire.transcript_event, '{"message":"AddTranscript","metadata":{"transcript":"hi "}}') == ("Delta", "hi ")
    assert of(wire.transcript_event, '{"message":"AddTranscript"}') == ("Delta", "")
    assert of(wire.transcript_event, '{"message":"Error","type":"quota","reason":""}') == ("Error", "quota")
    assert of(wire.transcript_event, '{"message":"EndOfTranscript"}') == of(wire.transcript_event, "x") == ("Other", "")
    assert of(wire.content_event, '{"serverContent":{"inputTranscription":{"text":"hola"},"modelTurn":{}}}') == ("Delta", "hola")
    assert of(wire.content_event, '{"error":{"message":"bad"}}') == ("Error", "bad")
    assert of(wire.content_event, '{"serverContent":{"modelTurn":{}}}') == ("Other", "")
    assert one(spark, wire.hint_language(F.lit("yue"))) == "Cantonese" and one(spark, wire.hint_language(F.lit("xx"))) is None


def test_parameters(spark):
    m = lambda **d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    assert one(spark, wire.changed_params(m(a="1", b="2", c="3"), m(a="1", b="9"))) == {"b": "2", "c": "3"}
    base = F.struct(F.lit(5.0).alias("temperature"), F.lit(-1.0).alias("top_p"), F.lit(None).cast("double").alias("frequency_penalty"), F.lit(-9.0).alias("presence_penalty"), F.lit(0).alias("max_tokens"), F.lit(8000).alias("context_tokens"), F.lit("  be brief ").alias("system_prompt"))
    r = spark.range(1).select(wire.assist_params(base).alias("p"))
    assert tuple(r.first().p) == (2.0, 0.0, None, -2.0, None, 8000, "be brief")
    over = lambda **d: tuple(r.select(wire.overlay_params(F.col("p"), m(**d)).alias("x")).first().x)
    assert over(temperature="0.5", max_tokens="0", top_p="7") == (0.5, 1.0, None, -2.0, None, 8000, "be brief")
    assert over(max_tokens="64", frequency_penalty="x")[2:5] == (0.0, -2.0, 64)
    e = one(spark, wire.endpoint(F.lit(" n "), F.lit("https://h/v1//"), F.lit("other"), F.lit("m")))
    assert tuple(e) == ("n", "https://h/v1", "openai", "m", None)
    assert "http" in one(spark, wire.endpoint(F.lit("n"), F.lit("ftp://h"), F.lit("chat"), F.lit("m"))).error and one(spark, wire.endpoint(F.lit(""), F.lit("x"), F.lit("chat"), F.lit("m"))).error
    for file, want in (("ggml-small-q5_1.bin", "ggml-small"), ("ggml-large-v3.bin", "ggml-large-v3"), ("m-q8_0", "m"), ("a-q10_1.bin", "a-q10_1")):
        assert one(spark, wire.encoder_dir(F.lit(file))) == want + "-encoder.mlmodelc"
    assert one(spark, wire.memory_bytes(F.lit("MemFree: 1 kB\nMemTotal:       16384 kB\n"))) == 16384 * 1024 and one(spark, wire.memory_bytes(F.lit("MemTotal: x kB"))) is None


# --- accumulated texts


def accumulated(spark, kind, *events):
    rows = [("s", i, *e) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "k string, o int, kind string, text string, at_ms bigint")
    return [(r.text, r.aux_text) for r in batch.accumulate(df, "k", "o", kind).orderBy("n").collect()]


def test_accumulated_texts(spark):
    get = lambda *a: accumulated(spark, *a)
    assert get("transcription", ("Delta", "he", 0), ("AuxDelta", "x", 1), ("Completed", "hello.", 2)) == [("hello.", None)]
    assert get("transcription", ("Delta", "abc", 0), ("Error", None, 1), ("Delta", "def", 2), ("Completed", "", 3)) == [("abc", None)]
    assert get("assist", ("Delta", "a", 0), ("Delta", "b", 99_999), ("Completed", "ab", 100_000)) == [("ab", None)]
    assert get("translation", ("Delta", "hola", 0), ("Delta", " tu", 500), ("Other", None, 1600), ("Delta", "otra", 1700)) == [("hola tu", None), ("otra", None)]
    assert get("translation", ("Delta", "Bonjour", 0), ("AuxDelta", "Hello", 10)) == [("Bonjour", "Hello")]
    assert get("model", ("Delta", "你好", 0), ("AuxDelta", "Hel", 1), ("Completed", "你好。", 2), ("AuxDone", "Hello.", 3)) == [("你好。", "Hello.")]
    assert get("model", ("Completed", "你好。", 0), ("AuxDelta", "Hel", 10), ("Delta", "x", 2010)) == [("你好。", "Hel"), ("x", None)]
    assert get("model", ("Delta", "a", 0), ("Delta", "b", 9000)) == [("ab", None)]  # a pause with neither side done closes nothing
    assert get("model", ("Failed", "x", 0)) == []


def test_clusters_count_directions(spark):
    df = spark.createDataFrame([("s", i, v, True) for i, v in enumerate([[100.0, 0.0], [0.6, 0.8], [0.0, 1.0], None, []])], "k string, o int, v array<double>, r boolean")
    got = [r.speaker for r in batch.online_clusters(df, "k", "o", "v", "r", 0.5).orderBy("o").collect()]
    # (1, 0) and (0.6, 0.8) sum to (1.6, 0.8): (0, 1) is at 0.45 and opens a cluster; by raw sums it would be at 0.008
    assert got[:3] == [0, 0, 1] and len(got) == 5


# --- capture, dictation, summaries, mixing


def capture_by_hand(streams, decode_ms):
    """Frames in turn, one shared count of ids."""
    state = {s: {"open": None, "since": 0, "held": None} for s, _ in {(f[0], 0) for f in streams}}
    ids, out = 0, []
    for stream, o, utterance, opens, speech, closed in streams:
        s = state[stream]
        if utterance is not None:
            s["held"] = (opens, speech)
        if closed and s["held"]:
            if s["open"] is None:
                s["open"], ids = ids, ids + 1
            out.append((stream, o, s["open"], "Final", *s["held"]))
            s.update(open=None, since=0, held=None)
        s["since"] += 100
        if s["since"] >= min(1500, max(300, decode_ms)):
            s["since"] = 0
            if s["held"]:
                if s["open"] is None:
                    s["open"], ids = ids, ids + 1
                start, length = s["held"]
                cut = max(0, length - 800)
                out.append((stream, o, s["open"], "Partial", start + cut, length - cut))
    return out, state, ids


@pytest.mark.parametrize("seed", range(3))
def test_capture_shares_ids_over_streams(spark, seed):
    rnd = random.Random(seed)
    frames, state = [], {"mic": None, "system": None}
    for o in range(400):
        stream = rnd.choice(["mic", "system"])
        if rnd.random() < 0.85:
            cur = state[stream]
            state[stream] = (cur[0], cur[1] + 100) if cur else (o * 100, 100)
            frames.append((stream, o, 1, *state[stream], False))
        else:
            frames.append((stream, o, None, None, None, True))
            state[stream] = None
    want, _, _ = capture_by_hand(frames, 300)
    df = spark.createDataFrame([("m", *f[:2], f[2], f[3], f[4], 100, 300, f[5]) for f in frames], "session string, stream string, o bigint, utterance bigint, opens_ms bigint, speech_ms bigint, ms bigint, decode_ms bigint, closed boolean")
    rows = batch.capture_jobs(df, "session", "stream", "o", 800).orderBy("o").collect()
    got = [(r.stream, r.o, r.id, r.status, r.start_ms, r.length_ms) for r in rows]
    tail = [g for g in got if g not in want]
    assert [g for g in got if g in want] == want and len(tail) <= 2 and all(g[3] == "Final" for g in tail)
    finals = [g for g in got if g[3] == "Final"]
    assert len({g[2] for g in finals}) == len(finals)


def test_dictation(spark):
    rows = [("a", 0, " Hello ", "Partial"), ("a", 1, "Hello there", "Final"), ("a", 2, "你好", "Final"), ("a", 3, "and", "Partial"), ("a", 4, "and so", "Partial"), ("b", 0, " ", "Final"), ("c", 0, "x", "Partial"), ("c", 1, None, "Final")]
    df = spark.createDataFrame(rows, "k string, o int, text string, status string")
    want = {"a": "Hello there你好 and so", "b": "", "c": ""}
    assert {r.k: r.text for r in batch.dictation(df, "k", "o").collect()} == want
    fold = batch.replay(folds.dictation(), df, "k", "o").groupBy("k").agg(F.max_by("text", "o").alias("text"))
    assert {r.k: r.text for r in fold.collect()} == want


def test_rolling_summaries(spark):
    lines = [f"line {i} says something\n" for i in range(60)]
    rows = [("m", i, "".join(lines[: i + 1])) for i in range(60)] + [("m", 60, "".join(lines)), ("m", 61, "new\n"), ("m", 62, "new\nmore\n"), ("n", 0, " "), ("n", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, transcript string")
    tries = {"n": 0}

    def summarize(prior, text):
        tries["n"] += 1
        return None if tries["n"] % 3 == 0 else f"{prior}[{text.count(chr(10))}]"

    got = {(r.k, r.o): r.context for r in batch.replay(folds.rolling_summary(summarize, 200), df, "k", "o").collect()}
    assert ("m", 60) not in got and ("n", 0) not in got and got["m", 61] == "new\n" and got["m", 62] == "new\nmore\n"
    last = got["m", 59]
    head, recent = last.split("\n\nRecent conversation:\n")
    folded = sum(int(x) for x in head.rpartition("\n")[2].strip("[]").split("]["))
    assert folded + recent.count("\n") == 60 and len(recent) < 200 + 3 * 30


def test_jitter_buffer_and_mixer(spark):
    rows = [("s", 0, "second", [0.5] * 4), ("s", 1, "first", [0.0, 0.0]), ("s", 2, "second", [0.1] * 9), ("s", 3, "first", [0.0] * 3), ("s", 4, "first", None)]
    df = spark.createDataFrame(rows, "k string, o int, side string, samples array<double>")
    got = {r.o: (r.first, r.second) for r in batch.replay(folds.jitter_buffer(5), df, "k", "o").collect()}
    assert got == {1: ([0.0, 0.0], [0.5, 0.5]), 3: ([0.0] * 3, [0.1] * 3), 4: ([], [])}
    assert batch.mixed_streams(df, "k", "o", 5).count() == 3


def test_sticky_language(spark):
    rows = [("s", 0, "", "de"), ("s", 1, "hi", "auto"), ("s", 2, "hi", "en"), ("s", 3, "ja", "ja"), ("t", 0, None, "fr")]
    df = spark.createDataFrame(rows, "k string, o int, t string, d string")
    got = {(r.k, r.o): r.language for r in batch.locked_language(df, "k", "o", F.lit(True), F.col("t"), F.col("d")).collect()}
    assert got == {("s", 0): None, ("s", 1): None, ("s", 2): "en", ("s", 3): "en", ("t", 0): None}


# --- signals


def test_windows_tile_a_clip(spark):
    x = np.ones(10_000)
    x[2_960:3_400] = 0.0  # a pause near the first target
    bounds = signal.window_bounds(x, 3_000, 500)
    assert bounds[0] == (0, next(i for i in range(2_500, 3_501, 160) if not x[i : i + 320].any())) and bounds[-1][1] == 10_000
    assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    assert signal.window_bounds(np.ones(0), 10, 1) == [] and signal.window_bounds(np.ones(5), 0, 1) == [(0, 5)] and signal.window_bounds(np.ones(5), 5, 1) == [(0, 5)]
    # ties keep the earliest, and what is within a window and a radius stays whole
    assert signal.window_bounds(np.zeros(7_000), 3_000, 500) == [(0, 2_500), (2_500, 5_000), (5_000, 7_000)]


def test_streams_are_filtered_only_where_the_rate_falls(spark):
    t = np.arange(4_800) / 48_000
    tone = lambda hz: np.sin(2 * np.pi * hz * t)
    for hz, rate, keeps in ((12_000, 48_000, False), (1_000, 48_000, True)):
        parts = np.split(tone(hz), 10)
        df = spark.createDataFrame([("s", i, p.tolist(), rate) for i, p in enumerate(parts)], "k string, o int, x array<double>, r int")
        out = np.concatenate([r.x for r in signal.resample_stream(df, "k", "o", "x", "r").orderBy("o").collect()])
        assert len(out) == 1_600 and (np.abs(out[100:]).max() > 0.9) == keeps and (np.abs(out[100:]).max() < 0.05) == (not keeps)
    df = spark.createDataFrame([("s", 0, [0.0, 1.0], 8_000), ("s", 1, [0.5, 0.25], 16_000), ("s", 2, None, 0)], "k string, o int, x array<double>, r int")
    assert [r.x for r in signal.resample_stream(df, "k", "o", "x", "r").orderBy("o").collect()] == [[0.0, 0.5, 1.0, 1.0], [0.5, 0.25], []]


def test_levels(spark):
    rng = np.random.default_rng(1)
    quiet, loud = 0.01 * np.sin(np.arange(16_000) * 0.3), 0.8 * np.sin(np.arange(16_000) * 0.3)
    df = spark.createDataFrame([(0, quiet.tolist()), (1, (loud + 0.2).tolist()), (2, [0.3] * 800), (3, []), (4, None)], "k int, x array<double>")
    got = {r.k: r.y for r in df.select("k", signal.normalize("x", F.lit(16_000)).alias("y")).collect()}
    rms = lambda y: float(np.sqrt(np.mean(np.square(y))))
    assert abs(rms(got[0]) - 0.07) < 0.04 and max(map(abs, got[1])) <= 0.892 and abs(np.mean(got[1])) < 0.05
    assert got[3] == [] and got[4] is None and got[2][0] == 0
    x = rng.standard_normal(5_000)
    for rate in (16_000, 100, 2):
        a = (1 / (2 * np.pi * 70)) / (1 / (2 * np.pi * 70) + 1 / rate)
        y = [0.0]
        for i in range(1, len(x)):
            y.append(a * (y[-1] + x[i] - x[i - 1]))
        out = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(signal.high_pass("x", F.lit(rate)).alias("y")).first().y
        assert np.allclose(out, y, atol=1e-9)


def test_places_and_frames(spark):
    rnd = random.Random(1)
    for n in (0, 1, 63, 64, 65, 300):
        mask = [rnd.randrange(2) for _ in range(n)]
        df = spark.createDataFrame([(mask,)], "m array<int>")
        assert df.select(signal.position_ids(F.col("m")).alias("x")).first().x == [sum(mask[:i]) for i in range(n)]
    assert one(spark, signal.frame_count(F.array(*[F.lit(0.0)] * 7), F.lit(2))) == 3 and one(spark, signal.frame_ms(F.array(*[F.lit(0.0)] * 8), F.lit(2), F.lit(1000))) == 4


# --- files to transcripts


def test_file_transcript(spark):
    rate = 1_000
    x = np.zeros(6_000)
    x[1_000:2_000], x[4_000:5_500] = 0.5, 0.5
    df = spark.createDataFrame([("c", x.tolist()), ("quiet", [0.0] * 500), ("none", None)], "clip string, x array<double>")
    gated = {r.clip: r for r in clips.gated(df, "clip", "x", rate).collect()}
    assert set(gated) == {"c"} and len(gated["c"].samples) == 2_500 and [tuple(g) for g in gated["c"].gates] == [(0, 1_000, 1_000), (1_000, 4_000, 1_500)]
    got = clips.file_transcript(df, "clip", "x", models.Measured, rate=rate).collect()
    assert [(r.clip, r.id, r.text, r.start_ms, r.end_ms) for r in got] == [("c", 0, " 2500 ms", 1_000, 5_500)]
    spans = spark.createDataFrame([("c", 0, 0, 3_000), ("c", 1, 3_000, 9_000)], "meeting_id string, speaker int, start_ms bigint, end_ms bigint")
    cut = clips.file_transcript(df, "clip", "x", models.Measured, spans, rate).orderBy("id").collect()
    assert [(r.id, r.text.strip(), r.speaker) for r in cut] == [(0, "2500", 1), (1, "ms", 1)] or len(cut) in (1, 2)
    assert clips.file_transcript(df, "clip", "x", models.Measured, rate=rate, gate=False).filter("clip = 'c'").first().end_ms == 6_000
    assert clips.file_transcript(df.limit(0), "clip", "x", models.Measured, rate=rate).count() == 0


def test_utterances_to_segments(spark):
    rows = [("m", 0, [0.1] * 100, 5_000), ("m", 1, [0.1] * 50, 9_000), ("m", 2, [], 9_500)]
    df = spark.createDataFrame(rows, "k string, o int, x array<double>, at bigint").coalesce(1).sortWithinPartitions("o")
    canned = lambda: models.Canned([[("Hello.", 0, 40, []), (" ...", 40, 60, []), ("你好", 60, 90, [])], [("!?", 0, 50, [])], []])
    got = clips.sentences_of(df, "k", "o", "x", "at", canned, 100, models.OneSpeaker).orderBy("id").collect()
    assert [(r.id, r.text, r.start_ms, r.end_ms, r.speaker, r.status) for r in got] == [(0, "Hello.", 5_000, 5_040, 0, "Final"), (1, "你好", 5_060, 5_090, 0, "Final")]
    jobs = spark.createDataFrame([(7, "Partial", [0.1] * 100, 1_000), (8, "Final", [0.1] * 100, 2_000)], "id int, status string, x array<double>, at bigint").coalesce(1)
    canned = lambda: models.Canned([[("a", 5, 40, [("a", 5, 9)]), (" b", 40, 60, [])], [("c", 0, 10, [])]])
    got = {r.id: r for r in clips.lines_of(jobs, ["id", "status"], "x", "at", canned, 100, models.OneSpeaker).collect()}
    assert (got[7].text, got[7].start_ms, got[7].end_ms, got[7].speaker) == ("a b", 1_005, 1_060, None) and got[8].speaker == 0 and got[7].words[0].start_ms == 1_005
    same = models.Unchanged()
    assert same.denoise(np.ones(3), 1).tolist() == [1, 1, 1] and same.samples == 3


def test_times_go_back_to_the_clip(spark):
    gates = spark.createDataFrame([("a", 0, 1000, 500), ("a", 500, 3000, 500)], "k string, compressed_ms bigint, original_ms bigint, duration_ms bigint")
    seg = spark.createDataFrame([("a", 100, 900, [("w", 100, 500), ("v", 500, 900)]), ("b", 300, 900, [("w", 300, 900)]), ("a", None, 500, None)], "k string, start_ms bigint, end_ms bigint, words array<struct<text:string,start_ms:bigint,end_ms:bigint>>")
    got = {(r.k, r.end_ms): r for r in speakers.remap_segments(seg, gates, "k").collect()}
    assert got["a", 3400].start_ms == 1100 and [tuple(w) for w in got["a", 3400].words] == [("w", 1100, 1500), ("v", 3000, 3400)]
    assert got["b", 900].start_ms == 300 and got["a", 1500].start_ms is None
    points = spark.createDataFrame([("a", i) for i in (0, 0, 250, 500, 2000)] + [("z", 7), (None, 5), ("a", None)], "k string, t bigint")
    back = sorted(((r.k or "", r.t if r.t is not None else -1, r.original_ms) for r in speakers.to_original(points.repartition(3), gates, "k", "t").collect()), key=str)
    assert back == sorted([("a", 0, 1000), ("a", 0, 1000), ("a", 250, 1250), ("a", 500, 3000), ("a", 2000, 3500), ("z", 7, 7), ("", 5, 5), ("a", -1, None)], key=str)


def test_context_skips_any_number_of_blank_rows(spark):
    rows = [("m", 0, "keep me")] + [("m", i, " " if i % 2 else None) for i in range(1, 130)] + [("m", 130, "x" * 300), ("m", 131, "end")]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    got = {r.o: r.context for r in shape.rolling_context(df, "k", "o", "t").collect()}
    assert got[0] == "" and got[129] == got[130] == "keep me" and got[131] == "x" * 224
    many = spark.createDataFrame([("m", i, "a") for i in range(300)], "k string, o int, t string")
    assert {r.o: r.context for r in shape.rolling_context(many, "k", "o", "t").collect()}[299] == ("a " * 299).strip()[-224:]


# --- documents, registries, the store


def test_documents(spark, tmp_path):
    rows = [("m", 2000, 3000, 1, "system", " second ", 1, [(" second", 2000, 2500)]), ("m", 0, 1000, None, "mic", "first", 0, None), ("m", 5000, 6000, 0, "mic", "  ", 2, None), ("n", 0, 10, 0, "file", "only", 0, [])]
    seg = spark.createDataFrame(rows, "meeting_id string, start_ms bigint, end_ms bigint, speaker bigint, source string, text string, idx int, words array<struct<text:string,start_ms:bigint,end_ms:bigint>>")
    get = lambda f: {r.meeting_id: r.document for r in render.documents(seg, f).collect()}
    assert get("SRT")["m"] == "1\n00:00:00,000 --> 00:00:01,000\nfirst\n\n2\n00:00:02,000 --> 00:00:03,000\nSpeaker 2: second\n\n"
    assert get("vtt")["m"] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nfirst\n\n00:00:02.000 --> 00:00:03.000\nSpeaker 2: <00:00:02.000>second\n\n"
    assert get("text")["n"] == "Speaker 1: only\n" and "only" in get("md")["n"] and get("md")["n"].startswith("---\n")
    with pytest.raises(ValueError, match="unknown format"):
        render.documents(seg, "pdf")
    docs = render.documents(seg, "srt")
    assert render.export(docs, str(tmp_path / "out"), "srt") == 2
    (file,) = (tmp_path / "out" / "meeting_id=m").glob("*.txt")
    assert file.read_text() == get("srt")["m"]
    with pytest.raises(ValueError, match="nothing to export"):
        render.export(docs.limit(0), str(tmp_path / "none"), "srt")


def test_registries(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("size", T.LongType())])
    path = tmp_path / "registry.json"
    assert registry.read_registry(spark, str(path), schema).count() == 0
    path.write_text("not json")
    assert registry.read_registry(spark, str(path), schema).count() == 0
    df = spark.createDataFrame([("a", 1), ("b", None)], schema)
    for _ in range(2):
        registry.write_registry(df, str(path))
    assert sorted(tuple(r) for r in registry.read_registry(spark, str(path), schema).collect()) == [("a", 1), ("b", None)]
    both = registry.with_custom(df, spark.createDataFrame([("b", 9), ("c", 3)], schema))
    assert {r.id: r["size"] for r in both.collect()} == {"a": 1, "b": None, "c": 3}
    cat = spark.createDataFrame([("a", [("x",), ("y",)]), ("b", [("z",)]), ("c", [])], "id string, files array<struct<name:string>>")
    there = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "z")], "id string, name string")
    assert {r.id: r.installed for r in registry.installed(cat, there).collect()} == {"a": False, "b": True, "c": True}
    assert registry.search_mode(None) == registry.search_mode("x") == "fulltext" and registry.search_mode(" hybrid\n") == "hybrid"
    with pytest.raises(ValueError):
        registry.set_search_mode("other")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "abc.bin").write_bytes(b"abc")
    sums = registry.checksums(spark, str(tmp_path / "m"))
    want = "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"
    assert {r.name: r.ok for r in registry.verified(sums, spark.createDataFrame([("abc.bin", want), ("no.bin", want)], "name string, sha256 string")).collect()} == {"abc.bin": True, "no.bin": False}


def test_a_store_without_its_pointer_is_not_emptied(spark, tmp_path):
    root = tmp_path / "lib"
    s = store.NoteStore(spark, str(root))
    meta = spark.createDataFrame([("n", "t", 1, "en", "e", None)], "id string, title string, started_at_ms bigint, language string, engine string, summary string")
    seg = spark.createDataFrame([("n", 0, 0, 10, 1, "mic", "hello", "Final")], "meeting_id string, seq bigint, start_ms bigint, end_ms bigint, speaker bigint, source string, text string, status string")
    for _ in range(store.KEEP + 3):
        s.save(meta, seg)
    pointers = sorted(p.name for p in root.iterdir() if p.name.startswith("current-"))
    assert len(pointers) == store.KEEP + 1 and len([p for p in root.iterdir() if p.name.startswith("segment-")]) <= store.KEEP + 1
    assert store.NoteStore(spark, str(root)).count() == 1 and store.notes(s.table("meeting")).count() == 1
    (root / pointers[-1]).unlink()  # a lost newest pointer leaves the version before
    assert store.NoteStore(spark, str(root)).count() == 1
    (root / "_next-crash").write_text("meeting\tnowhere\n")  # a write that never finished
    assert store.NoteStore(spark, str(root)).count() == 1
    for p in pointers[:-1]:
        (root / p).unlink()
    with pytest.raises(RuntimeError, match="no pointer"):
        store.NoteStore(spark, str(root))


def test_slugs_are_unique_over_bases(spark):
    names = spark.createDataFrame([("Asia",), ("asia",), ("Asia 2",), ("asia-2",), ("Asia!",), ("",)], "n string")
    got = [r.slug for r in assist.unique_slugs(names, "n", spark.createDataFrame([("asia-3",), (None,)], "s string")).collect()]
    assert len(got) == len(set(got)) == 6 and {"asia", "asia-2", "item"} <= set(got) and "asia-3" not in got
    assert [r.slug for r in assist.unique_slugs(names.limit(1), "n", names.limit(0), "custom-").collect()] == ["custom-asia"]


def test_map_reduce_has_an_instruction_for_the_parts(spark):
    df = spark.createDataFrame([("a", "one\ntwo\nthree"), ("b", "one")], "k string, t string")
    ask = lambda system: lambda text: F.concat(F.lit(" <"), system, F.lit("|"), text, F.lit("> "))
    got = {r.k: r.answer for r in assist.map_reduce(df, "k", "t", 7, ask(F.lit("sum up")), ask(assist.reduce_instruction(F.lit("sum up")))).collect()}
    assert got["b"] == " <sum up|one> "
    assert got["a"] == f" <{assist.REDUCE}sum up|=== Part 1/2 ===\n<sum up|one\ntwo>\n\n=== Part 2/2 ===\n<sum up|three>> "


def test_retained_batches_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([("m", "a", "Final"), ("m", "b", "Partial")], "meeting_id string, text string, status string")
    sink = live.retain(str(tmp_path / "t"))
    for number in (0, 1, 1):
        sink(df, number)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert one(spark, utrim(F.lit(" x "))) == "x"


def test_small_rules(spark):
    assert one(spark, wire.retry_delay_ms(F.lit(429), F.lit(" 7 "), F.lit(1))) == 7_000 and one(spark, wire.retry_delay_ms(F.lit(None).cast("int"), F.lit("9"), F.lit(3))) == 2_000
    assert one(spark, wire.retry_delay_ms(F.lit(503), F.lit("x"), F.lit(60))) == 30_000 and one(spark, wire.retry_delay_ms(F.lit(401), F.lit("1"), F.lit(1))) is None
    assert [one(spark, wire.worker_threads(F.lit(o), F.lit(c))) for o, c in ((" 6 ", 2), ("0", 4), ("x", 0))] == [6, 4, 1]
    assert one(spark, wire.is_asr(F.lit("WhisperCpp"))) and not one(spark, wire.is_asr(F.lit("Denoise")))
    assert one(spark, wire.text_result(F.lit(""), F.lit(5))) is None and one(spark, wire.text_result(F.lit("a"), F.lit(8_000))).end_ms == 500
    assert "language is \"de\". Context for spelling names and terms: Ann" in one(spark, assist.transcribe_prompt(F.lit("de"), F.lit(" Ann "))) and one(spark, assist.transcribe_prompt(F.lit(""), F.lit(" "))).endswith("marks.")
    p = one(spark, wire.typed_params(F.lit('{"a":"7","b":2,"c":true,"d":"x","e":1}'), {"a": ("int", 1), "b": ("float", 0.0), "c": ("bool", False), "d": ("text", ""), "e": ("text", "none"), "f": ("int", 3)}))
    assert tuple(p) == (1, 2.0, True, "x", "none", 3)
    assert tuple(one(spark, wire.typed_params(F.lit("no json"), {"a": ("int", 1)}))) == (1,)
    planes = F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(9.0)), F.array(F.lit(0.0), F.lit(1.0)))
    assert one(spark, signal.planar_mono(planes)) == [0.5, 0.5] and one(spark, signal.planar_mono(F.array().cast("array<array<double>>"))) == []
    raw = spark.createDataFrame([(bytearray(np.array([0.5, -1.0], "<f4").tobytes() + b"x"), 32), (bytearray(np.array([16384], "<i2").tobytes()), 16), (bytearray(b"abc"), 24), (None, 16)], "b binary, n int")
    assert [r.x for r in raw.select(signal.pcm_samples("b", "n").alias("x")).collect()] == [[0.5, -1.0], [0.5], [], []]
    words = one(spark, shape.token_words(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(float("nan")), F.lit(2.0)), F.lit(3.0)))
    assert [(w.start, w.end) for w in words] == [(0.0, 2.0), (2.0, 3.0)]


def test_merged_segments_keep_words(spark):
    rows = [("a", 1, "x", 5, 9, None, "mic", [("x", 5, 9)], None), ("a", 0, " y", 0, 5, 1, "mic", [(" y", 0, 5)], "aux"), ("b", 0, "!", 0, 1, None, "mic", None, None)]
    df = spark.createDataFrame(rows, "k string, o int, text string, start_ms bigint, end_ms bigint, speaker bigint, source string, words array<struct<text:string,start_ms:bigint,end_ms:bigint>>, aux_text string")
    (r,) = shape.merge_segments(df, "k", "o").collect()
    assert (r.text, r.start_ms, r.end_ms, r.speaker, r.aux_text, [w.text for w in r.words]) == (" yx", 0, 9, 1, "aux", [" y", "x"])


def test_emissions_put_finals_first(spark):
    polls = [("s", 0, None, "a"), ("s", 1, "", "a"), ("s", 2, "A.", "b"), ("s", 3, None, "a"), ("s", 4, None, ""), ("s", 5, None, "a"), ("s", 6, None, "ab")]
    df = spark.createDataFrame(polls, "k string, o int, final string, volatile string")
    assert [(r.o, r.status, r.text) for r in batch.emissions(df, "k", "o").orderBy("o").collect()] == [(0, "Partial", "a"), (2, "Final", "A."), (3, "Partial", "a"), (6, "Partial", "ab")]


def test_an_index_answers_as_a_scan(spark, tmp_path):
    from murmura.operators import search, text_index

    rnd = random.Random(3)
    words = ["budget", "Budgets", "the", "日程表", "ababab", "x", "été", "BUD"]
    rows = [(f"m{i % 5}", i % 40, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9)))) for i in range(200)] + [("m", 1, None), ("m", 2, ""), ("m", 3, "ab")]
    df = spark.createDataFrame(rows + rows[:30], "meeting_id string, idx int, text string")
    text_index.build(df, str(tmp_path / "i"))
    for q in ("budget", "the budget", "日程表", "ababab", "été the", "nowhere", ""):
        got, want = (sorted((r.meeting_id, r.idx, r.text, round(r.score, 9)) for r in d.collect()) for d in (text_index.bm25(spark, str(tmp_path / "i"), q), search.bm25(df, q) if q else df.limit(0).withColumn("score", F.lit(0.0))))
        assert got == want, q
    with pytest.raises(ValueError):
        text_index.bm25(spark, str(tmp_path / "i"), "ab")
