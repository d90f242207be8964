"""From clips to transcripts: speech without its pauses, windows at quiet points, a given engine, times mapped back.

A clip is a row; what is done to one needs no other, so clips spread over all tasks and nothing is shuffled until
segments are numbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import has_content
from murmura.operators.models import Diarizer, Factory
from murmura.operators.signal import normalize, windows
from murmura.operators.speakers import remap_segments, renumbered, split_by_speaker

WORDS = "array<struct<text:string,start_ms:bigint,end_ms:bigint>>"
GATES = "array<struct<compressed_ms:bigint,original_ms:bigint,duration_ms:bigint>>"


def speech(x: np.ndarray, rate: int, frame_ms: int = 100, threshold: float = 0.01, hangover_ms: int = 700) -> list[tuple[int, np.ndarray]]:
    """Utterances (start_ms, samples) of a clip: speech frames up to a silence of ``hangover_ms`` in sum; silent frames are not kept."""
    n, out, parts, quiet, opens = max(1, rate * frame_ms // 1000), [], [], 0, 0
    for i in range(0, len(x), n):
        frame = x[i : i + n]
        if np.sqrt(np.mean(np.square(frame))) >= threshold:
            opens = opens if parts else i * 1000 // rate
            parts.append(frame)
            quiet = 0
        elif parts:
            quiet += frame_ms
            if quiet >= hangover_ms:
                out.append((opens, np.concatenate(parts)))
                parts, quiet = [], 0
    return [*out, (opens, np.concatenate(parts))] if parts else out


def gated(clips: DataFrame, key: str, samples: str, rate: int = 16_000, frame_ms: int = 100, threshold: float = 0.01, hangover_ms: int = 700) -> DataFrame:
    """(key, samples, gates): clips without their pauses, and where each utterance came from; a clip without speech is left out."""
    d = clips.filter(F.size(samples) > 0).select(F.col(key).alias("k"), F.col(samples).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in b.itertuples(index=False, name=None):
                at, gates, kept = 0, [], []
                for start, part in speech(np.asarray(x, float), rate, frame_ms, threshold, hangover_ms):
                    ms = len(part) * 1000 // rate
                    gates.append((at, start, ms))
                    kept.append(part)
                    at += ms
                if kept:
                    rows.append((k, np.concatenate(kept), gates))
            yield pd.DataFrame(rows, columns=["k", "samples", "gates"])

    return d.mapInPandas(run, f"k {dict(d.dtypes)['k']}, samples array<double>, gates {GATES}").withColumnRenamed("k", key)


def transcribed(parts: DataFrame, keys: list[str], samples: str, offset_ms: str, engine: Factory, rate: int = 16_000, diarizer: type[Diarizer] | None = None) -> DataFrame:
    """(keys, pos, text, start_ms, end_ms, words, speaker): an engine's segments of each part, ``offset_ms`` later.

    ``pos`` is a segment's place in its part. A part has one speaker, that of the diarizer; where it fails, none.
    """
    d = parts.select(*keys, F.col(offset_ms).cast("bigint").alias("__at"), F.col(samples).alias("__x"))
    schema = ", ".join([*(f"{k} {t}" for k, t in d.dtypes if k in keys), f"pos int, text string, start_ms bigint, end_ms bigint, words {WORDS}, speaker bigint"])
    names = [*keys, "pos", "text", "start_ms", "end_ms", "words", "speaker"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, who = engine(), diarizer() if diarizer else None
        for b in batches:
            rows = []
            for *key, at, x in b[[*keys, "__at", "__x"]].itertuples(index=False, name=None):
                x = np.asarray(x if x is not None else [], float)
                at, speaker = at or 0, None
                found = model.transcribe(x, rate)
                if who and found:
                    try:
                        speaker = who.identify(x, rate)
                    except Exception:  # a transcript without a speaker is better than none
                        speaker = None
                rows += [(*key, i, t, s + at, e + at, [(w, a + at, z + at) for w, a, z in ws], speaker) for i, (t, s, e, ws) in enumerate(found)]
            out = pd.DataFrame(rows, columns=names)
            out["speaker"] = out["speaker"].astype("Int64")
            yield out

    return d.mapInPandas(run, schema)


def sentences_of(utterances: DataFrame, key: str, order: str, samples: str, start_ms: str, engine: Factory, rate: int = 16_000, diarizer: type[Diarizer] | None = None, source: str = "file") -> DataFrame:
    """(key, id, text, start_ms, end_ms, words, speaker, source, status): final segments of each utterance, at the level of speech.

    Segments without a letter or digit are dropped; the others count from 0 per key.
    """
    d = utterances.withColumn("__level", normalize(F.col(samples), F.lit(rate)))
    found = transcribed(d, [key, order], "__level", start_ms, engine, rate, diarizer).filter(has_content(F.col("text")))
    return renumbered(found, key, [order, "pos"]).select(key, "id", "text", "start_ms", "end_ms", "words", "speaker", F.lit(source).alias("source"), F.lit("Final").alias("status"))


def lines_of(jobs: DataFrame, keys: list[str], samples: str, start_ms: str, engine: Factory, rate: int = 16_000, diarizer: type[Diarizer] | None = None) -> DataFrame:
    """(keys, text, start_ms, end_ms, words, speaker): each job's segments as one line, none where no letter or digit is left.

    ``keys`` identify a job and have ``status``; only finals have a speaker.
    """
    d = jobs.withColumn("__level", normalize(F.col(samples), F.lit(rate)))
    found = transcribed(d, keys, "__level", start_ms, engine, rate, diarizer)
    whole = F.array_sort(F.collect_list(F.struct("pos", "text", "words")))
    line = found.groupBy(*keys).agg(whole.alias("__w"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"))
    line = line.select(*keys, F.array_join(F.transform("__w", lambda x: x.text), "").alias("text"), "start_ms", "end_ms", F.flatten(F.transform("__w", lambda x: x.words)).alias("words"), F.when(F.col("status") == "Final", F.col("speaker")).alias("speaker"))
    return line.filter(has_content(F.col("text")))


def file_transcript(clips: DataFrame, key: str, samples: str, engine: Factory, spans: DataFrame | None = None, rate: int = 16_000, seconds: int = 30, gate: bool = True) -> DataFrame:
    """(key, id, start_ms, end_ms, speaker, text) of whole clips.

    Pauses are taken out, what is left is cut into windows at quiet points and transcribed; times go back to the clip's
    own clock, segments are cut where the speaker of ``spans`` (meeting_id, speaker, start_ms, end_ms) changes, and
    numbered last.
    """
    named = clips.select(F.col(key).alias("meeting_id"), F.col(samples).alias("samples"))
    heard = gated(named, "meeting_id", "samples", rate) if gate else named.filter(F.size("samples") > 0)
    cut = windows(heard.withColumn("rate", F.lit(rate)), "meeting_id", "samples", "rate", seconds)
    cut = cut.withColumn("at", (F.col("start") * 1000 / rate).cast("bigint"))
    found = transcribed(cut, ["meeting_id", "window"], "samples", "at", engine, rate)
    if gate:
        gates = heard.select("meeting_id", F.explode("gates").alias("g")).select("meeting_id", "g.*")
        found = remap_segments(found, gates, "meeting_id")
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("window", "pos"))
    found = found.withColumn("id", n.cast("bigint"))
    if spans is not None:
        found = split_by_speaker(found, spans)
        return renumbered(found, "meeting_id", ["seg", "part"]).select(F.col("meeting_id").alias(key), "id", "start_ms", "end_ms", "speaker", "text")
    return renumbered(found, "meeting_id", ["id"]).select(F.col("meeting_id").alias(key), "id", "start_ms", "end_ms", "speaker", "text")
