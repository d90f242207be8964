"""WAV files of 16-bit samples as rows, and samples as WAV bytes."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def encode(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file of float samples, clipped and cut towards zero."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples from -1 to 1, rate, channels) of a WAV file of 8, 16 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width = w.readframes(w.getnframes()), w.getsampwidth()
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
        else:
            x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
        return x, w.getframerate(), w.getnchannels()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, samples) of the WAV files below a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, r, c, x) for p, (x, r, c) in zip(b["path"], map(decode, b["content"]))]
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rate int, channels int, samples array<float>")
