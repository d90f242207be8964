"""Array operators on audio samples: mixing down, resampling, filters, gated level, gain, windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def downmix(samples: Column, channels: Column) -> Column:
    """Mean of each group of ``channels`` interleaved samples; the last group may be short."""
    n = F.greatest(channels, F.lit(1))
    groups = F.sequence(F.lit(0), F.ceil(F.size(samples) / n).cast("int") - 1)
    mean = lambda g: F.aggregate(F.slice(samples, g * n + 1, n), F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(F.slice(samples, g * n + 1, n))
    return F.when(F.size(samples) > 0, F.transform(groups, mean)).otherwise(F.array().cast("array<double>"))


def resample(samples: Column, rate_in: Column, rate_out: Column, same_if_zero: bool = False) -> Column:
    """Linear interpolation to another rate, holding the last sample; a rate of 0 or no samples give an empty array.

    With ``same_if_zero`` an input rate of 0 gives the input.
    """
    ratio = F.try_divide(rate_out, rate_in)
    n = F.round(F.size(samples) * ratio).cast("int")

    def at(i: Column) -> Column:
        x = i / ratio
        lo = F.least(F.floor(x), F.size(samples) - 1).cast("int")
        hi = F.least(lo + 1, F.size(samples) - 1)
        a, b = F.get(samples, lo).cast("double"), F.get(samples, hi).cast("double")
        return a + (b - a) * (x - F.floor(x))

    empty = F.array().cast("array<double>")
    good = (rate_in > 0) & (rate_out > 0) & (F.size(samples) > 0) & (n > 0)
    out = F.when(good, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at))
    if same_if_zero:
        out = out.when(rate_in == 0, F.transform(samples, lambda x: x.cast("double")))
    return out.otherwise(empty)


def to_mono_16k(samples: Column, channels: Column, rate: Column) -> Column:
    """One channel at 16 kHz."""
    return resample(downmix(samples, channels), rate, F.lit(16_000))


def frames(samples: Column, rate: int, ms: int = 100) -> Column:
    """Array of (timestamp_ms, samples) of ``ms`` each; the last may be short."""
    n = rate * ms // 1000
    cut = lambda i: F.struct((i * ms).cast("bigint").alias("timestamp_ms"), F.slice(samples, i * n + 1, n).alias("samples"))
    return F.when(F.size(samples) > 0, F.transform(F.sequence(F.lit(0), ((F.size(samples) - 1) / n).cast("int")), cut))


def mean_square(samples: Column) -> Column:
    """Mean of the squares; 0 without samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, total / F.size(samples)).otherwise(0.0)


def gated_rms(samples: Column, rate: int, gate: float = 3.16e-3, floor: float = 1e-6) -> Column:
    """Level of the frames of 20 ms within ``gate`` of the loudest frame's power; null where all is below ``floor``."""
    n = max(1, rate // 50)
    power = F.transform(F.sequence(F.lit(0), F.greatest(((F.size(samples) - 1) / n).cast("int"), F.lit(0))), lambda i: mean_square(F.slice(samples, i * n + 1, n)))
    top = F.array_max(power)
    loud = F.filter(power, lambda p: p >= top * gate)
    return F.when((F.size(samples) > 0) & (top > floor), F.sqrt(F.aggregate(loud, F.lit(0.0), lambda s, p: s + p) / F.size(loud)))


def apply_gain(samples: Column, rms: Column, target: float = 0.1, most: float = 10.0, peak: float = 0.891) -> Column:
    """Samples scaled to the target level, by ``most`` at most and so that none is above ``peak``."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    gain = F.least(F.try_divide(F.lit(target), rms), F.lit(most))
    gain = F.when(top * gain > peak, F.try_divide(F.lit(peak), top)).otherwise(gain)
    return F.when(rms > 0, F.transform(samples, lambda x: x.cast("double") * gain)).otherwise(F.transform(samples, lambda x: x.cast("double")))


def pcm16(samples: Column) -> Column:
    """16-bit values, clipped to the range and cut towards zero."""
    return F.transform(samples, lambda x: (F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def high_pass(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """One-pole high pass at 70 Hz; the first output is 0."""
    out = []
    for x, r in zip(samples, rate):
        if x is None or not len(x) or not r:
            out.append([])
            continue
        x = np.asarray(x, float)
        rc, dt = 1 / (2 * np.pi * 70.0), 1 / r
        a = rc / (rc + dt)
        step, y = a * np.diff(x, prepend=x[0]), np.empty(len(x))
        # y(i) = a y(i-1) + step(i), in blocks short enough that powers of a stay far from the smallest numbers
        block = int(max(1, min(4096, 30 / max(-np.log(a), 1e-9))))
        power, last = a ** np.arange(1, block + 1), 0.0
        for i in range(0, len(x), block):
            part = step[i : i + block]
            p = power[: len(part)]
            y[i : i + block] = p * (last + np.cumsum(part / p))
            last = y[min(i + block, len(x)) - 1]
        out.append(y)
    return pd.Series(out)


def lowpass_taps(rate_in: int, rate_out: int, taps: int = 63) -> np.ndarray:
    """Windowed sinc that passes below 0.45 of the output rate; its sum is 1."""
    k = np.arange(taps) - (taps - 1) / 2
    cut = 0.45 * rate_out / rate_in
    h = 2 * cut * np.sinc(2 * cut * k) * np.hanning(taps)
    return h / h.sum()


def _linear(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """:func:`resample` of one frame."""
    n = int(np.floor(len(x) * rate_out / rate_in + 0.5)) if rate_in else 0
    at = np.arange(n) * rate_in / rate_out
    lo = np.minimum(at.astype(int), max(len(x) - 1, 0))
    return x[lo] + (x[np.minimum(lo + 1, len(x) - 1)] - x[lo]) * (at - lo) if n and len(x) else np.zeros(0)


def resample_stream(frames_: DataFrame, key: str, order: str, samples: str, rate: str, rate_out: int = 16_000) -> DataFrame:
    """(key, order, samples): frames at the rate in column ``rate`` brought to ``rate_out``, each by itself but for the filter.

    Frames of a higher rate pass a low pass that remembers the samples before, so frames join without clicks; a change of
    rate begins it anew. Frames of the same or a lower rate are interpolated only.
    """
    from murmura.operators.shape import stream_fold

    d = frames_.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(samples).alias("x"), F.col(rate).cast("int").alias("r"))

    def step(s: dict, row: tuple):
        k, o, x, r = row
        x = np.asarray(x if x is not None else [], float)
        if r and r > rate_out and len(x):
            if s["rate"] != r:
                s["rate"], s["taps"] = r, lowpass_taps(r, rate_out)
                s["tail"] = np.zeros(len(s["taps"]) - 1)
            whole = np.concatenate([s["tail"], x])
            x, s["tail"] = np.convolve(whole, s["taps"][::-1], "valid"), whole[-(len(s["taps"]) - 1) :]
        yield k, o, _linear(x, r or 0, rate_out).tolist()

    kinds = dict(d.dtypes)
    out = stream_fold(d, ["k"], ["o"], f"k {kinds['k']}, o {kinds['o']}, x array<double>", lambda: {"rate": 0, "taps": None, "tail": None}, step, lambda k, s: iter(()))
    return out.toDF(key, order, samples)


def window_bounds(x: np.ndarray, target: int, radius: int, frame: int = 320) -> list[tuple[int, int]]:
    """Windows (start, end) that tile the samples, of about ``target`` each, cut where the quietest frame near the target begins.

    Frames are tried at half-frame steps from ``radius`` before the target to ``radius`` behind it; ties go to the
    earliest. What is left within a window and a radius is the last one.
    """
    n, start, out = len(x), 0, []
    if not n:
        return []
    if target <= 0 or n <= target:
        return [(0, n)]
    while start < n:
        ideal = start + target
        if ideal + radius >= n:
            out.append((start, n))
            break
        at = np.arange(max(ideal - radius, 0), min(ideal + radius, max(n - frame, 0)) + 1, max(1, frame // 2))
        power = np.square(x[at[:, None] + np.arange(frame)[None, :]]).sum(1) if len(at) else np.zeros(0)
        cut = min(max(int(at[int(power.argmin())]) if len(at) else ideal, start + frame), n)
        out.append((start, cut))
        start = cut
    return out


def windows(clips: DataFrame, key: str, samples: str, rate: str, seconds: int = 30) -> DataFrame:
    """(key, window, start, samples): clips cut into windows of about ``seconds`` at quiet points within half a second.

    ``start`` is the window's first sample. Null and empty clips give none.
    """
    d = clips.filter(F.size(samples) > 0).select(F.col(key).alias("k"), F.col(samples).alias("x"), F.col(rate).cast("int").alias("r"))

    def run(batches):
        for b in batches:
            rows = [(k, i, s, x[s:e]) for k, x, r in b.itertuples(index=False, name=None) for i, (s, e) in enumerate(window_bounds(np.asarray(x, float), seconds * r, r // 2))]
            yield pd.DataFrame(rows, columns=["k", "window", "start", "samples"])

    return d.mapInPandas(run, f"k {dict(d.dtypes)['k']}, window int, start bigint, samples {dict(d.dtypes)['x']}").withColumnRenamed("k", key)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def normalize(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Clips through the high pass, then at the level of speech; what has no speech stays as the filter left it.

    The constants are those of :func:`gated_rms` and :func:`apply_gain`. Null and empty clips stay, as with a rate of 0.
    """
    out = []
    for x, r, flat in zip(samples, rate, high_pass.func(samples, rate)):
        if x is None or not len(x) or not r:
            out.append(x)
            continue
        n = max(1, int(r) // 50)
        power = np.array([np.mean(np.square(flat[i : i + n])) for i in range(0, len(flat), n)])
        if power.max() > 1e-6:
            gain = min(0.1 / np.sqrt(power[power >= power.max() * 3.16e-3].mean()), 10.0)
            top = np.abs(flat).max()
            flat = flat * (0.891 / top if top * gain > 0.891 else gain)
        out.append(flat)
    return pd.Series(out)


def pool(tokens: Column, mask: Column, how: str) -> Column:
    """A text's vector from its tokens': the first, the last not masked out, or the mean of those not masked out (zeros if none)."""
    if how == "first":
        return F.transform(F.get(tokens, F.lit(0)), lambda x: x.cast("double"))
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x.m > 0)
    if how == "last":
        return F.transform(F.element_at(kept, -1).t, lambda x: x.cast("double"))
    dim = F.size(F.get(tokens, F.lit(0)))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dim), lambda s, x: F.zip_with(s, x.t, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def position_ids(mask: Column) -> Column:
    """Places of the tokens: how many unmasked ones come before each."""
    blocks = F.sequence(F.lit(0), F.greatest(((F.size(mask) - 1) / 64).cast("int"), F.lit(0)))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    # sums of blocks of 64 first, so that a place costs one block and not all that comes before it
    heads = F.aggregate(F.transform(blocks, lambda b: total(F.slice(mask, b * 64 + 1, 64))), F.array(F.lit(0).cast("bigint")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    inside = F.flatten(F.transform(blocks, lambda b: F.transform(F.slice(mask, b * 64 + 1, 64), lambda m, i: F.element_at(heads, b + 1) + total(F.slice(mask, b * 64 + 1, i)))))
    return F.when(F.size(mask) > 0, inside).when(mask.isNotNull(), F.array().cast("array<bigint>"))


def frame_count(samples: Column, channels: Column) -> Column:
    """Instants of an interleaved frame."""
    return (F.size(samples) / F.greatest(channels, F.lit(1))).cast("bigint")


def frame_ms(samples: Column, channels: Column, rate: Column) -> Column:
    """Length of an interleaved frame in milliseconds; 0 without a rate."""
    return F.when(rate > 0, F.floor(frame_count(samples, channels) * 1000 / rate)).otherwise(0).cast("bigint")


def planar_mono(channels: Column) -> Column:
    """Mean of planes of samples (an array of arrays), as long as the shortest."""
    n = F.array_min(F.transform(channels, F.size))
    mean = lambda i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i).cast("double")) / F.size(channels)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), mean)).otherwise(F.array().cast("array<double>"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pcm_samples(data: pd.Series, bits: pd.Series) -> pd.Series:
    """Samples of little-endian bytes: 32 bits are floats, 16 bits numbers of which 32768 is 1; other depths give none, a torn last sample is left out."""
    out = []
    for b, n in zip(data, bits):
        kind, one = {32: ("<f4", 1.0), 16: ("<i2", 32_768.0)}.get(n, (None, 1.0))
        size = n // 8 if kind else 1
        out.append(np.frombuffer(b[: len(b) // size * size], kind).astype(float) / one if kind and b is not None else [])
    return pd.Series(out)
