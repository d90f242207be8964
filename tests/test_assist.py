import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import assist
from murmura.sources import wav
from murmura.streaming import batch, folds


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("text", "most", "want"), [("ab\ncd\nef", 4, 3), ("ab\ncd\nef", 5, 6), ("ab\ncd", 5, 5), ("abcdef", 3, 0), ("\nab", 2, 0), ("", 0, 0)])
def test_line_cut(spark, text, most, want):
    assert one(spark, assist.line_cut(F.lit(text), F.lit(most))) == want


def test_map_reduce(spark):
    df = spark.createDataFrame([(1, "short"), (2, "aaaa\nbbbb\ncccc"), (3, None), (4, "")], "k int, t string")
    got = {r.k: r.answer for r in assist.map_reduce(df, "k", "t", 9, lambda c: F.concat(F.lit("<"), c, F.lit(">"))).collect()}
    assert got == {1: "<short>", 2: "<=== Part 1/2 ===\n<aaaa\nbbbb>\n\n=== Part 2/2 ===\n<cccc>>"}


def test_prompts_and_slugs(spark):
    assert one(spark, assist.combine_system(F.lit("  "), F.lit("t"))) == "t"
    assert one(spark, assist.combine_system(F.lit(" s "), F.lit("t"))) == "s\n\nt"
    assert one(spark, assist.input_budget(F.lit(1000))) == 1800 and one(spark, assist.input_budget(F.lit(0))) is None
    names = spark.createDataFrame([("My Model",), ("my model!",), ("你好",), ("Other",)], "name string")
    taken = spark.createDataFrame([("my-model",), ("my-model-3",)], "s string")
    got = {r.name: r.slug for r in assist.unique_slugs(names, "name", taken).collect()}
    assert sorted([got["My Model"], got["my model!"]]) == ["my-model-2", "my-model-4"] and got["你好"] == "item" and got["Other"] == "other"


def test_mixer(spark):
    rows = [("s", i, [0.8] * 8, [0.04] * 8) for i in range(40)] + [("t", i, [1.0] * 8, [1.0] * 4) for i in range(10)] + [("u", 0, [0.0], []), ("u", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, o int, first array<double>, second array<double>")
    got = {(r.k, r.o): r for r in batch.replay(folds.mixer(), df, "k", "o").collect()}
    assert got["s", 39].share > 0.9 and abs(got["t", 9].share - 0.5) < 1e-9 and max(got["t", 9].mixed) <= 1 and got["t", 9].mixed[-1] == 0.5
    assert got["u", 0].share == 0.5 and got["u", 1].mixed == []


def test_wav_round_trip(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 1.0, -2.0])
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 16_000))
    (r,) = wav.read(spark, str(tmp_path)).collect()
    assert (r.rate, r.channels) == (16_000, 1) and np.allclose(r.samples, np.clip(x, -1, 1), atol=1e-4)
