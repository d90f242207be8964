import sqlite3

import pytest
from pyspark.sql import functions as F

from murmura.functions import text as X
from murmura.operators import render, search, shape, store


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def lines(spark, texts):
    return spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "m string, i int, t string")


@pytest.mark.parametrize(
    ("texts", "most", "want"),
    [(["aa", "bb", "cc"], 100, ["aa bb cc"]), (["aaaa", "bbbb", "cccc"], 9, ["aaaa bbbb", "cccc"]), (["abcdefghij"], 4, ["abcdefghij"]), (["", "  ", None, "x"], 100, ["x"]), (["预算讨论", "排期计划"], 5, ["预算讨论", "排期计划"]), ([" ", None], 9, [])],
)
def test_chunks(spark, texts, most, want):
    got = shape.chunk_texts(lines(spark, texts), "m", "i", "t", most).orderBy("chunk").collect()
    assert [r.text for r in got] == want


def test_chunk_lines(spark):
    df = spark.createDataFrame([(1, "\n\naa\n\nbb\ncccc"), (2, ""), (3, None)], "k int, t string")
    got = [(r.k, r.text) for r in shape.chunk_lines(df, "k", "t", 6).orderBy("k", "chunk").collect()]
    assert got == [(1, "aa\n\nbb"), (1, "cccc")]


def test_paragraphs(spark):
    rows = [("m", 0, 0, 1000, None, "mic", "hello"), ("m", 1, 1300, 2000, None, "mic", "there"), ("m", 2, 4500, 5000, None, "mic", "later"), ("m", 3, 5000, 6000, 1, "mic", "你好"), ("m", 4, 6000, 7000, 1, "mic", "世界"), ("m", 5, 7000, 7100, 1, "system", "  ")]
    df = spark.createDataFrame(rows, "meeting_id string, idx bigint, start_ms bigint, end_ms bigint, speaker bigint, source string, text string")
    got = [r.text for r in shape.paragraphs(df, "meeting_id", ["idx"]).orderBy("paragraph").collect()]
    assert got == ["hello there", "later", "你好世界"]


def test_words_from_tokens(spark):
    rows = [(1, i, t, i * 10, i * 10 + 10) for i, t in enumerate([" trans", "cription", "你", "好", " OK", "好", "[_BEG_]", "", None])]
    df = spark.createDataFrame(rows, "k int, o int, text string, start_ms bigint, end_ms bigint")
    assert [r.text for r in shape.merge_tokens(df, "k", "o").orderBy("word").collect()] == [" transcription", "你", "好", " OK", "好"]


def test_text_functions(spark):
    assert one(spark, X.utrim(F.lit("　 a b\n"))) == "a b"
    assert one(spark, X.truncate_chars(F.lit("  abcdef "), 3)) == "abc…"
    assert one(spark, X.timestamp(F.lit(3_723_004), ",")) == "01:02:03,004"
    assert one(spark, X.short_timestamp(F.lit(3_723_004))) == "1:02:03"
    assert one(spark, X.like_escape(F.lit(r"50%_\ "))) == r"50\%\_\\ "
    assert one(spark, X.mask_key(F.lit("sk-1234567890"))) == "sk-…7890"
    assert one(spark, X.mask_key(F.lit("  "))) is None
    assert one(spark, X.similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, X.join_text(F.lit("a"), F.lit("b"))) == "a b"
    assert one(spark, X.render_snippet(F.lit("a<«b»"))) == "a&lt;<mark>b</mark>"
    assert one(spark, X.meeting_label(F.lit("system"), F.lit(1))) == "Them (Speaker 2)"
    assert one(spark, X.percent_badge(F.lit(0.995))) == 100


def test_subtitles(spark):
    rows = [("m", 0, 0, 2500, "hi"), ("m", 1, 3000, 4200, " there "), ("m", 2, 5000, 6000, " ")]
    df = spark.createDataFrame(rows, "meeting_id string, idx bigint, start_ms bigint, end_ms bigint, text string")
    got = "\n".join(r.text for r in render.srt_cues(df).orderBy("cue").collect())
    assert got == "1\n00:00:00,000 --> 00:00:02,500\nhi\n\n2\n00:00:03,000 --> 00:00:04,200\nthere\n"
    words = F.expr("array(named_struct('text', ' Hello', 'start_ms', 0L, 'end_ms', 500L), named_struct('text', ' world', 'start_ms', 500L, 'end_ms', 900L))")
    assert one(spark, render.vtt_body(F.lit("Hello world"), words)) == "<00:00:00.000>Hello<00:00:00.500> world"


def test_bm25_equals_the_embedded_database(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    texts = ["the budget report is late", "budget budget budgets", "a report", "éclair Budget", "x", "", "预算讨论会议", "aaaa aaa", "the report of the budget and the report"] * 3 + ["nothing here at all"] * 20
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "meeting_id string, idx bigint, text string")
    for q in ("budget", "budget report", "aaa", "预算讨论", "nothing", "the rep"):
        want = dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" ".join('"' + t + '"' for t in q.split()),)).fetchall())
        got = {r.idx: r.score for r in search.bm25(df, q).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


def test_search_routes_and_escapes(spark):
    seg = spark.createDataFrame([("a", 0, "literal 50% off"), ("b", 0, "500 off"), ("c", 1, "预算")], "meeting_id string, idx bigint, text string")
    met = spark.createDataFrame([(k, k.upper(), i) for i, k in enumerate("abc")], "id string, title string, started_at_ms bigint")
    hits = lambda q: [r.meeting_id for r in search.search(seg, met, q).collect()]
    assert hits("0%") == ["a"]
    assert hits("预算") == ["c"]
    assert hits("  ") == []
    assert hits("off") == ["a", "b"] or hits("off") == ["b", "a"]


def test_rank_fusion(spark):
    rank = lambda ids: spark.createDataFrame(list(zip(ids, range(len(ids)))), "id string, rank int")
    got = [r.id for r in search.rrf_fuse(rank("xyz"), rank("yw")).collect()]
    assert got[0] == "y" and len(got) == 4


def test_vectors(spark):
    assert one(spark, search.dot(F.expr("array(1f, 0f)"), F.expr("array(1f, 0f, 0f)"))) == 0.0
    assert search.from_bytes(search.to_bytes([1.0, 0.5]) + b"x") == [1.0, 0.5]
    v = one(spark, search.embed_hashing(F.lit("")))
    assert len(v) == 64 and not any(v)


def test_store(spark, tmp_path):
    live = spark.createDataFrame(
        [("n", 0, 0, 500, 1, "mic", "Partial", "x"), ("n", 1, 0, 900, 1, "mic", "Final", "  "), ("n", 2, 0, 1000, None, "camera", "Final", " committed ")],
        "meeting_id string, seq bigint, start_ms bigint, end_ms bigint, speaker bigint, source string, status string, text string",
    )
    meta = spark.createDataFrame([("n", None, 5, None, None, None), ("o", "t", 6, None, None, None)], "id string, title string, started_at_ms bigint, language string, engine string, summary string")
    s = store.NoteStore(spark, str(tmp_path / "s"))
    s.save(meta, live)
    assert s.count() == 2
    m = {r.id: r for r in s.table("meeting").collect()}
    assert m["n"].title == "Untitled meeting" and m["n"].segment_count == 1 and m["o"].duration_ms == 0
    assert [(r.text, r.source) for r in s.table("segment").collect()] == [("committed", "unknown")]
    s.save(meta.filter("id = 'n'"), live.filter("seq = 0"))
    assert s.table("segment").count() == 0 and s.count() == 2
    embed = lambda d, t: d.withColumn("embedding", search.embed_hashing(F.col(t)))
    s.save(meta, live)
    assert s.set_embedder(embed) == 1

    def failing(d, t):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        s.set_embedder(failing)
    assert s.embed is embed and s.table("chunk").count() == 1
    again = store.NoteStore(spark, str(tmp_path / "s"))
    assert again.count() == 2 and again.delete("n") and not again.delete("n") and again.table("chunk").count() == 0
