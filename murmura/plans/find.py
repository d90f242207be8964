"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators import search as S
from murmura.operators import text_index
from murmura.session import shared_folder
from murmura.sources.tables import table

#: What the queries look for.
WORDS, SHORT, CJK = "translation queue", "预算 培训", "翻译队列"


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, root, "segment", "meeting_id", "idx", "text"), table(spark, root, "meeting", "id", "title", "started_at_ms"), table(spark, root, "chunk", "id", "meeting_id", "idx", "text", "embedding")


def _vector(spark: SparkSession, root: str) -> list[float]:
    """The query vector: that of the first row of the embeddings table."""
    return list(table(spark, root, "embeddings", "vec_id", "embedding").orderBy("vec_id").first().embedding)


def search_like(spark: SparkSession, root: str) -> DataFrame:
    """A query with a short token goes to LIKE."""
    seg, met, _ = _tables(spark, root)
    return S.search(seg, met, SHORT)


def search_bm25(spark: SparkSession, root: str) -> DataFrame:
    """All scored segments of a full-text query."""
    seg, _, _ = _tables(spark, root)
    return S.bm25(seg, WORDS).select("meeting_id", "idx", F.round("score", 9).alias("score"))


def search_indexed(spark: SparkSession, root: str) -> DataFrame:
    """All scored segments of a full-text query, by an index of trigrams."""
    seg, _, _ = _tables(spark, root)
    path = shared_folder(spark)
    text_index.build(seg, path)
    return text_index.bm25(spark, path, WORDS).select("meeting_id", "idx", F.round("score", 9).alias("score"))


def search_fts(spark: SparkSession, root: str) -> DataFrame:
    """The best meetings of a full-text query."""
    seg, met, _ = _tables(spark, root)
    return S.search(seg, met, WORDS).select("meeting_id", "title", F.round("score", 9).alias("score"))


def search_cjk(spark: SparkSession, root: str) -> DataFrame:
    """Full text in a script without spaces."""
    seg, met, _ = _tables(spark, root)
    return S.search(seg, met, CJK).select("meeting_id", "title", F.round("score", 9).alias("score"))


def search_semantic(spark: SparkSession, root: str) -> DataFrame:
    """The best meetings by their chunks' vectors."""
    _, met, chunk = _tables(spark, root)
    return S.search_semantic(chunk, met, _vector(spark, root)).select("meeting_id", "title", F.round("score", 9).alias("score"))


def search_hybrid(spark: SparkSession, root: str) -> DataFrame:
    """Full text and vectors fused."""
    seg, met, chunk = _tables(spark, root)
    return S.search_hybrid(seg, chunk, met, WORDS, _vector(spark, root)).select("meeting_id", "title", F.round("score", 9).alias("score"))


def embed_hashing(spark: SparkSession, root: str) -> DataFrame:
    """Deterministic vectors of all chunk texts: how many places they fill and the sum of their squares."""
    _, _, chunk = _tables(spark, root)
    v = chunk.select("id", S.embed_hashing(F.col("text")).alias("v"))
    return v.select("id", F.size(F.filter("v", lambda x: x > 0)).alias("places"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


def l2_normalize(spark: SparkSession, root: str) -> DataFrame:
    """Chunk vectors scaled to length 1."""
    _, _, chunk = _tables(spark, root)
    return chunk.filter(F.size("embedding") > 0).select("id", F.transform(S.l2_normalize(F.col("embedding")), lambda x: F.round(x, 5)).alias("unit"))


QUERIES = {f.__name__: f for f in (search_like, search_bm25, search_indexed, search_fts, search_cjk, search_semantic, search_hybrid, embed_hashing, l2_normalize)}


def _bm25(tokens: list[str]) -> str:
    hold = " AND ".join(f"contains(low, '{t}')" for t in tokens)
    counts = ", ".join(f"count(*) FILTER (contains(low, '{t}')) AS c{i}" for i, t in enumerate(tokens))
    term = lambda i, t: f"CASE WHEN ln((n - c{i} + 0.5) / (c{i} + 0.5)) > 0 THEN ln((n - c{i} + 0.5) / (c{i} + 0.5)) ELSE 1e-6 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * tri / (total / n)))"
    f = ", ".join(f"CAST((length(low) - length(replace(low, '{t}', ''))) / {len(t)} AS DOUBLE) AS f{i}" for i, t in enumerate(tokens))
    return f"""d AS (SELECT meeting_id, idx, text, lower(text) AS low, greatest(length(text) - 2, 0) AS tri FROM segment WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(tri) AS DOUBLE) AS total, {counts} FROM d),
h AS (SELECT meeting_id, idx, text, -({' + '.join(term(i, t) for i, t in enumerate(tokens))}) AS score FROM (SELECT *, {f} FROM d WHERE {hold}), s)"""


_BEST = "b AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY score, idx, text) AS first FROM h), t AS (SELECT b.meeting_id, m.title, m.started_at_ms, b.score FROM b JOIN meeting m ON m.id = b.meeting_id WHERE first = 1 ORDER BY score, started_at_ms DESC, meeting_id LIMIT %d)"
_DOT = """q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
e AS (SELECT c.meeting_id, c.idx, c.text, CASE WHEN len(c.embedding) = len(q.v) THEN list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) ELSE 0 END AS score FROM chunk c, q WHERE c.embedding IS NOT NULL),
eb AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY score DESC, idx, text) AS first FROM e WHERE score > 0),
et AS (SELECT eb.meeting_id, m.title, eb.score FROM eb JOIN meeting m ON m.id = eb.meeting_id WHERE first = 1 ORDER BY score DESC, meeting_id LIMIT %d)"""

SQL = {
    "search_like": rf"""WITH h AS (SELECT s.meeting_id, m.title, m.started_at_ms, regexp_replace(s.text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text, row_number() OVER (PARTITION BY s.meeting_id ORDER BY idx, s.text) AS first
FROM segment s JOIN meeting m ON m.id = s.meeting_id WHERE {' AND '.join(f"contains(s.text, '{t}')" for t in SHORT.split())})
SELECT meeting_id, title, started_at_ms, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '…' ELSE text END AS snippet, 0.0::DOUBLE AS score FROM h WHERE first = 1 ORDER BY started_at_ms DESC, meeting_id LIMIT 50""",
    "search_bm25": f"WITH {_bm25(WORDS.split())} SELECT meeting_id, idx, round(score, 9) AS score FROM h",
    "search_indexed": f"WITH {_bm25(WORDS.split())} SELECT meeting_id, idx, round(score, 9) AS score FROM h",
    "search_fts": f"WITH {_bm25(WORDS.split())}, {_BEST % 50} SELECT meeting_id, title, round(score, 9) AS score FROM t",
    "search_cjk": f"WITH {_bm25([CJK])}, {_BEST % 50} SELECT meeting_id, title, round(score, 9) AS score FROM t",
    "search_semantic": f"WITH {_DOT % 50} SELECT meeting_id, title, round(score, 9) AS score FROM et",
    "search_hybrid": f"""WITH {_bm25(WORDS.split())}, {_BEST % 50}, {_DOT % 50},
r AS (SELECT meeting_id, title, row_number() OVER (ORDER BY score, started_at_ms DESC, meeting_id) - 1 AS rank FROM t UNION ALL SELECT meeting_id, title, row_number() OVER (ORDER BY score DESC, meeting_id) - 1 FROM et)
SELECT meeting_id, any_value(title) AS title, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r GROUP BY meeting_id ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, meeting_id LIMIT 50""",
    "l2_normalize": "SELECT id, list_transform(embedding, lambda x: round(CASE WHEN sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) > 0 THEN x::DOUBLE / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) ELSE x::DOUBLE END, 5) + 0.0) AS unit FROM chunk WHERE len(embedding) > 0",
}
