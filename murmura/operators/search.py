"""Search over the note store: substring full text with BM25, wildcard-free LIKE, vectors, and rank fusion."""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pandas as pd
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import ascii_lower, truncate_chars, utrim

SNIPPET = 120


def query_tokens(query: str) -> list[str]:
    """Tokens between Unicode white space."""
    return query.split()


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors in double precision; 0 if their lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def to_bytes(v: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(v)}f", *v)


def from_bytes(b: bytes) -> list[float]:
    """Floats of :func:`to_bytes`; an incomplete last one is ignored."""
    return list(struct.unpack(f"<{len(b) // 4}f", b[: len(b) // 4 * 4]))


def embed_hashing(text: Column, dim: int = 64) -> Column:
    """The deterministic embedder: each token's hash (h * 31 + byte) bumps one place; normalised, an empty text all zero.

    Vectorised over Arrow batches; a token's place is computed once a worker.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        places: dict[str, int] = {}
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").split():
                if (at := places.get(w)) is None:
                    h = 0
                    for byte in w.encode():
                        h = (h * 31 + byte) & 0xFFFFFFFFFFFFFFFF
                    at = places[w] = h % dim
                v[at] += 1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed(text)


def best_per_meeting(hits: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first hit of each meeting in rank order, ``limit`` meetings at most (a top-k report)."""
    first = F.row_number().over(Window.partitionBy("meeting_id").orderBy(*order))
    return hits.withColumn("first", first).filter("first = 1").drop("first").orderBy(*order).limit(limit)


def _hits(segments: DataFrame, meetings: DataFrame) -> DataFrame:
    m = meetings.select(F.col("id").alias("m"), "title", "started_at_ms")
    return segments.select("meeting_id", "idx", "text").join(m, F.col("meeting_id") == F.col("m")).drop("m")


def search_like(segments: DataFrame, meetings: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Segments that hold every token, ASCII letters in either case; latest meetings first, score 0."""
    found = segments
    for t in query_tokens(query):
        found = found.filter(ascii_lower(F.col("text")).contains(t.translate({c: c + 32 for c in range(65, 91)})))
    hits = _hits(found, meetings)
    best = best_per_meeting(hits, [F.desc("started_at_ms"), F.col("meeting_id"), F.col("idx"), F.col("text")], limit)
    return best.select("meeting_id", "title", "started_at_ms", truncate_chars(F.col("text"), SNIPPET).alias("snippet"), F.lit(0.0).alias("score"))


def occurrences(text: Column, phrase: str) -> Column:
    """Overlapping occurrences of a phrase."""
    if len(phrase) < 2 or all(phrase[:k] != phrase[-k:] for k in range(1, len(phrase))):  # cannot overlap itself
        return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")
    places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - len(phrase) + 1, F.lit(1)))
    return F.size(F.filter(places, lambda i: F.substring(text, i, F.lit(len(phrase))) == phrase))


def bm25(segments: DataFrame, query: str) -> DataFrame:
    """(meeting_id, idx, text, score) of the segments that hold every token; lower scores are better.

    Lengths are numbers of trigrams; statistics are those of all rows, read in one pass, and two numbers a token come
    back to the driver. A token of half the rows or more weighs 1e-6.
    """
    tokens = [t.lower() for t in query_tokens(query)]
    d = segments.filter(F.col("text").isNotNull()).select("meeting_id", "idx", "text", F.lower("text").alias("low"), F.greatest(F.char_length("text") - 2, F.lit(0)).alias("tri"))
    stats = d.agg(F.count("*").alias("n"), F.sum("tri").alias("tri"), *[F.count_if(F.col("low").contains(t)).alias(f"c{i}") for i, t in enumerate(tokens)]).first()
    mean = (stats.tri or 0) / stats.n if stats.n else 0.0
    score = F.lit(0.0)
    for i, t in enumerate(tokens):
        d = d.filter(F.col("low").contains(t))
        idf = math.log((stats.n - stats[f"c{i}"] + 0.5) / (stats[f"c{i}"] + 0.5))
        f = occurrences(F.col("low"), t).cast("double")
        score = score + (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("tri") / (mean or 1.0)))
    return d.select("meeting_id", "idx", "text", (-score).alias("score"))


def mark(text: Column, query: str, around: int = 14) -> Column:
    """The part of a text around its first match, matches between guillemets and cuts shown by an ellipsis."""
    tokens = "|".join(re.escape(t) for t in query_tokens(query))
    at = F.regexp_instr(text, F.lit(f"(?i){tokens}"))
    begin = F.greatest(at - around, F.lit(1))
    part = F.substring(text, begin, F.lit(8 * around))
    marked = F.regexp_replace(part, f"(?i)({tokens})", "«$1»")
    return F.concat(F.when(begin > 1, "…").otherwise(""), marked, F.when(begin + 8 * around <= F.char_length(text), "…").otherwise(""))


def search_fts(segments: DataFrame, meetings: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Full-text hits, the best segment of each meeting; ties go to the later meeting, then id and place."""
    hits = _hits_of(bm25(segments, query), meetings)
    best = best_per_meeting(hits, [F.col("score"), F.desc("started_at_ms"), F.col("meeting_id"), F.col("idx"), F.col("text")], limit)
    return best.select("meeting_id", "title", "started_at_ms", mark(F.col("text"), query).alias("snippet"), "score")


def _hits_of(scored: DataFrame, meetings: DataFrame) -> DataFrame:
    m = meetings.select(F.col("id").alias("m"), "title", "started_at_ms")
    return scored.join(m, F.col("meeting_id") == F.col("m")).drop("m")


def search(segments: DataFrame, meetings: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Full text if every token has three characters or more, else LIKE; no token, no rows."""
    tokens = query_tokens(query)
    if not tokens:
        return search_like(segments.limit(0), meetings, "", limit)
    return (search_fts if all(len(t) >= 3 for t in tokens) else search_like)(segments, meetings, query, limit)


def search_semantic(chunks: DataFrame, meetings: DataFrame, vector: list[float], limit: int = 50) -> DataFrame:
    """The best chunk of each meeting by dot product with a query vector; scores of 0 or less are left out."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.filter(F.col("embedding").isNotNull()).select("meeting_id", "idx", "text", dot(F.col("embedding"), q).alias("score")).filter("score > 0")
    best = best_per_meeting(_hits_of(scored, meetings), [F.desc("score"), F.col("meeting_id"), F.col("idx"), F.col("text")], limit)
    return best.select("meeting_id", "title", "started_at_ms", truncate_chars(F.col("text"), SNIPPET).alias("snippet"), "score")


def rrf_fuse(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """(id, score) of ranked lists (id, rank from 0): the sum of 1 / (k + rank), best first, ties by id."""
    all_ = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("id", "rank"))
    return all_.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id")


def search_library(mode: str, segments: DataFrame, chunks: DataFrame, meetings: DataFrame, query: str, embed: Callable[[str], list[float]] | None = None, limit: int = 50) -> DataFrame:
    """Hits by a mode (see ``sources.registry``): vectors alone give none without an embedder, both together text hits; others are full text."""
    if mode == "semantic":
        return search_semantic(chunks, meetings, embed(query) if embed else [], limit)
    if mode == "hybrid":
        return search_hybrid(segments, chunks, meetings, query, embed(query) if embed else None, limit)
    return search(segments, meetings, query, limit)


def search_hybrid(segments: DataFrame, chunks: DataFrame, meetings: DataFrame, query: str, vector: list[float] | None, limit: int = 50) -> DataFrame:
    """Full text and vectors fused by rank; text hits give title and snippet where there are both."""
    if not vector:
        return search(segments, meetings, query, limit)
    pool = max(limit, 20)
    text = search(segments, meetings, query, pool)
    near = search_semantic(chunks, meetings, vector, pool)
    ranked = lambda d, *o: d.withColumn("rank", F.row_number().over(Window.orderBy(*o)) - 1)  # noqa: E731  # a pool of a few rows
    text = ranked(text, F.col("score"), F.desc("started_at_ms"), F.col("meeting_id"))
    near = ranked(near, F.desc("score"), F.col("meeting_id"))
    fused = rrf_fuse(text.select(F.col("meeting_id").alias("id"), "rank"), near.select(F.col("meeting_id").alias("id"), "rank"))
    side = lambda d, p: d.select(F.col("meeting_id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"), F.col("started_at_ms").alias(f"{p}_at"), F.col("snippet").alias(f"{p}_snippet"))
    out = fused.join(side(text, "t"), F.col("id") == F.col("t_id"), "left").join(side(near, "n"), F.col("id") == F.col("n_id"), "left")
    return out.select(F.col("id").alias("meeting_id"), F.coalesce("t_title", "n_title").alias("title"), F.coalesce("t_at", "n_at").alias("started_at_ms"), F.coalesce("t_snippet", "n_snippet").alias("snippet"), "score").orderBy(F.desc("score"), "meeting_id").limit(limit)
