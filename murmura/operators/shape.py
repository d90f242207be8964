"""Text shaping: chunks, paragraphs, words from tokens, merged segments, rolling context.

What depends on the length gathered so far is a fold over a key's rows in order; the rows stream past a small state, so
a key of any size fits. What does not is built from expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import ends_cjk, has_content, is_blank, starts_cjk, utrim


def stream_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, begin: Callable[[], object], step: Callable, finish: Callable) -> DataFrame:
    """A fold over each key's rows in order, row by row past a state; no key's rows are ever gathered.

    Rows are placed by key and sorted by key and order; ``step(state, row)`` and ``finish(key, state)`` yield result
    tuples, where a row is a tuple in the order of ``df``'s columns, ``keys`` first.
    """
    n = len(keys)
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for b in batches:
            out: list[tuple] = []
            for row in b.astype(object).where(b.notna(), None).itertuples(index=False, name=None):
                if state is None or row[:n] != key:
                    if state is not None:
                        out += finish(key, state)
                    key, state = row[:n], begin()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(list(finish(key, state)), columns=names)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


def chunk_texts(df: DataFrame, key: str, order: str, text: str, most: int = 512) -> DataFrame:
    """(key, chunk, text): trimmed texts packed greedily into chunks of at most ``most`` characters.

    Texts join by a space and are never cut; a longer one is a chunk by itself. Null and blank texts are left out; a key
    without any other gives no rows, nor does a null key. Ties of ``order`` go by the text.
    """
    d = df.filter(~is_blank(F.col(text)) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), utrim(F.col(text)).alias("t"))

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        t = row[2]
        if state["cur"] is not None and len(state["cur"]) + 1 + len(t) > most:
            yield from finish(row[:1], state)
            state["n"], state["cur"] = state["n"] + 1, None
        state["cur"] = t if state["cur"] is None else f"{state['cur']} {t}"

    def finish(key: tuple, state: dict) -> Iterator[tuple]:
        if state["cur"] is not None:
            yield key[0], state["n"], state["cur"]

    out = stream_fold(d, ["k"], ["o", "t"], f"k {dict(d.dtypes)['k']}, chunk bigint, text string", lambda: {"n": 0, "cur": None}, step, finish)
    return out.withColumnRenamed("k", key)


def chunk_lines(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, chunk, text): a text's lines packed greedily into chunks of at most ``budget`` characters, joined by line breaks.

    Blank lines at a chunk's head vanish, inner ones stay. An empty text gives no rows.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n", "\n"), r"\n\z", ""), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        fits = F.char_length(acc.cur) + 1 + F.char_length(line) <= budget
        return F.when(acc.cur == "", F.struct(acc.done.alias("done"), line.alias("cur"))).when(fits, F.struct(acc.done.alias("done"), F.concat(acc.cur, F.lit("\n"), line).alias("cur"))).otherwise(F.struct(F.array_append(acc.done, acc.cur).alias("done"), line.alias("cur")))

    packed = F.aggregate(lines, start, step, lambda a: F.when(a.cur == "", a.done).otherwise(F.array_append(a.done, a.cur)))
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(packed).alias("chunk", "text"))


def paragraphs(df: DataFrame, key: str, order: list[str], gap_ms: int = 1500, chars: int = 240, by_source: bool = True) -> DataFrame:
    """(key, paragraph, start_ms, end_ms, speaker, source, text) of segments in order.

    A segment goes on with the paragraph of the same source (unless ``by_source`` is off) and speaker, unknown being
    equal to unknown, if it starts at most ``gap_ms`` after the last one's end and the paragraph is below ``chars`` so
    far. Blank segments are left out; a missing time counts as 0 in the result's gap.
    """
    d = df.filter(~is_blank(F.col("text"))).select(F.col(key).alias("k"), F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"), F.col("speaker").cast("bigint").alias("speaker"), "source", utrim(F.col("text")).alias("t"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        _, start, end, speaker, source, t = row[:6]
        cur = state["cur"]
        if cur is not None:
            goes_on = cur[2] == speaker and (not by_source or cur[3] == source) and max((start or 0) - (cur[1] or 0), 0) <= gap_ms and len(cur[4]) < chars
            if goes_on:
                space = " " if t[:1].isascii() and t[:1].isalnum() else ""
                state["cur"] = (cur[0], end, cur[2], cur[3], cur[4] + space + t)
                return
            yield from finish(row[:1], state)
            state["n"] += 1
        state["cur"] = (start, end, speaker, source, t)

    def finish(key: tuple, state: dict) -> Iterator[tuple]:
        yield (key[0], state["n"], *state["cur"])

    out = stream_fold(d, ["k"], [f"o{i}" for i in range(len(order))], f"k {dict(d.dtypes)['k']}, paragraph bigint, start_ms bigint, end_ms bigint, speaker bigint, source string, text string", lambda: {"n": 0, "cur": None}, step, finish)
    return out.withColumnRenamed("k", key)


def merge_tokens(df: DataFrame, key: str, order: str, text: str = "text", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(key, word, text, start_ms, end_ms): decoder tokens merged into words.

    Empty tokens and those that begin with a bracket are left out. A word begins at the first token, at one that begins
    with white space or CJK, and after one that ends with CJK.
    """
    d = df.filter(F.col(text).isNotNull() & (F.col(text) != "") & ~F.col(text).startswith("[")).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"), F.col(start).alias("s"), F.col(end).alias("e"))
    w = Window.partitionBy("k").orderBy("o")
    before = F.lag("t").over(w)
    opens = before.isNull() | F.col("t").rlike(r"^(?U)\s") | starts_cjk(F.col("t")) | ends_cjk(before)
    d = d.withColumn("opens", opens.cast("int")).withColumn("word", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = d.groupBy("k", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x.t), "").alias("text"), F.min_by("s", "o").alias("start_ms"), F.max_by("e", "o").alias("end_ms"))
    return out.select(F.col("k").alias(key), "word", "text", "start_ms", "end_ms")


def token_words(tokens: Column, times: Column, clip: Column) -> Column:
    """Words ``(text, start, end)`` of parallel arrays of tokens and start times; empty if their lengths differ.

    A word ends where the next begins, the last with the clip, none before its start; negative times and those that are
    no number are 0.
    """
    times = F.transform(times, lambda x: F.nanvl(x.cast("double"), F.lit(0.0)))
    word = lambda t, i: F.struct(t.alias("text"), F.greatest(F.get(times, i), F.lit(0.0)).alias("start"), F.greatest(F.coalesce(F.get(times, i + 1), clip), F.greatest(F.get(times, i), F.lit(0.0))).alias("end"))
    return F.when(F.size(tokens) == F.size(times), F.transform(tokens, word)).otherwise(F.array().cast("array<struct<text:string,start:double,end:double>>"))


def merge_segments(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text, start_ms, end_ms, speaker, source): a key's segments as one; none where no letter or digit is left.

    Where ``df`` has ``words``, all words come too, in order; where it has ``aux_text``, that of the first segment.
    """
    more = []
    if "words" in df.columns:
        empty = F.array().cast(df.schema["words"].dataType)
        more.append(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("words", empty).alias("w")))), lambda x: x.w)).alias("words"))
    if "aux_text" in df.columns:
        more.append(F.min_by("aux_text", order).alias("aux_text"))
    d = df.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x.text), "").alias("text"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min_by("speaker", order).alias("speaker"),
        F.min_by("source", order).alias("source"),
        *more,
    )
    return d.filter(has_content(F.col("text")))


def rolling_context(df: DataFrame, key: str, order: str, text: str, chars: int = 224) -> DataFrame:
    """``df`` with ``context``: the last ``chars`` characters of the texts so far, joined by spaces, before each row.

    Blank texts add nothing, however many there are in a row. The texts with content are numbered; a row looks back over
    as many of them as can fill ``chars``, so it holds a bounded number of texts.
    """
    t = F.when(~is_blank(F.col(text)), utrim(F.col(text)))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("__n", F.count(t).over(before))
    joined = F.array_join(F.collect_list(t).over(Window.partitionBy(key).orderBy("__n").rangeBetween(-(chars // 2 + 1), -1)), " ")
    return d.withColumn("context", F.when(F.char_length(joined) > chars, F.substring(joined, -chars, chars)).otherwise(joined)).drop("__n")
