"""Glue between transcripts and language models: budgets, parts, prompts, rolling context. The model is a given function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import is_blank, slug, utrim
from murmura.operators.shape import chunk_lines
from murmura.session import cut

# The region of a language without one.
LOCALES = {"auto": "auto", "": "auto", "en": "en-US", "zh": "zh-CN", "cmn": "zh-CN", "yue": "zh-HK", "ja": "ja-JP", "ko": "ko-KR", "es": "es-ES", "fr": "fr-FR", "de": "de-DE", "it": "it-IT", "pt": "pt-BR", "ru": "ru-RU", "ar": "ar-SA", "hi": "hi-IN"}


def locale(language: Column) -> Column:
    """A recogniser's locale; tags with a region stay, unknown languages are read as English."""
    t = utrim(language)
    table = F.create_map(*[F.lit(x) for kv in LOCALES.items() for x in kv])
    return F.coalesce(table[F.lower(t)], F.when(t.contains("-"), t), F.when(t.isNotNull(), F.lit("en-US")))


def input_budget(tokens: Column) -> Column:
    """Characters that fit a context of so many tokens: three a token, three fifths of them; none or 0 is no limit."""
    return F.when(tokens > 0, F.floor(tokens.cast("bigint") * 9 / 5).cast("bigint"))


def combine_system(standing: Column, task: Column) -> Column:
    """A standing instruction before a task's own, a blank line between; a blank one is left out."""
    return F.when(is_blank(standing), task).otherwise(F.concat(utrim(standing), F.lit("\n\n"), task))


def transcribe_prompt(language: Column, context: Column) -> Column:
    """What a model that hears is told: to write down what is said; the language and names, where known."""
    task = "Transcribe the audio exactly as spoken, verbatim. Output only the transcript text — no commentary, labels, or quotation marks."
    tongue = F.when(F.coalesce(language, F.lit("")) != "", F.concat(F.lit(' The audio language is "'), language, F.lit('".'))).otherwise("")
    names = F.when(~is_blank(context), F.concat(F.lit(" Context for spelling names and terms: "), utrim(context))).otherwise("")
    return F.concat(F.lit(task), tongue, names)


def line_cut(text: Column, most: Column) -> Column:
    """Length of the longest head of whole lines of at most ``most`` characters and its line break; all of a shorter text."""
    head = F.substring(text, F.lit(1), most + 1)
    breaks = F.char_length(head) - F.char_length(F.regexp_replace(head, r"[^\n]*\z", ""))
    at = F.char_length(head) - breaks
    return F.when(most >= F.char_length(text), F.char_length(text)).when(at <= 1, 0).otherwise(at)


# Fixed value: what the answers to the parts are put together by.
REDUCE = "Below are results from running the same instruction on consecutive parts of one long transcript. Combine them into a single coherent result that follows this instruction, merging duplicates and keeping it faithful:\n\n"


def reduce_instruction(instruction: Column) -> Column:
    """The instruction by which answers to the parts of a text are put together."""
    return F.concat(F.lit(REDUCE), instruction)


def map_reduce(docs: DataFrame, key: str, text: str, budget: int, model: Callable[[Column], Column], combine: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, answer): a task over each text.

    One beyond ``budget`` is cut at lines, each part answered by ``model``, and the trimmed answers, under their numbers,
    put together by ``combine``: the model under :func:`reduce_instruction` of its own one (``model`` itself by default).
    """
    parts = chunk_lines(docs, key, text, budget).select(key, "chunk", model(F.col("text")).alias("answer"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    head = F.concat(F.lit("=== Part "), (F.col("chunk") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" ===\n"), utrim(F.col("answer")))
    joined = parts.withColumn("piece", F.when(F.col("n") > 1, head).otherwise(F.col("answer"))).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x.piece), "\n\n").alias("joined"), F.first("n").alias("n")
    )
    return joined.select(key, F.when(F.col("n") > 1, (combine or model)(F.col("joined"))).otherwise(F.col("joined")).alias("answer"))


def _numbered(s: DataFrame, name: str, taken: DataFrame) -> DataFrame:
    """``s`` with ``slug``: of the numbers of each ``__s`` those that are free, in order of name; ``taken`` has one column t."""
    number = F.nullif(F.regexp_extract("t", r"-([1-9]\d{0,8})$", 1), F.lit(""))
    used = taken.select(F.col("t").alias("u"), F.lit(1).alias("n")).unionByName(taken.filter(number.isNotNull()).select(F.regexp_extract("t", r"^(.*)-\d{1,9}$", 1).alias("u"), number.cast("int").alias("n")))
    used = used.groupBy("u").agg(F.collect_set("n").alias("used"))
    count = s.groupBy("__s").agg(F.count("*").alias("__c"))
    d = s.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(name))).join(count, "__s").join(used, F.col("__s") == F.col("u"), "left")
    free = F.array_except(F.sequence(F.lit(1), F.col("__c").cast("int") + F.coalesce(F.size("used"), F.lit(0))), F.coalesce("used", F.array().cast("array<int>")))
    n = F.get(free, F.col("__r") - 1)
    return d.withColumn("slug", F.when(n == 1, F.col("__s")).otherwise(F.concat_ws("-", "__s", n.cast("string")))).drop("__r", "__c", "u", "used")


def unique_slugs(names: DataFrame, name: str, taken: DataFrame, prefix: str = "") -> DataFrame:
    """``names`` with ``slug``: ``prefix`` and the name's slug, with the smallest number from 2 that makes it free where it is taken.

    ``taken`` has one column of slugs in use. Names of the same slug are numbered in order of name, and no two rows get
    the same one: where a number makes one that another name has by itself ("asia" twice, and "asia 2"), all but the
    first by name are numbered again, with what was given as taken.
    """
    t = taken.select(F.col(taken.columns[0]).alias("t")).filter("t IS NOT NULL").distinct()
    todo = names.withColumn("__s", F.concat(F.lit(prefix), F.coalesce(F.nullif(slug(F.col(name)), F.lit("")), F.lit("item"))))
    out = None
    while True:
        got = cut(_numbered(todo, name, t))
        first = got.withColumn("__k", F.row_number().over(Window.partitionBy("slug").orderBy(F.col("slug") != F.col("__s"), name)))
        good = first.filter("__k = 1").drop("__k")
        out = good if out is None else out.unionByName(good)
        todo = first.filter("__k > 1").drop("__k", "slug")
        if todo.isEmpty():
            return out.drop("__s")
        t = t.unionByName(good.select(F.col("slug").alias("t"))).distinct()
