"""Mixing documents of several sources to target weights.

A hashed-word naive Bayes classifier, trained on a bounded sample of labelled documents, gives documents without a
source a soft membership; labelled ones belong to their source alone. Rates per document come from projected-gradient
least squares on the expected tokens of each source, labelled documents first; where they are at their bound, documents
of soft membership fill what is left. Whole copies follow by systematic rounding. Documents of equal membership have equal
rates, so the gradient runs over distinct memberships: one of each source, and those of the classifier on a grid.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.bpe import VOCABULARY, encode, slices, vocabulary_file
from murmura.session import cut

#: Hashed features of the classifier, and the labelled documents it is trained on at most.
FEATURES, SAMPLE = 1 << 14, 4_000
#: Documents of a source that one task rounds.
PART = 20_000
#: Steps of the grid on which soft memberships lie, and distinct ones up to which they are summed at the driver.
GRID, GROUPS = 64, 100_000
_WORD = re.compile(r"[^\W\d_]+|\d+|\n[^\w\s]*|[:：#*•\[]")


def _features(text: str) -> np.ndarray:
    """Hashed words and line marks of a text; each counts once."""
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for w in {*_WORD.findall("\n" + text)}), np.int64))


@dataclass
class Sources:
    """Naive Bayes over sources: log priors and log probabilities of features."""

    names: list[str]
    prior: np.ndarray
    word: np.ndarray

    def posterior(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts, sources); scores are tempered by the number of features, so that long texts keep doubt."""
        out = np.empty((len(texts), len(self.names)))
        for i, t in enumerate(texts):
            f = _features(t)
            s = self.prior + self.word[:, f].sum(1) * min(1.0, 8 / max(1, len(f)) ** 0.5)
            s = np.exp(s - s.max())
            out[i] = s / s.sum()
        return out


def train_sources(docs: DataFrame, text: str, source: str, sample: int = SAMPLE, names: list[str] | None = None) -> Sources:
    """A classifier of the sources from at most ``sample`` labelled documents, taken in hash order.

    ``names`` are all sources, those of the sample unless given; one that the sample lacks has the smoothed prior and
    the words of all sources together, so that no words speak for it.
    """
    rows = (
        docs.filter(F.col(source).isNotNull() & F.col(text).isNotNull())
        .select(F.col(source).alias("s"), F.col(text).alias("t"), F.xxhash64(text, source).alias("h"))
        .orderBy("h", "s", "t")
        .limit(sample)
        .collect()
    )
    names = sorted({r.s for r in rows} if names is None else {*names})
    count, docs_of = np.ones((len(names), FEATURES)) * 0.1, np.ones(len(names))
    place = {s: k for k, s in enumerate(names)}
    for r in rows:
        if (k := place.get(r.s)) is None:
            continue
        count[k, _features(r.t)] += 1
        docs_of[k] += 1
    count[docs_of == 1] = count.sum(0)
    return Sources(names, np.log(docs_of / docs_of.sum()) if names else np.zeros(0), np.log(count / count.sum(1, keepdims=True)))


def document_tokens(docs: DataFrame, key: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, source, n_tokens) of every document with a source, in the shared folder."""
    return cut(encode(docs.filter(F.col(source).isNotNull()), {"doc": F.col(key), "source": F.col(source)}, text, vocabulary, counts=True))


def soft_members(docs: DataFrame, key: str, text: str, source: str, model: Sources, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, n_tokens, p) of every document without a source that has tokens; ``p`` is a grid point beside its posterior.

    Grid points sum to one. One row a document, whether its key repeats or not.
    """
    blind = docs.filter(F.col(source).isNull() & (F.col(text) != "")).select(F.col(key).alias("doc"), F.col(text).alias("t"))

    get = vocabulary_file(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = get()
        for b in batches:
            texts = b["t"].tolist()
            n = np.concatenate([np.diff(bpe.encode(texts[i:j])[1]) for i, j in slices(texts)]) if texts else np.zeros(0, np.int64)
            yield pd.DataFrame({"doc": b["doc"], "n_tokens": n, "p": list(_on_grid(model.posterior(texts)))})

    return cut(blind.mapInPandas(run, f"doc {dict(docs.dtypes)[key]}, n_tokens bigint, p array<double>").filter("n_tokens > 0"))


def _on_grid(p: np.ndarray) -> np.ndarray:
    """Rows of probabilities rounded down to the grid, the rest going to the largest remainders."""
    low = np.floor(p * GRID)
    rank = np.argsort(np.argsort(-(p * GRID - low), 1, kind="stable"), 1)
    return (low + (rank < np.round(GRID - low.sum(1))[:, None])) / GRID


def targets(tokens: DataFrame, mixes: DataFrame) -> DataFrame:
    """(mix_id, source, weight, max_repeats, own, target): token totals per row of ``mixes``.

    A mix's total is the tokens of all documents of its sources, each once. Weights are relative; null or negative
    weights count as 0, a null cap as 1. A source without documents owns no tokens. Repeated rows of a source in a mix
    stay separate rows with the source's tokens each.
    """
    own = tokens.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("own"))
    m = mixes.select("mix_id", "source", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(1)).alias("max_repeats"))
    m = m.join(own, "source", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    mix = Window.partitionBy("mix_id")
    once = F.when(F.row_number().over(Window.partitionBy("mix_id", "source").orderBy("weight")) == 1, F.col("own")).otherwise(0)
    m = m.withColumn("once", once).withColumn("total", F.sum("once").over(mix)).withColumn("all", F.sum("weight").over(mix))
    m = m.withColumn("target", F.when(F.col("all") > 0, F.col("weight") / F.col("all") * F.col("total")).otherwise(F.lit(0.0)))
    return m.select("mix_id", "source", "weight", "max_repeats", "own", "target")


class Rates:
    """Rates of labelled documents by mix and source, and of soft ones as a function of the residuals of the steps.

    A step moves a soft document's rate by the sum over sources of p(k) * residual(k) / scale(k), then clips it to 0 and the
    document's cap; replaying the steps gives the rate without keeping a state per document. A row of a mix is ``short``
    where its labelled documents are at their bound and tokens are still missing. Rows of a source that repeat in a mix
    add up; the largest cap holds.
    """

    def __init__(self, names: list[str], goals: pd.DataFrame):
        self.names, self.mixes = names, sorted(goals.mix_id.unique())
        at, to = {m: i for i, m in enumerate(self.mixes)}, {s: i for i, s in enumerate(names)}
        shape = (len(self.mixes), len(names))
        self.target, self.cap, self.own = np.zeros(shape), np.zeros(shape), np.zeros(len(names))
        for r in goals.itertuples():
            i, k = at[r.mix_id], to[r.source]
            self.target[i, k] += r.target
            self.cap[i, k] = max(self.cap[i, k], r.max_repeats)
            self.own[k] = r.own
        self.labelled = np.zeros(shape)
        self.left = self.target.copy()
        self.steps: list[np.ndarray] = []

    def of(self, p: np.ndarray) -> np.ndarray:
        """Rates (documents, mixes) of soft memberships ``p``; a document's cap is that of its surest source, 0 outside the mix."""
        cap = self.cap[:, p.argmax(1)].T if len(p) else np.zeros((0, len(self.mixes)))
        r = np.zeros_like(cap)
        for g in self.steps:
            r = np.clip(r + p @ g.T, 0, cap)
        return r

    def short(self) -> np.ndarray:
        """(mixes, sources): rates at their bound with tokens missing."""
        return (self.labelled >= self.cap) & (self.left > 1e-9 * np.maximum(1.0, self.target))


def _sum(p: np.ndarray, n: np.ndarray, rates: Rates) -> np.ndarray:
    """Expected tokens (mixes + 1, sources) of soft memberships with ``n`` tokens: by mix at its rates; last, each once."""
    return np.concatenate([(rates.of(p) * n[:, None]).T @ p, (n @ p)[None]]) if len(p) else np.zeros((len(rates.mixes) + 1, len(rates.names)))


def _totals(groups: DataFrame, rates: Rates) -> np.ndarray:
    """:func:`_sum` over a distributed table (p, n)."""
    k = len(rates.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(rates.mixes) + 1, k))
        for b in batches:
            if len(b):
                total += _sum(np.stack(b["p"].to_numpy()), b["n"].to_numpy(float), rates)
        yield pd.DataFrame({"total": [total.ravel()]})

    parts = groups.mapInPandas(run, "total array<double>")
    cells = parts.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((len(rates.mixes) + 1) * k)
    for r in cells:
        out[r.i] = r.x
    return out.reshape(len(rates.mixes) + 1, k)


def fit(soft: DataFrame, names: list[str], goals: pd.DataFrame, steps: int = 30, close: float = 1e-4, groups: int = GROUPS) -> Rates:
    """Rates whose expected tokens meet the targets in least squares, within the caps: labelled documents, then soft ones.

    Steps end when no residual that could still shrink is above ``close`` of its mix. Up to ``groups`` distinct soft
    memberships are summed at the driver, more where they are; the rates are the same.
    """
    rates = Rates(names, goals)
    if not names or not rates.mixes:
        return rates
    for _ in range(steps):  # each source's documents move alone, so this ends after two steps
        moved = np.clip(rates.labelled + rates.left / np.maximum(rates.own, 1.0), 0, rates.cap)
        same = np.array_equal(moved, rates.labelled)
        rates.labelled, rates.left = moved, rates.target - moved * rates.own
        if same:
            break
    wanted = np.where(rates.short(), rates.left, 0.0)
    if not wanted.any():
        return rates
    by = cut(soft.groupBy("p").agg(F.sum("n_tokens").alias("n")))
    if by.count() <= groups:
        rows = by.collect()
        p, n = np.array([r.p for r in rows]).reshape(-1, len(names)), np.array([r.n for r in rows], float)
        total = lambda: _sum(p, n, rates)
    else:
        total = lambda: _totals(by, rates)
    now = total()
    scale = np.maximum(now[-1], 1.0)
    whole = np.maximum(rates.target.sum(1, keepdims=True), 1.0)
    before = None
    for _ in range(steps):
        left = wanted - now[:-1]
        if before is not None and np.abs(left - before).max() <= close * whole.min():
            break
        before = left
        rates.steps.append(np.where(rates.cap > 0, left / scale, np.minimum(left, 0) / scale))
        now = total()
    return rates


def copies(tokens: DataFrame, soft: DataFrame, rates: Rates) -> DataFrame:
    """(mix_id, doc, source, n_tokens, copies, p): whole copies of each document in each mix, at least one.

    A rate's fraction rounds up where the running sum of fractions (in order of size, within parts of at most some
    ``PART`` documents of a source and mix) passes a whole number, so each size class keeps its share of tokens. ``p``
    is null for labelled documents.
    """
    spark, mixes = tokens.sparkSession, rates.mixes
    table = [(mixes[i], rates.names[k], float(rates.labelled[i, k])) for i, k in zip(*np.nonzero(rates.labelled > 0))]
    known = tokens.filter("n_tokens > 0").join(F.broadcast(spark.createDataFrame(table, "mix_id string, source string, rate double")), "source")
    known = known.select("mix_id", "doc", "source", "n_tokens", F.lit(None).cast("array<double>").alias("p"), "rate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = rates.of(np.stack(b["p"].to_numpy())) if len(b) else np.zeros((0, len(mixes)))
            i, m = np.nonzero(r > 0)
            take = lambda c: b[c].to_numpy()[i]
            out = pd.DataFrame({"mix_id": pd.Series([mixes[x] for x in m], dtype=object), "doc": take("doc"), "source": pd.Series([None] * len(m), dtype=object), "n_tokens": take("n_tokens"), "p": pd.Series(list(take("p")), dtype=object)})
            out["rate"] = r[i, m]
            yield out

    rated = known.unionByName(soft.mapInPandas(run, f"mix_id string, doc {dict(soft.dtypes)['doc']}, source string, n_tokens bigint, p array<double>, rate double")) if rates.steps else known
    sizes = tokens.groupBy("source").agg(F.count("*").alias("n")).collect()
    parts = [(r.source, 1 + r.n // PART) for r in sizes] + [(None, 1 + (soft.count() if rates.steps else 0) // PART)]
    d = rated.join(F.broadcast(spark.createDataFrame(parts, "s string, parts bigint")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fraction = F.col("rate") - F.floor("rate")
    d = d.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(1)), "parts")).withColumn("h", F.xxhash64("doc", "mix_id"))
    order = Window.partitionBy("mix_id", "source", "part").orderBy("n_tokens", "h", "doc")
    start = F.pmod(F.xxhash64("mix_id", "source", "part"), F.lit(1000)) / 1000.0
    d = d.withColumn("sum", F.sum(fraction).over(order.rowsBetween(Window.unboundedPreceding, 0)) + start)
    d = d.withColumn("copies", (F.floor("rate") + F.when(F.floor("sum") > F.floor(F.col("sum") - fraction), 1).otherwise(0)).cast("bigint"))
    return d.filter("copies > 0").select("mix_id", "doc", "source", "n_tokens", "copies", "p")


def rated(docs: DataFrame, mixes: DataFrame, key: str, text: str, source: str, sample: int, vocabulary: str) -> tuple[DataFrame, DataFrame, DataFrame, Rates]:
    """(labelled documents' tokens, soft members, goals, fitted rates). ``mixes`` is small: its rows go to the driver."""
    docs = docs.select(key, text, source)
    tokens = document_tokens(docs, key, text, source, vocabulary)
    goals = targets(tokens, mixes.filter(F.col("mix_id").isNotNull() & F.col("source").isNotNull()))
    # all sources that own tokens, not only those of the classifier's sample, and all that a mix names
    rows = goals.toPandas()
    owners = {r.source for r in tokens.filter("n_tokens > 0").select("source").distinct().collect()}
    model = train_sources(docs, text, source, sample, sorted(owners))
    soft = soft_members(docs, key, text, source, model, vocabulary)
    wide = sorted({*owners, *rows.source}) if len(rows) else model.names
    if wide != model.names:  # sources without documents have no words: nothing belongs to them
        place = F.array(*[F.col("p")[model.names.index(s)] if s in owners else F.lit(0.0) for s in wide])
        soft = soft.withColumn("p", place)
    return tokens, soft, goals, fit(soft, wide, rows)


def short_rows(docs: DataFrame, mixes: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_id, source) of the rows of ``mixes`` that cannot reach their share: whose fitted rates are at their bound with tokens missing."""
    rates = rated(docs, mixes, key, text, source, sample, vocabulary)[3]
    rows = [(rates.mixes[i], rates.names[k]) for i, k in zip(*np.nonzero(rates.short()))] if rates.names and rates.mixes else []
    return docs.sparkSession.createDataFrame(rows, "mix_id string, source string")


def mix(docs: DataFrame, mixes: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies of each document in each mix, report of each row of ``mixes``).

    The report has the target and the capacity of the labelled documents in tokens; ``reached`` tokens, of which
    ``guessed`` are those of documents without source by their memberships, as far as the source is one of the mix;
    ``target_share``, ``share`` of the mix as it came out, and ``planned_share``, the same tokens over the mix's planned
    total: where one source is ``short`` the others keep their planned tokens, so this one still meets the target.
    ``outside`` tokens of guessed documents belong to sources that the mix does not name; they are in no share.
    Documents whose text is null or empty have no tokens and are in no mix. Rows of ``mixes`` without mix or source count
    for nothing. Empty tables give empty results.
    """
    tokens, soft, goals, rates = rated(docs, mixes, key, text, source, sample, vocabulary)
    chosen = cut(copies(tokens, soft, rates))
    reached = chosen.filter(F.col("source").isNotNull()).groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("labelled"), F.count("*").alias("documents"))
    names = F.array(*[F.lit(n) for n in rates.names]) if rates.names else F.array().cast("array<string>")
    each = chosen.filter(F.col("source").isNull()).select("mix_id", F.explode(F.arrays_zip(names.alias("s"), F.col("p").alias("p"))).alias("x"), (F.col("n_tokens") * F.col("copies")).alias("n"))
    guessed = each.filter("x.p > 0").groupBy("mix_id", F.col("x.s").alias("source")).agg(F.sum(F.col("x.p") * F.col("n")).alias("guessed"))
    named = goals.select("mix_id", "source").distinct()
    outside = guessed.join(named, ["mix_id", "source"], "left_anti").groupBy("mix_id").agg(F.sum("guessed").alias("outside"))
    table = [(rates.mixes[i], s, bool(rates.short()[i, k])) for i in range(len(rates.mixes)) for k, s in enumerate(rates.names)] if rates.names else []
    short = docs.sparkSession.createDataFrame(table, "mix_id string, source string, short boolean")
    report = goals.join(reached, ["mix_id", "source"], "left").join(guessed, ["mix_id", "source"], "left").join(short, ["mix_id", "source"], "left").join(outside, "mix_id", "left")
    report = report.fillna(0, ["labelled", "documents", "guessed", "outside"]).withColumn("reached", F.col("labelled") + F.col("guessed"))
    whole = Window.partitionBy("mix_id")
    report = report.select(
        "mix_id", "source", "weight", "max_repeats", "own", "target", (F.col("max_repeats") * F.col("own")).cast("double").alias("capacity"), "reached", "guessed", "outside", "documents",
        F.try_divide("target", F.sum("target").over(whole)).alias("target_share"),
        (F.col("reached") / F.greatest(F.sum("reached").over(whole), F.lit(1.0))).alias("share"),
        F.try_divide("reached", F.sum("target").over(whole)).alias("planned_share"),
        "short",
    )
    return chosen.select("mix_id", "doc", "source", "n_tokens", "copies"), report
