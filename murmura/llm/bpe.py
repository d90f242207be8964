"""Corpus encoding with a public byte-level BPE vocabulary.

Each Arrow batch is cut into words by the vocabulary's pattern; distinct words not seen before are encoded together in
length-bucketed padded matrices. In every round each row merges its leftmost pair of minimum rank: one hashed lookup of
the changed pairs and one compaction for all rows. No shuffle and no driver-side data.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of the vocabulary (fixed value, published with it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Cells of one matrix; words above LONG bytes are merged by themselves, to the same ids.
CELLS, LONG = 1 << 21, 2048
#: Words kept per worker; beyond, the memory of words starts anew.
WORDS = 200_000


class Bpe:
    """Ranks, and a hashed table of every mergeable pair (id, id) to the merged id."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        r = self.ranks
        self.byte = np.array([r[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for word, rank in r.items():
            for i in range(1, len(word)):
                a, b = r.get(word[:i]), r.get(word[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._build(np.array(keys, np.uint64), np.array(values, np.int32))
        self.known: dict[str, int] = {}
        self.lists: list[np.ndarray] = []

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        at, left, self.depth = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.depth += 1
            free = self.keys[at] == np.uint64(2**64 - 1)
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot], self.vals[slot] = keys[left[won]], values[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none (negative ids are padding)."""
        out = np.full(a.shape, NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        k = a.ravel()[todo].astype(np.uint64) << np.uint64(32) | b.ravel()[todo].astype(np.uint64)
        at, flat = self._slot(k), out.ravel()
        for _ in range(self.depth):
            here = self.keys[at]
            hit = here == k
            flat[todo[hit]] = self.vals[at[hit]]
            more = ~hit & (here != np.uint64(2**64 - 1))
            if not more.any():
                break
            todo, k, at = todo[more], k[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(a.shape)

    def _matrix(self, words: list[bytes], out: list, where: list[int]) -> None:
        """Encodes words of similar length together."""
        n, width = len(words), max(map(len, words))
        ids = np.full((n, width), -1, np.int32)
        size = np.array([len(w) for w in words])
        ids[np.arange(width)[None, :] < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        row = np.array(where)
        rank = self.pair(ids[:, :-1], ids[:, 1:])
        while True:
            best = rank.min(axis=1) if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = ids[i, : size[i]].copy()
                live = ~done
                ids, rank, row, size, best = ids[live], rank[live], row[live], size[live], best[live]
                if not len(row):
                    return
            n, width = ids.shape
            r = np.arange(n)
            p = rank.argmin(axis=1)
            ids[r, p] = best
            keep = np.ones((n, width), bool)
            keep[r, p + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[r, p] = False
            rank = rank[keep].reshape(n, width - 2)
            size -= 1
            left = p > 0
            rank[r[left], p[left] - 1] = self.pair(ids[r[left], p[left] - 1], ids[r[left], p[left]])
            right = p < width - 2
            rank[r[right], p[right]] = self.pair(ids[r[right], p[right]], ids[r[right], p[right] + 1])

    def _single(self, word: bytes) -> np.ndarray:
        """A very long word: a round merges the occurrences of the minimum-rank pair together, from the left, without overlap.

        The outcome is that of merging the leftmost alone round by round, whatever the vocabulary: a round ends with the
        first occurrence whose merge makes a pair of lower rank, as that pair would come next. (Pairs that an occurrence
        makes are those of its merged id with what stands left of it, merged already, and right of it, not merged yet.)
        """
        ids = self.byte[np.frombuffer(word, np.uint8)]
        rank = self.pair(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of a run of neighbours every second
                run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
                begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                at = at[(np.arange(len(at)) - begin[run]) % 2 == 0]
            if len(at) > 1:
                new = np.full(len(at), best, np.int32)
                before = np.where(at > 0, ids[at - 1], np.int32(-1))
                before[1:][at[1:] == at[:-1] + 2] = best
                behind = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], np.int32(-1))
                lower = np.flatnonzero(np.minimum(self.pair(before, new), self.pair(new, behind)) < best)
                at = at[: lower[0] + 1] if len(lower) else at
            ids = ids.copy()
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # places after compaction
            ids = ids[keep]
            keep = np.ones(len(rank), bool)
            keep[at] = False
            rank = rank[keep]
            fix = np.unique(np.concatenate([now - 1, now]))
            fix = fix[(fix >= 0) & (fix < len(ids) - 1)]
            rank[fix] = self.pair(ids[fix], ids[fix + 1])
        return ids

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words that are not known yet."""
        base = len(self.lists)
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for i, w in enumerate(raw):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(w) > LONG:
                out[i] = self._single(w)
            else:
                buckets.setdefault((len(w) - 1).bit_length() * 2 + (len(w) * 4 > 3 << (len(w) - 1).bit_length()), []).append(i)
        for members in buckets.values():
            step = max(1, CELLS // max(len(raw[i]) for i in members))
            for j in range(0, len(members), step):
                part = members[j : j + step]
                self._matrix([raw[i] for i in part], out, part)
        self.known.update(zip(words, range(base, base + len(words))))
        self.lists += out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts in it."""
        import regex

        find = regex.compile(PATTERN).findall
        cut = [find(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.known))
        if len(self.lists) + len(fresh) > WORDS and self.lists:
            self.known, self.lists = {}, []
            fresh = list(dict.fromkeys(w for ws in cut for w in ws))
        if fresh:
            self.learn(fresh)
        known = self.known
        index = np.fromiter((known[w] for ws in cut for w in ws), np.int64, sum(map(len, cut)))
        used, back = np.unique(index, return_inverse=True)
        parts = [self.lists[i] for i in used]
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = sizes[back] if len(back) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        src = np.repeat(starts[back] - (ends - size), size) + np.arange(total) if total else np.zeros(0, np.int64)
        words = np.concatenate([[0], np.cumsum([len(ws) for ws in cut])]).astype(np.int64)
        return flat[src].astype(np.int32), np.concatenate([[0], ends])[words]


_LOADED: dict[str, Bpe] = {}
_SENT: dict[tuple[str, str], Broadcast] = {}


def vocabulary_file(spark: SparkSession, path: str) -> Callable[[], Bpe]:
    """A function that gives a vocabulary's encoder on any worker; the file (under a megabyte) is read at the driver and sent once."""
    context = spark.sparkContext
    key = (context.applicationId, path)
    if key not in _SENT:
        with open(path, "rb") as f:
            _SENT[key] = context.broadcast(f.read())
    sent = _SENT[key]

    def get() -> Bpe:
        if path not in _LOADED:
            _LOADED[path] = Bpe(sent.value)
        return _LOADED[path]

    return get


#: Characters of text taken at once, so that long documents do not fill a worker.
CHARS = 4_000_000


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHARS:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    yield a, len(texts)


def encode(df: DataFrame, keys: dict[str, Column], text: str, vocabulary: str = VOCABULARY, counts: bool = False) -> DataFrame:
    """The ``keys`` and ``ids ARRAY<INT>`` of each row's text; with ``counts``, ``n_tokens BIGINT`` instead of ids.

    Marks of special tokens in a text are plain text. Null and empty texts give the empty list (count 0). Every row
    gives one row, repeated rows too; other columns are ignored, whatever their names.
    """
    d = df.select(*[c.alias(n) for n, c in keys.items()], F.col(text).alias("__text"))
    extra = T.StructField("n_tokens", T.LongType()) if counts else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([f for f in d.schema.fields if f.name != "__text"] + [extra])

    get = vocabulary_file(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            others = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
            names = [n for n in batch.schema.names if n != "__text"]
            for a, b in slices(texts):
                ids, offsets = bpe.encode(texts[a:b])
                if counts:
                    last = pa.array(np.diff(offsets), pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[o.slice(a, b - a) for o in others], last], [*names, extra.name])

    return d.mapInArrow(run, schema)
