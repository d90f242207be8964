"""The k most similar vectors of every vector, by multiprobe p-stable hashing.

Equal directions collapse into classes first (each keeps its k + 1 smallest ids). Every class sends its vector, in 4 bits
a dimension, to its own bucket and to perturbed buckets in estimated success order, in each of a few tables; a bucket's
visitors meet its residents in numpy tiles. Candidates of all tables merge and are ranked by exact cosine. Every visitor
of a crowded bucket still meets every resident, in cells of bounded blocks of both, so no task holds an unbounded group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.session import cut

#: Visitors, and residents, above which a bucket is spread over several cells.
BUCKET = 65_536
#: Rows that one tile of visitors and residents spans.
TILE = 4_096
#: Rows compared with a tile at once in the exact search.
ROWS = 1_024
#: Standard errors by which a packed cosine may be too low for a candidate (those of both vectors add up).
ERRORS = 3.0
#: What a row is to a bucket.
VISITS, LIVES = 1, 2
#: Candidates a row, on average over a bucket, above which the bucket is ranked by exact cosines instead.
MOST = 32
#: Cosine from which hashing finds nearly all pairs; rows with fewer than k of them are searched exactly.
SURE = 0.85
#: Numbers in each side of a cell of the exact search.
CELL = 1 << 22
#: Scores in single precision are this close.
SINGLE = 1e-6


def probes(hashes: int, count: int) -> list[tuple[int, ...]]:
    """The first ``count`` perturbation sets over the 2 * hashes boundary distances in ascending order.

    Sets come by their expected sum of squared distances; a set never moves one hash both ways.
    """
    m = hashes
    rank = np.arange(1, 2 * m + 1)
    e = np.where(rank <= m, rank * (rank + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - rank) / (m + 1) + (2 * m + 1 - rank) * (2 * m + 2 - rank) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = []
    heap = [(float(e[0]), (0,))]
    while heap and len(out) < count:
        cost, s = heapq.heappop(heap)
        if not any(2 * m - 1 - i in s for i in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - float(e[last]) + float(e[last + 1]), (*s[:-1], last + 1)))
            heapq.heappush(heap, (cost + float(e[last + 1]), (*s, last + 1)))
    return out


class Tables:
    """Hash functions of all tables for one dimension, from a seed."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, count: int, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        self.n, self.k, self.width = tables, hashes, width
        self.sets = probes(hashes, count)
        draw = lambda *s: rng.standard_normal(s).astype(np.float32)
        self.a, self.b = draw(tables, dim, hashes), rng.uniform(0, 1, (tables, hashes)).astype(np.float32)
        self.mult = rng.integers(1, 2**62, (tables, hashes), np.int64) | 1

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        """Bucket keys (rows, 1 + probes) of unit vectors, the own bucket first."""
        with np.errstate(over="ignore"):
            f = x @ self.a[table] / np.float32(self.width) + self.b[table]
            h = np.floor(f)
            mult = self.mult[table]
            own = (h.astype(np.int64) * mult).sum(1) + np.int64(table) * np.int64(0x632BE59BD9B4E019)
            below = f - h
            order = np.argsort(np.concatenate([below, 1 - below], 1), 1)
            out = [own]
            for s in self.sets:
                move = np.zeros(len(x), np.int64)
                for i in s:
                    j = order[:, i]
                    move += np.where(j < self.k, -mult[j % self.k], mult[j % self.k])
                out.append(own + move)
            return np.stack(out, 1)


def _mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key ^ (more * np.int64(-7046029254386353131))
        return x ^ ((x >> 29) & 0x7FFFFFFFF)


def cells(key: np.ndarray, own: np.ndarray, row: np.ndarray, ids: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, role, row) of visits; ``hot`` has the sorted keys of crowded buckets and their blocks of visitors and of residents.

    A crowded bucket's visitors go to the cells of their block and all blocks of residents, its residents to those of
    theirs and all blocks of visitors: each pair meets in one cell. Elsewhere a row that is both is sent once.
    """
    role = np.where(own, VISITS | LIVES, VISITS)
    at = np.minimum(np.searchsorted(hot[0], key), len(hot[0]) - 1) if len(hot[0]) else None
    crowded = hot[0][at] == key if at is not None else np.zeros(len(key), bool)
    if not crowded.any():
        return key, role, row
    out = [(key[~crowded], role[~crowded], row[~crowded])]
    k, r, b = key[crowded], row[crowded], at[crowded]
    visitors, residents = hot[1][b], hot[2][b]
    mixed = _mixed(ids[r], np.full(len(r), 5)) >> 20
    for role, blocks, others, which in ((VISITS, visitors, residents, np.ones(len(r), bool)), (LIVES, residents, visitors, own[crowded])):
        count = others[which]
        each = np.repeat(np.flatnonzero(which), count)
        mine, other = (mixed % blocks)[each], np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        v, h = (mine, other) if role == VISITS else (other, mine)
        out.append((_mixed(k[each], 1 + v * residents[each] + h), np.full(len(each), role), r[each]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _pack(x: np.ndarray) -> np.ndarray:
    """Unit vectors in 4 bits a dimension, relative to the largest entry, two entries a byte; last, what packing lost, in 1/255."""
    q = np.round(x / np.abs(x).max(1, keepdims=True) * 7).astype(np.int8) + 8
    if q.shape[1] % 2:
        q = np.concatenate([q, np.full((len(q), 1), 8, np.int8)], 1)
    q = q.astype(np.uint8)
    packed = q[:, ::2] << 4 | q[:, 1::2]
    lost = np.sqrt(((_entries(packed)[:, : x.shape[1]] - x) ** 2).sum(1))
    return np.concatenate([packed, np.minimum(np.ceil(lost * 255), 255).astype(np.uint8)[:, None]], 1)


def _entries(packed: np.ndarray) -> np.ndarray:
    x = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1).astype(np.float32) - 8
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None]


def _unpack(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Visitors' and residents' sides of packed vectors: their product is a cosine, raised by what packing may have cost.

    With x = x' + e (packed and lost), x.y = x'.y' + x'.f + e.y' + e.f. The last is |e||f| at most, for vectors whose lost
    parts agree (a few large entries, many small ones); the others are products with a lost part in no special direction,
    of standard error |e| or |f| over the root of the dimension.
    """
    x, lost = _entries(b[:, :-1]), b[:, -1:].astype(np.float32) / 255
    share, one = lost * np.float32(ERRORS / x.shape[1] ** 0.5), np.ones_like(lost)
    return np.concatenate([x, lost, share, one], 1), np.concatenate([x, lost, one, share], 1)


def _unit(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column as numpy arrays."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False))]).astype(np.int64)


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, h1, h2, unit): rows with a finite, non-zero vector, scaled to length 1; h1 and h2 identify a direction."""
    d = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    d = d.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in batches:
            values, offsets = _unit(b, "v")
            ids = b.column(0).to_numpy(zero_copy_only=False)
            size = np.diff(offsets)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = values[(offsets[at][:, None] + np.arange(dim)[None, :])].astype(np.float64)
                norm = np.sqrt((x * x).sum(1))
                keep = (norm > 0) & np.isfinite(norm)
                x, i = x[keep] / norm[keep][:, None], ids[at][keep]
                if not len(i):
                    continue
                q = np.round(x * 1e5).astype(np.int64)
                rng = np.random.default_rng(int(dim))
                with np.errstate(over="ignore"):
                    h = [(q * (rng.integers(1, 2**62, dim, np.int64) | 1)).sum(1) for _ in range(2)]
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * dim, pa.int32()), pa.array(x.astype(np.float32).ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(np.full(len(i), dim), pa.int32()), pa.array(h[0]), pa.array(h[1]), unit], ["id", "dim", "h1", "h2", "unit"])

    return d.mapInArrow(run, "id bigint, dim int, h1 bigint, h2 bigint, unit array<float>")


def _visits(classes: DataFrame, hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], conf: tuple, vectors: bool) -> DataFrame:
    """(key, role, who): one row a class and bucket visited, who being the id and the packed vector; else (dim, key, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        none = (np.zeros(0, np.int64),) * 3
        for b in batches:
            values, offsets = _unit(b, "unit")
            ids = b.column(0).to_numpy(zero_copy_only=False)
            size = np.diff(offsets)
            for dim in map(int, np.unique(size)):
                t = tables.setdefault(dim, Tables(dim, *conf))
                at = np.flatnonzero(size == dim)
                x = values[offsets[at][:, None] + np.arange(dim)[None, :]].astype(np.float32)
                who = np.concatenate([ids[at].astype(">i8")[:, None].view(np.uint8).reshape(len(at), 8), _pack(x)], 1) if vectors else None
                for table in range(t.n):
                    keys = t.keys(x, table)
                    row, col = np.indices(keys.shape)
                    row, own = row.ravel(), col.ravel() == 0
                    with np.errstate(over="ignore"):
                        key = keys.ravel() + np.int64(dim) * np.int64(0x51ED270B7A3F1A85 >> 1)
                    if not vectors:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), dim), pa.int32()), pa.array(key), pa.array(own)], ["dim", "key", "own"])
                        continue
                    key, role, row = cells(key, own, row, ids[at], hot.get(dim, none))
                    size_of = who.shape[1]
                    step = max(1, (1 << 30) // size_of)
                    for c in range(0, len(row), step):
                        r = row[c : c + step]
                        data = pa.py_buffer(np.ascontiguousarray(who[r]).tobytes())
                        binary = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((np.arange(len(r) + 1) * size_of).astype(np.int32).tobytes()), data])
                        yield pa.RecordBatch.from_arrays([pa.array(key[c : c + step]), pa.array(role[c : c + step], pa.int32()), binary], ["key", "role", "who"])

    return classes.select("rep", "unit").mapInArrow(run, "key bigint, role int, who binary" if vectors else "dim int, key bigint, own boolean")


def _meet(keys: np.ndarray, role: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (visitor, resident) of the buckets in one sorted block, of one dimension; keys of buckets of too many."""
    out_a, out_b, dense = [], [], []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    homes = np.add.reduceat(role >> 1, starts)
    for s, e in zip(starts[homes > 0], ends[homes > 0]):
        if e - s < 2:
            continue
        visitors, home = s + np.flatnonzero(role[s:e] & VISITS), s + np.flatnonzero(role[s:e] & LIVES)
        pairs, count = [], 0
        for a in range(0, len(visitors), TILE):
            v = visitors[a : a + TILE]
            for c in range(0, len(home), TILE):
                r = home[c : c + TILE]
                close = (x[v] @ y[r].T >= least) & (ids[v][:, None] != ids[r][None, :])
                count += np.count_nonzero(close)
                if count > MOST * (e - s):
                    break
                i, j = np.nonzero(close)
                pairs.append((ids[v[i]], ids[r[j]]))
            if count > MOST * (e - s):
                dense.append(keys[s])
                break
        else:
            out_a += [a for a, _ in pairs]
            out_b += [b for _, b in pairs]
    join = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    return join(out_a), join(out_b), np.array(dense, np.int64)


def _meet_exactly(keys: np.ndarray, role: np.ndarray, ids: np.ndarray, x: np.ndarray, least: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, other, cosine) of the buckets in one sorted block: the k best residents of each visitor, and visitors of each resident."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for s, e in zip(starts, np.append(starts[1:], len(keys))):
        visitors, home, away = (s + np.flatnonzero(z) for z in (role[s:e] & VISITS, role[s:e] & LIVES, role[s:e] == VISITS))
        yield from _exact(x[visitors], ids[visitors], x[home], ids[home], k, least)
        if len(home) and len(away):
            yield from _exact(x[home], ids[home], x[away], ids[away], k, least)


def _exact(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, other, cosine) by blocks of rows of ``x``: the k best rows of ``y`` of ``least`` or more, ties to the smaller id."""
    if not len(y):
        return
    order = np.argsort(others, kind="stable")
    at = order[np.minimum(np.searchsorted(others, ids, sorter=order), len(order) - 1)]
    me = np.where(others[at] == ids, at, -1)
    for a in range(0, len(x), ROWS):
        v = x[a : a + ROWS]

        def best(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cosine = np.concatenate([np.round((v[i[c : c + 65_536]].astype(np.float64) * y[j[c : c + 65_536]]).sum(1), 7) for c in range(0, len(i), 65_536)])
            order = np.lexsort((others[j], -cosine, i))
            w = i[order]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
            keep = order[(rank < k) & (cosine[order] >= least)]
            return i[keep], j[keep], cosine[keep]

        top, low = np.full((len(v), k), -np.inf, np.float32), np.full(len(v), least - SINGLE, np.float32)
        held, count = [], 0
        for c in range(0, len(y), TILE):
            score = v @ y[c : c + TILE].T
            own = np.flatnonzero((me[a : a + ROWS] >= c) & (me[a : a + ROWS] < c + TILE))
            score[own, me[a + own] - c] = -np.inf
            hit = np.flatnonzero(score.max(1) >= low)
            if not len(hit):
                continue
            s = score[hit]
            top[hit] = np.partition(np.concatenate([top[hit], s], 1), -k, 1)[:, -k:]
            low[hit] = np.maximum(least - SINGLE, top[hit].min(1) - 2 * SINGLE)
            i, j = np.nonzero((s >= low[hit][:, None]) & (s > -np.inf))
            held.append((hit[i], j + c))
            count += len(i)
            if count > ROWS * TILE // 4:
                i, j, _ = best(*(np.concatenate(z) for z in zip(*held)))
                held, count = [(i, j)], len(i)
        if count:
            i, j, cosine = best(*(np.concatenate(z) for z in zip(*held)))
            yield ids[i + a], others[j], cosine


def _all_pairs(some: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, cosine): the k best classes of each of ``some`` by comparing with all, in cells of bounded blocks of both."""
    blocks = lambda d, n: d.groupBy("dim").agg(F.ceil(F.count("*") * F.first("dim") / CELL).cast("int").alias(n))
    sizes = blocks(some, "p").join(blocks(classes, "q"), "dim")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = some.select("dim", "rep", "unit").join(F.broadcast(sizes), "dim").select("dim", "rep", "unit", block("p").alias("i"), each("q").alias("j"))
    right = classes.select("dim", "rep", "unit").join(F.broadcast(sizes), "dim").select("dim", "rep", "unit", block("q").alias("j"), each("p").alias("i"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = t.column("rep").to_numpy()
            return pa.compute.list_flatten(t.column("unit")).to_numpy().astype(np.float32).reshape(len(ids), -1), ids

        import pyarrow.compute  # noqa: F401

        found = list(_exact(*read(one), *read(two), k, least)) if one.num_rows and two.num_rows else []
        a, b, c = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(run, "a bigint, b bigint, cosine double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks of whole buckets of a partition sorted by key."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count, size = count + b.num_rows, size + b.nbytes
        if count >= 100_000 or size >= 64 << 20:
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if last:
                yield rows.slice(0, last)
                rest = rows.slice(last).combine_chunks()
                held, count, size = rest.to_batches(), rest.num_rows, 0
    if held:
        yield pa.Table.from_batches(held)


def _pairs(visits: DataFrame, least: float) -> DataFrame:
    """Directed candidate pairs (key, a, b) of all buckets; a bucket of too many gives only its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for rows in _blocks(batches):
            key = rows.column("key").to_numpy()
            role = rows.column("role").to_numpy()
            who = rows.column("who").combine_chunks()
            size = pa.compute.binary_length(who).to_numpy(zero_copy_only=False)
            joined = who if isinstance(who, pa.Array) else pa.concat_arrays(who.chunks)
            for n in np.unique(size):
                m = size == n
                sub = joined if m.all() else joined.filter(pa.array(m))
                offs = np.frombuffer(sub.buffers()[1], np.int32)[sub.offset : sub.offset + len(sub) + 1]
                raw = np.frombuffer(sub.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(sub), n)
                ids = np.ascontiguousarray(raw[:, :8]).view(">i8").ravel().astype(np.int64)
                a, b, dense = _meet(key[m], role[m], ids, *_unpack(raw[:, 8:]), least)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b)], ["key", "a", "b"])
                none = pa.nulls(len(dense), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(dense), none, none], ["key", "a", "b"])

    return visits.mapInArrow(run, "key bigint, a bigint, b bigint")


def _ranked(visits: DataFrame, least: float, k: int) -> DataFrame:
    """(a, b, cosine) of the buckets of (key, role, rep, unit), by exact cosine, as many as can be among the k best of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for rows in _blocks(batches):
            key, role, ids = (rows.column(c).to_numpy() for c in ("key", "role", "rep"))
            size = pa.compute.list_value_length(rows.column("unit")).to_numpy()
            for n in np.unique(size):
                m = size == n
                x = pa.compute.list_flatten(rows.column("unit").filter(pa.array(m))).to_numpy().reshape(-1, n)
                for found in _meet_exactly(key[m], role[m], ids[m], x, least, k):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in found], ["a", "b", "cosine"])

    return visits.mapInArrow(run, "a bigint, b bigint, cosine double")


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, least: float | None = None, tables: int | None = None, hashes: int | None = None, width: float = 2.2, visits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(id, other, cosine, rank): the ``k`` most similar other rows of each row; with ``least``, only those of that cosine or more.

    Hashing finds pairs of cosine ``SURE`` or more. Rows with fewer than ``k`` of these are compared with all rows, so a
    row has fewer than ``k`` neighbours only if there are no more; ``least`` of ``SURE`` or more leaves that step out.

    Vectors compare with those of equal dimension only; null, empty, all-zero and not finite vectors have no
    neighbours and are none. Ties of cosine go to the smaller id; ids must be unique and not null (rows without id are
    left out). Vectors of the same direction (to 1e-5) are of cosine 1. An empty table gives no rows. Other columns are
    ignored. ``hashes`` per table follows the row count unless given: 10 up to half a million rows, then 1.2 more for each
    doubling; ``tables`` follow the hashes unless given, so that recall stays: 6 for 10, then 1.22 times as many for each more. Measured recall is in the README.
    """
    least = -np.inf if least is None else least
    sure = max(least, SURE)
    unit = unit_vectors(df, key, vector)
    same = Window.partitionBy("dim", "h1", "h2").orderBy("id")
    few = unit.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    classes = cut(few.groupBy("dim", "h1", "h2").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("unit", "n").alias("unit")))
    n = classes.count()
    m = hashes or 10 + max(0, round(1.2 * np.log2(max(n, 1) / 5e5)))
    # a hash more keeps about 0.82 of the near pairs together, so tables grow by its inverse
    conf = (tables or round(6 * 1.22 ** max(0, m - 10)), m, width, visits)

    # visitors and residents per bucket; crowded ones (at most tables * (1 + visits) * rows / bucket of them) spread over cells
    hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    if n > bucket:
        counts = _visits(classes, hot, conf, False).groupBy("dim", "key").agg(F.count("*").alias("v"), F.count_if("own").alias("r"))
        crowded = counts.filter(F.col("v") > bucket).orderBy("dim", "key").collect()
        for dim in {r.dim for r in crowded}:
            blocks = [(r.key, -(-r.v // bucket), -(-max(r.r, 1) // bucket)) for r in crowded if r.dim == dim]
            hot[dim] = tuple(np.array(z, np.int64) for z in zip(*blocks))
    sent = _visits(classes, hot, conf, True)
    met = cut(_pairs(sent.repartition("key").sortWithinPartitions("key"), sure))
    dense = met.filter("key IS NOT NULL").select("key").distinct()
    near = met.filter("key IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # exact cosines; both directions; rows with too few
    left = classes.select(F.col("rep").alias("a"), F.col("unit").alias("a_unit"))
    right = classes.select(F.col("rep").alias("b"), F.col("unit").alias("b_unit"))
    dot = F.aggregate(F.zip_with("a_unit", "b_unit", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = near.join(left, "a").join(right, "b").select("a", "b", F.round(dot, 7).alias("cosine")).filter(F.col("cosine") >= sure)
    sides = exact.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s"), "cosine").select("s.a", "s.b", "cosine")
    if not dense.isEmpty():
        rep = F.conv(F.hex(F.substring("who", 1, 8)), 16, -10).cast("bigint")
        stay = sent.join(dense, "key", "left_semi").select("key", "role", rep.alias("rep"))
        full = stay.join(classes.select("rep", "unit"), "rep").repartition("key").sortWithinPartitions("key")
        sides = sides.unionByName(_ranked(full, sure, k)).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    if least < SURE:
        sides = cut(sides)
        # a neighbour counts with all its class, of which up to k + 1 ids are known
        size = classes.select(F.col("rep").alias("b"), F.size("ids").alias("n"))
        known = sides.join(size, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("known"))
        few = classes.join(known, "rep", "left").filter(F.coalesce("known", F.lit(0)) + F.size("ids") - 1 < k).drop("known")
        some = cut(few.select("dim", "rep", "unit"))
        searched = _all_pairs(some, classes, k, least)
        sides = sides.join(some.select(F.col("rep").alias("a")), "a", "left_anti").unionByName(searched)
    best = sides.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).filter(F.col("r") <= k)
    # members of classes
    a_ids, b_ids = classes.select(F.col("rep").alias("a"), F.col("ids").alias("x")), classes.select(F.col("rep").alias("b"), F.col("ids").alias("y"))
    # a class of more than k members fills its members' lists by itself
    outside = best.join(a_ids, "a").join(b_ids, "b").filter(F.size("x") <= k).select(F.explode("x").alias("id"), F.slice("y", 1, k).alias("others"), "cosine").select("id", F.explode("others").alias("other"), "cosine")
    inside = classes.filter(F.size("ids") > 1).select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("cosine")).filter("id != other")
    lists = outside.unionByName(inside).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("rank") <= k)
    # members beyond the k + 1 kept: their list is the class's first k
    salts = 16
    full = classes.filter(F.size("ids") > k).select("dim", "h1", "h2", "ids", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    more = unit.select("id", "dim", "h1", "h2", F.pmod(F.col("id"), F.lit(salts)).cast("int").alias("salt")).join(full, ["dim", "h1", "h2", "salt"]).filter(F.col("id") > F.element_at("ids", -1))
    more = more.select("id", F.posexplode(F.slice("ids", 1, k)).alias("rank", "other")).select("id", "other", F.lit(1.0).alias("cosine"), (F.col("rank") + 1).alias("rank"))
    return lists.unionByName(more)
