import random

import numpy as np
from pyspark.sql import functions as F

from murmura.llm import mixing, neighbours

VEC = "id bigint, v array<float>, rep int, cosine string"


def brute(rows, k, least):
    out = {}
    for i, v in rows:
        near = []
        for j, w in rows:
            if i != j and len(v) == len(w):
                c = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 7)
                if c >= least:
                    near.append((-c, j))
        out[i] = [j for _, j in sorted(near)[:k]]
    return out


def clusters(n, dim, seed, spread=0.03):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (c + spread * rng.standard_normal(dim)).astype(np.float32)))
    return rows[:n]


def test_recall_and_ties(spark):
    rows = clusters(600, 32, 1)
    copies = [(1000 + i, rows[3][1]) for i in range(12)] + [(2000 + i, rows[7][1]) for i in range(3)]
    rows = rows + copies + [(5000 + i, v[:16]) for i, v in rows[:40]]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0, "") for i, v in rows] + [(9001, None, 0, ""), (9002, [], 0, ""), (9003, [0.0] * 32, 0, ""), (None, [1.0] * 32, 0, "")], VEC)
    got = {}
    for r in neighbours.nearest(df, "id", "v").collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    want = brute(rows, 5, 0.85)
    found = sum(len({o for _, o in got.get(i, [])} & set(w)) for i, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    assert not {9001, 9002, 9003, None} & set(got)
    # all copies: the smallest ids of the class, no more than five
    group = sorted([3, *range(1000, 1012)])
    for i in group:
        assert [o for _, o in sorted(got[i])] == [j for j in group if j != i][:5]


def test_crowded_buckets_are_split(spark):
    rng = np.random.default_rng(5)
    c = rng.standard_normal(24)
    rows = [(i, (c + 0.4 * rng.standard_normal(24)).astype(np.float32)) for i in range(400)]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0, "") for i, v in rows], VEC)
    got = {}
    for r in neighbours.nearest(df, "id", "v", bucket=60).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(rows, 5, 0.85)
    top1 = [i for i, w in want.items() if w]
    assert sum(bool(set(want[i]) & got.get(i, set())) for i in top1) > 0.5 * len(top1)
    assert max(len(x) for x in got.values()) <= 5


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], 0, "") for i, v in rows], VEC)


def lists(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.id, {})[r["rank"]] = r.other
    return {i: [o for _, o in sorted(d.items())] for i, d in got.items()}


def test_five_neighbours_at_any_cosine(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 3_000)  # several cells
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(24).astype(np.float32)) for i in range(300)]
    rows += [(400 + i, -v) for i, v in rows[:5]] + [(500, rows[9][1])] + [(600 + i, v[:7]) for i, v in rows[:4]]
    got, want = lists(neighbours.nearest(vectors(spark, rows), "id", "v")), brute(rows, 5, -2)
    assert got == want
    assert [len(got[i]) for i in (0, 400, 500, 600)] == [5, 5, 5, 3]


def around(n, dim, cosine, seed):
    """Vectors of about that cosine to each other."""
    rng = np.random.default_rng(seed)
    c = rng.standard_normal(dim)
    c /= np.linalg.norm(c)
    return [(c + ((1 / cosine - 1) / dim) ** 0.5 * rng.standard_normal(dim)).astype(np.float32) for _ in range(n)]


def recall(got, want):
    return sum(len(set(w) & set(got.get(i, []))) for i, w in want.items()) / sum(map(len, want.values()))


def test_dense_cluster_of_a_third(spark):
    rng = np.random.default_rng(8)
    rows = [(i - 700, v) for i, v in enumerate(around(500, 64, 0.99, 2))] + [(1000 + i, rng.standard_normal(64)) for i in range(1000)]
    df = vectors(spark, rows)
    want = brute(rows, 5, 0.85)
    assert recall(lists(neighbours.nearest(df, "id", "v", least=0.85)), want) > 0.97


def test_crowding_loses_no_neighbour(spark):
    rng = np.random.default_rng(5)
    c = rng.standard_normal(24)
    rows = [(i, (c + 0.4 * rng.standard_normal(24)).astype(np.float32)) for i in range(400)]
    df = vectors(spark, rows)
    whole = lists(neighbours.nearest(df, "id", "v", least=0.85))
    assert lists(neighbours.nearest(df, "id", "v", least=0.85, bucket=20)) == whole
    assert recall(whole, brute(rows, 5, 0.85)) > 0.9


def test_packing_loses_no_pair_of_uneven_vectors():
    rng = np.random.default_rng(4)
    for spike in (1, 4, 18, 60):
        x, z = rng.standard_normal((2, 3_000, 64))
        x[:, 0] = spike * np.sign(x[:, 0])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1)[:, None] * x
        c = rng.uniform(0.85, 0.9, (3_000, 1))
        y = c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)
        true = (x * y).sum(1)
        raised = (neighbours._unpack(neighbours._pack(x.astype(np.float32)))[0] * neighbours._unpack(neighbours._pack(y.astype(np.float32)))[1]).sum(1)
        assert (raised[true >= 0.85] < 0.85).mean() < 0.002, spike


def test_no_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], VEC), "id", "v").count() == 0


def test_probes_come_in_order_of_success():
    sets = neighbours.probes(8, 30)
    assert sets[0] == (0,) and len(set(sets)) == 30
    assert all(15 - i not in s for s in sets for i in s)


def test_mix_meets_targets(spark):
    rnd = random.Random(3)
    words = {"a": "alpha apple arrow", "b": "beta bread blue", "c": "gamma green grape"}
    docs = [(i, " ".join(rnd.choice(words[s].split()) for _ in range(rnd.randrange(5, 60))), s) for i, s in enumerate("a" * 150 + "b" * 100 + "c" * 10)]
    docs += [(900 + i, "alpha arrow apple " * 6, None) for i in range(20)] + [(990, None, "a"), (991, "", "b"), (992, None, None)]
    df = spark.createDataFrame([(*d, "m") for d in docs], "doc_id bigint, text string, source string, mix_id string")
    mixes = spark.createDataFrame([("x", "a", 1.0, 2), ("x", "b", 3.0, 5), ("y", "c", 0.5, 3), ("y", "a", 0.5, 1), ("z", "none", 1.0, 2), ("z", "b", None, None)], "mix_id string, source string, weight double, max_repeats int")
    chosen, report = mixing.mix(df, mixes)
    r = {(x.mix_id, x.source): x for x in report.collect()}
    assert len(r) == 6
    assert abs(r["x", "b"].share - 0.75) < 0.05 and abs(r["x", "a"].share - 0.25) < 0.05
    assert r["y", "c"].short and r["y", "c"].reached - r["y", "c"].guessed == 3 * r["y", "c"].own and r["z", "none"].short and r["z", "none"].reached == 0
    assert abs(r["y", "a"].planned_share - 0.5) < 0.05
    assert not r["z", "b"].short
    caps = {("x", "a"): 2, ("x", "b"): 5, ("y", "c"): 3, ("y", "a"): 1}
    for x in chosen.collect():
        assert x.copies >= 1 and x.doc not in (990, 991, 992)
        if x.source is not None:
            assert x.copies <= caps[x.mix_id, x.source]
    assert chosen.groupBy("mix_id", "doc").count().filter("count > 1").count() == 0


def test_source_outside_the_sample_keeps_its_share(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice(["alpha", "apple", "arrow"]) for _ in range(20)), "a") for i in range(200)]
    docs += [(500 + i, "gamma green grape " * 7, f"rare{i % 2}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    mixes = spark.createDataFrame([("x", "a", 0.9, 1), ("x", "rare0", 0.05, 9), ("x", "rare1", 0.05, 9)], "mix_id string, source string, weight double, max_repeats int")
    names = mixing.train_sources(df, "text", "source", 1).names
    chosen, report = mixing.mix(df, mixes, sample=1)  # at least one source is not in the sample
    assert len(names) == 1
    for r in report.collect():
        assert r.own > 0 and abs(r.share - r.target_share) < 0.02
    assert {r.source for r in chosen.select("source").distinct().collect()} == {"a", "rare0", "rare1"}


def test_short_rows_come_from_the_rates(spark):
    rnd = random.Random(6)
    docs = [(i % 90, "alpha beta gamma " * rnd.randrange(1, 9), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(1, None, "a"), (2, "", "b"), (3, "alpha", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = [(f"m{i}", s, rnd.random() * (s in "ab" or 0.2), rnd.choice([0, 1, 2, 5, None])) for i in range(12) for s in ("a", "b", "c", "d") if rnd.random() < 0.8] + [(None, "a", 1.0, 1), ("m1", None, 1.0, 1)]
    mixes = spark.createDataFrame(rows, "mix_id string, source string, weight double, max_repeats int")
    own = {r.source: r.n for r in mixing.document_tokens(df, "doc_id", "text", "source").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    want = set()
    for m in {r[0] for r in rows if r[0]}:
        mine = [r for r in rows if r[0] == m and r[1]]
        total, weights = sum(own.get(r[1], 0) for r in mine), sum(r[2] for r in mine)
        want |= {(m, s) for _, s, w, c in mine if w / weights * total > (1 if c is None else c) * own.get(s, 0)}
    assert {tuple(r) for r in mixing.short_rows(df, mixes).collect()} == want and want
    report = mixing.mix(df, mixes)[1].collect()
    assert {(r.mix_id, r.source) for r in report if r.short} == want
    # tokens of every copy are in the report: by labels, by memberships, or outside the mix
    chosen = mixing.mix(df, mixes)[0].groupBy("mix_id").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
    for r in chosen:
        mine = [x for x in report if x.mix_id == r.mix_id]
        assert abs(sum(x.reached for x in mine) + mine[0].outside - r.n) < 1e-6


def test_sums_at_the_driver_and_in_tasks_give_the_same_rates(spark):
    rng = np.random.default_rng(2)
    p = mixing._on_grid(rng.dirichlet([0.5] * 3, 400))
    assert np.allclose(p.sum(1), 1) and (p * mixing.GRID == np.round(p * mixing.GRID)).all()
    soft = spark.createDataFrame([(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(rng.integers(1, 50, 400), p))], "doc bigint, n_tokens bigint, p array<double>")
    import pandas as pd

    goals = pd.DataFrame([("x", "a", 1.0, 2, 100, 3000.0), ("x", "b", 1.0, 2, 900, 900.0), ("y", "c", 1.0, 4, 50, 1000.0)], columns=["mix_id", "source", "weight", "max_repeats", "own", "target"])
    one, two = (mixing.fit(soft, ["a", "b", "c"], goals, groups=g) for g in (10**6, 0))
    assert len(one.steps) == len(two.steps) > 1 and np.allclose(one.of(p), two.of(p))
    assert one.short().tolist() == [[True, False, False], [False, False, True]]
    filled = (one.of(p) * soft.toPandas().n_tokens.to_numpy()[:, None]).T @ p
    assert abs(filled[0, 0] - 2800) < 300 or (one.of(p)[:, 0][p.argmax(1) == 0] == 2).all()


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    mixes = spark.createDataFrame([("x", "a", 1.0, 2)], "mix_id string, source string, weight double, max_repeats int")
    chosen, report = mixing.mix(df, mixes)
    assert chosen.count() == 0 and report.first().target == 0 and not report.first().short
    chosen, report = mixing.mix(df, mixes.limit(0))
    assert chosen.count() == 0 and report.count() == 0
