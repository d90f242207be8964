import random

import pytest

from murmura.operators.coverage import coverage, periods

SCHEMA = "m string, s bigint, e bigint, shard string, delta int"


def brute(rows, most):
    out = []
    for m in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((s, e) for k, s, e in rows if k == m and s is not None and e is not None and e > s)
        found = []
        for s, e in iv:
            if found and s <= found[-1][1]:
                found[-1][1] = max(found[-1][1], e)
            else:
                found.append([s, e])
        out += [(m, "period", s, e) for s, e in found]
        out += [(m, "gap", a[1], b[0]) for a, b in zip(found, found[1:]) if b[0] - a[1] < most]
    return sorted(out)


def test_random_intervals_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        s = rnd.randrange(-2000, 6000)
        e = s + rnd.choice([0, -5, 1, 7, 40, 300, 2500])
        rows.append((rnd.choice("ab"), s, e))
    rows += [("c", 0, 100), ("c", 100, 200), ("c", 250, 300), ("d", -50, 5000), ("d", 120, 130), (None, 1, 2), ("e", None, 5), ("e", 5, None)] + rows[:20]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for shard in (50, 1000):
        got = sorted(tuple(r) for r in coverage(df, "m", "s", "e", 60, shard).collect())
        assert got == brute(rows, 60)


def test_empty_and_far_times(spark):
    assert periods(spark.createDataFrame([], SCHEMA), "m", "s", "e").count() == 0
    far = spark.createDataFrame([("a", 0, 2**63 - 1, "", 0), ("a", 5, 6, "", 0)], SCHEMA)
    assert periods(far, "m", "s", "e").count() == 1


@pytest.mark.parametrize("shard", [10, 100])
def test_swallowed_periods(spark, shard):
    df = spark.createDataFrame([("a", 0, 1000, "", 0), ("a", 333, 337, "", 0), ("a", 1000, 1001, "", 0)], SCHEMA)
    assert [tuple(r)[1:] for r in periods(df, "m", "s", "e", shard).collect()] == [(0, 1001)]
