import hashlib
import math
import random

import numpy as np
import pytest

from quernstone.llm import annulus as op


def brute(rows, k=16, rounds=3, dimensions=64):
    kept = [(i, [math.floor(v) * 64 if abs(v) > 1e15 else math.floor(64 * v) for v in e]) for i, e in rows if e is not None and len(e) == dimensions and all(v is not None and math.isfinite(v) for v in e)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    if not c:
        return []
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d(v, x), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == n] for n in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(groups, c, strict=True)]
    last = [near(v) for _, v in kept]
    total = {n: sum(x for x, m in last if m == n) for n in range(len(c))}
    fit = lambda v: v if v < 2**63 else None
    whole = fit(sum(total.values())) if all(x < 2**63 for x, _ in last) else None
    own = lambda n: fit(total[n]) if all(x < 2**63 for x, m in last if m == n) else None
    return sorted(((i, n, fit(x), own(n), whole, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (x, n) in zip(kept, last, strict=True)), key=str)


def got(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return sorted(map(tuple, op.clusters(df, **options).collect()), key=str)


def vectors(n, seed=1, spread=1.0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(9)]
    return [(k, [m + rng.gauss(0, 0.2) for m in middle[k % 9]]) for k in range(n)]


def test_against_brute_force(spark):
    v = vectors(300)
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [1.0] * 63 + [float("nan")]), (906, [float("-inf")] + [1.0] * 63), (None, v[3][1]), (5, v[7][1]), (5, v[5][1]), (907, [0.0] * 64), (908, [-1e-9] * 64)]
    rows = v + odd
    assert got(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(k % 5), *[0.0] * 63]) for k in range(60)]
    assert got(spark, rows) == brute(rows)


def test_numbers_beyond_64_bits(spark):
    rows = vectors(60) + [(100 + k, [s * 10.0 ** (3 * k)] * 63 + [0.3]) for k in range(14) for s in (1, -1)] + [(300, [1.7e308] * 64)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, n):
    rows = vectors(n)
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(None, [1.0] * 64)]) == []


def test_floats_and_clashing_columns(spark):
    rows = [(i, np.array(e, np.float32).tolist()) for i, e in vectors(50)]
    assert got(spark, rows, "float") == brute(rows)
    df = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance int, k int")
    assert sorted(map(tuple, op.clusters(df).collect()), key=str) == brute(rows)


def test_the_annulus_prunes_and_loses_nothing():
    rng = np.random.default_rng(4)
    c = [[int(v) for v in rng.integers(-20, 20, 64) * (k + 1)] for k in range(16)]
    x = rng.integers(-20, 20, (500, 64)) * rng.integers(1, 17, (500, 1))
    number, d = op.Rings(c).nearest(x)
    every = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(2)
    assert (d == every.min(1)).all() and (number == every.argmin(1)).all()
