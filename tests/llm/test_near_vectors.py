import math
import random

import numpy as np
import pytest

from plumbline.llm import near_vectors as V


def brute(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    fit = [r[1] is not None and len(r[1]) > 0 and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    unit = [V.unit(np.array([np.float32(r[1])], float))[0] if ok else None for r, ok in zip(rows, fit)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= least or (unit[i] == unit[j]).all()):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    first = {}
    for i, r in enumerate(rows):
        first[root(i)] = min((x for x in (first.get(root(i)), r[0]) if x is not None), default=None)
    return sorted(((r[0], links[i], first[root(i)], r[0] is not None and r[0] == first[root(i)]) for i, r in enumerate(rows)), key=str)


def vectors(seed, n=400, size=16):
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    bases = rng.normal(size=(25, size))
    out = []
    for i in range(n):
        v = bases[rnd.randrange(25)] + rnd.choice([0, 0.05, 0.1, 0.2, 1]) * rng.normal(size=size)
        out.append((i, [float(np.float32(x)) for x in v * rnd.choice([1, 1, 3])], rnd.choice([0, 1, None]) if rnd.random() < 0.4 else 0))
    return out + [(n + i, out[0][1], 0) for i in range(6)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted((tuple(r) for r in V.near_duplicates(df, **kw).collect()), key=str)


@pytest.mark.parametrize("kw", [{}, {"block": 16}, {"sample": 40, "lists": 5, "codewords": 4, "subspaces": 3}])
def test_equals_all_pairs(spark, kw):
    rows = vectors(1)
    assert run(spark, rows, **kw) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (None, [1.0, -0.0], 0), (10, [1.0, 0.0, 0.0], 0), (8, [1.0, 0.0], 1), (None, None, 0), (11, [1e30, 1e-30], 0), (12, [-1.0, 0.0], 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0], 0, 5, "x"), (2, [2.0], 0, 6, "y")], "vec_id long, embedding array<float>, label int, class long, x string")
    assert sorted(tuple(r) for r in V.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
