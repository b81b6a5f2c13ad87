import random
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import ngram_join as J
from plumbline.llm.components import connected


def brute(rows, n=3, num=90, den=100):
    """(doc_id, n_shingles, component_id) of rows by comparing all pairs."""
    sets = [frozenset(J.shingles(t, n).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else min(x for x in (least[r], d) if x is not None)
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def varied(seed, count=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, bases = [], [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 5, 12, 40, 150]))] for _ in range(14)]
    for i in range(count):
        own = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            at = rnd.randrange(len(own) + 1)
            own[at : at + rnd.choice([0, 1])] = [rnd.choice(words)]
        rows.append((i, " ".join(own)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in J.clusters(df, **kw).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = varied(seed)
    assert run(spark, rows) == brute(rows)


def test_blocks_of_large_groups_lose_no_link(spark):
    rows = varied(3)
    assert run(spark, rows, most_sets=6) == brute(rows)
    assert run(spark, rows, most_near=3, most_sets=40) == brute(rows)
    assert run(spark, rows, most_near=5, most_sets=6) == brute(rows)


def test_other_threshold(spark):
    rows = varied(4, 100)
    assert run(spark, rows, n=5, similarity=(80, 100)) == brute(rows, 5, 80, 100)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "One two"), (7, "one\vtwo"), (None, "one two"), (9, "a b c d"), (9, "a b c d"), (10, "É é x"), (11, "é é x"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8)], "doc_id long, text string, class long, component_id long")
    assert [tuple(r) for r in J.clusters(df).orderBy("doc_id").collect()] == [(1, 1, 1), (2, 1, 1)]
    assert J.clusters(df.limit(0)).count() == 0


def test_sets_that_link_agree_in_a_part():
    rnd = np.random.default_rng(5)
    edges, known = [1], {}
    for _ in range(300):
        size = int(rnd.integers(1, 120))
        own = np.unique(rnd.integers(0, 2**64, size, np.uint64))
        cut, more = int(rnd.integers(0, size // 9 + 2)), int(rnd.integers(0, size // 9 + 2))
        other = np.unique(np.concatenate([own[rnd.permutation(len(own))[cut:]], rnd.integers(0, 2**64, more, np.uint64)]))
        same = len(np.intersect1d(own, other))
        if len(other) and Fraction(same, len(own) + len(other) - same) >= Fraction(9, 10):
            assert set(J.signatures(own, 90, 100, edges, known).tolist()) & set(J.signatures(other, 90, 100, edges, known).tolist())


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(7)
    nodes = rnd.sample(range(10**6), 300)
    edges = [(a, b) for a, b in zip(nodes[:100], nodes[1:100])] + [(nodes[100], x) for x in nodes[101:200]] + [(x, x) for x in nodes[200:210]] + [(nodes[250], None)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "src long, dst long").repartition(16)).collect()}
    assert len({got[n] for n in nodes[:100]}) == 1 and len({got[n] for n in nodes[100:200]}) == 1 and len(got) == 200


def test_parities_never_part_sets_that_link():
    rng = np.random.default_rng(9)
    for size in (5, 300, 1_300, 1_400, 5_000, 12_000):
        own = np.unique(rng.integers(0, 2**64, size, np.uint64))
        near = np.unique(np.concatenate([own[: int(0.93 * len(own))], rng.integers(0, 2**64, int(0.03 * size), np.uint64)]))
        far = np.unique(np.concatenate([own[: len(own) // 4], rng.integers(0, 2**64, 3 * size // 4, np.uint64)]))
        sets = [own, near, far]
        found = J.may_link([1, 2, 3], [len(s) for s in sets], [J.parities(s) for s in sets], 80, 100)
        assert (1, 2) in found and (size < 1_000 or len(found) == 1)


def test_one_of_each_row(spark):
    rnd = random.Random(12)
    a, b, c = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (9, b + " more", 4), (9, b + " more", 5), (7, c, 6), (7, c, 7), (7, c, 8), (2, "", 9), (2, "", 10), (3, None, 11), (None, c + " end", 12), (None, None, 13), (4, "x y", 14), (4, "X y", 15)]
    df = spark.createDataFrame([(i, t, k, k, k) for i, t, k in rows], "doc_id long, text string, k long, __mark long, mark long")
    got = J.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((r.k, r.doc_id, r.text) for r in got.collect())
    # of a's rows 1, of b's 5, of c's the one without an id, all rows without words, and one spelling of x y
    assert [k for k, _, _ in kept if k in (1, 2, 3, 4, 5, 9, 10, 11, 12, 13)] == [1, 3, 9, 10, 11, 12, 13]
    assert sum(k in (6, 7, 8) for k, _, _ in kept) == 0 and sum(k in (14, 15) for k, _, _ in kept) == 1
    again = J.one_of_each(df.where("k IN (6, 7, 8)"))
    assert [r.text for r in again.collect()] == [c]
    assert J.one_of_each(df.limit(0)).count() == 0
