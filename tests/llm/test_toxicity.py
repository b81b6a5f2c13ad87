import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity as T


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        own, bad = [word() for _ in range(rnd.randint(5, 60))], i % 4 == 0
        if bad:
            for _ in range(rnd.randint(2, 5)):
                own.insert(rnd.randrange(len(own)), rnd.choice(["Zgrok!", "vilk" + word(), "vilk" + word()]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    return rows, labels


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    weights, moves = rng.normal(size=300) * 3, rng.normal(size=(2, 2))
    first = np.zeros(300, bool)
    first[[0, 1, 50, 120]] = True
    a, b, _, t = T.marginals(weights, first, np.roll(first, -1), moves)
    want = []
    for s, z in zip([0, 1, 50, 120], [1, 50, 120, 300]):
        e = np.stack([np.ones(z - s), np.exp(weights[s:z])], 1)
        alpha, beta = e.copy(), np.ones((z - s, 2))
        for k in range(1, z - s):
            alpha[k] = (alpha[k - 1] @ t) * e[k] / 100
        for k in range(z - s - 2, -1, -1):
            beta[k] = t @ (e[k + 1] * beta[k + 1]) / 100
        both = alpha * beta
        want += (both[:, 1] / both.sum(1)).tolist()
    assert np.allclose(a * b / (1 + a * b), want, atol=1e-12)


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, marks).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 80
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    for i in held:
        if labels[i][1]:
            found = {rows[i][1][s.start : s.end] for s in got[i].spans}
            assert found and all(w.lower().startswith(("zgrok", "vilk")) for w in found)


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    one, two = (sorted(tuple(r)[:2] for r in T.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert one == two


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = [(None, None, 1), (None, "vilkoro zgrok", 2), (7, "", 3), (7, "", 4), (8, " \n", 5)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows] + odd, "doc_id long, text string, score int")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1), (10**6, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, marks).collect()
    assert len(got) == 205 and all(math.isfinite(r.score) for r in got)
    assert T.toxicity(docs.limit(0), marks).count() == 0


def test_nothing_is_toxic_where_nothing_can_be_learnt(spark):
    rows, labels = corpus(60)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for some in (marks.limit(0), marks.where("toxic = 0"), marks.where("toxic = 1"), marks.withColumn("toxic", F.lit(None).cast("int"))):
        assert {(r.score, r.predicted) for r in T.toxicity(docs, some).collect()} == {(0.0, 0)}
        assert T.without_toxic(docs, T.train(*T.sample(docs, some))).count() == 60


def test_the_sample_is_bounded_where_an_id_has_many_texts(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(3, "other")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    toxic, clean, counts = T.sample(docs, marks, most_docs=5)
    assert len(toxic) in (0, 5) and len(toxic) + len(clean) > 0 and sum(counts) in (1, 50, 51)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_held_out_labels_of_the_tables(spark):
    """Precision and recall on labels that were not learnt from; the README gives the figures."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = T.toxicity(docs, marks).where(T.held_out(F.col("doc_id"))).join(marks.where("toxic IS NOT NULL"), "doc_id")
    hit, said, true = scored.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert true >= 100 and hit / true >= 0.9 and hit / said >= 0.9


def test_scores_do_not_depend_on_the_sample(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8)))
    text = lambda bad: " ".join([*(word() for _ in range(30)), *(["zgrok"] if bad else [])])
    toxic, clean = [text(True) for _ in range(100)], [text(i // 9 % 33 == 0) for i in range(900)]
    seen = [text(True) for _ in range(20)]
    score = lambda model: np.concatenate([s for _, s, *_ in T._scored(model, seen, {})]).mean()
    whole, sampled = T.train(toxic, clean), T.train(toxic, clean[::9], (100, 900))
    assert abs(score(whole) - score(sampled)) < 0.1 < score(T.train(toxic, clean[::9])) - score(whole)

    rows, labels = corpus(400)
    docs, marks = spark.createDataFrame([*rows, (900, rows[1][1])], "doc_id long, text string"), spark.createDataFrame([*labels, (900, 0)], "doc_id long, toxic int")
    usable = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    many, few = T.sample(docs, marks), T.sample(docs, marks, most_docs=40)
    assert many[2] == few[2] == tuple(len({t for t, y in usable if y == k}) for k in (1, 0))
    assert (len(few[0]), len(few[1])) == (40, 40) and (len(many[0]), len(many[1])) == many[2]
