import random

from plumbline.llm import decontamination as D


def brute(docs, items, window=D.WINDOW, share=D.SHARE):
    """(doc, item, diagonal) of every aligned window that is alike enough."""
    out = set()
    for d, text in docs:
        own = D.tokens(text)
        for i, item in items:
            theirs = D.tokens(item)
            w = min(window, len(theirs)) if len(theirs) >= D.MIN_WORDS else 0
            for p in range(len(own) - w + 1):
                for q in range(len(theirs) - w + 1):
                    if w and 100 * sum(a == b for a, b in zip(own[p : p + w], theirs[q : q + w])) >= share * w:
                        out.add((d, i, p - q))
    return out


def planted(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 7, 8, 9, 10, 12, 13, 20, 40])))) for i in range(12)]
    docs = []
    for d in range(50):
        own = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        if d % 2:
            part = rnd.choice(items)[1].split()
            lo = rnd.randrange(max(1, len(part) // 3))
            part = [rnd.choice(words) if rnd.random() < 0.12 else w for w in part[lo:]]
            at = rnd.randrange(len(own) + 1)
            own[at:at] = part
        docs.append((d, " ".join(w.upper() + "," if rnd.random() < 0.1 else w for w in own)))
    return docs, items


def run(spark, docs, items, **kw):
    schema = "doc_id long, text string" + ", item_id long" * (len(docs[0]) > 2)
    return D.overlaps(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"), **kw).collect()


def test_masks_are_lossless():
    assert D.lossless(D.MASKS, D.WINDOW, D.allowed(D.WINDOW))
    for n in range(1, D.WINDOW):
        assert D.masks_of(n, D.WINDOW, D.SHARE) == D.masks_for(n)
        assert D.lossless(D.masks_for(n), n, D.allowed(n)), n


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = planted(seed)
        docs += docs[:5]
        one, two = (run(spark, docs, items, most_sent=most) for most in (D.MOST_SENT, 0))
        assert {(r.doc_id, r.item_id, r.doc_start - r.item_start) for r in one} == brute(docs, items)
        assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_documents_without_overlaps(spark):
    docs, items = planted(3)
    docs = [(i, t, k) for k, (i, t) in enumerate([*docs, (None, None), (None, docs[1][1]), docs[1]])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string, mark long"), spark.createDataFrame(items, "item_id short, text string")
    hit = {d for d, _, _ in brute([(k, t) for _, t, k in docs], items)}
    for most in (D.MOST_SENT, 0):
        got = D.without_overlaps(a, b, most_sent=most)
        assert got.columns == a.columns and {r.mark for r in got.collect()} == {k for _, _, k in docs} - hit
        assert {r.item_id for r in D.overlaps(a, b, most_sent=most).collect()} == {i for _, i, _ in brute([(k, t) for _, t, k in docs], items)}
        assert D.without_overlaps(a, b.limit(0), most_sent=most).count() == len(docs)
        assert D.without_overlaps(a.limit(0), b, most_sent=most).count() == 0


def test_short_items_hit_nothing(spark):
    docs, items = [(1, "w1 w2 w3 w4 w5 w6 w7 w8")], [(1, "w7"), (2, "w1 w2 w3 w4 w5 w6 w7"), (3, "W1 w2, w3 w4 w5 w6 w7 x")]
    assert [(r.item_id, r.n_words, r.n_equal) for r in run(spark, docs, items)] == [(3, 8, 7)]
    assert len(run(spark, docs, items, min_words=1)) == 3


def test_odd_rows(spark):
    item = " ".join(f"x{i}" for i in range(20))
    docs = [(1, None, 1), (2, "", 2), (None, item, 3), (4, item, 4), (4, item, 5), (5, "... !!", 6)]
    got = run(spark, docs, [(1, item), (2, None), (3, ""), (3, item)])
    assert sorted((str(r.doc_id), r.item_id, r.n_words, r.n_equal) for r in got) == sorted((d, i, 20, 20) for d in ("4", "4", "None") for i in (1, 3))
    assert run(spark, docs, []) == []
    assert D.overlaps(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0
