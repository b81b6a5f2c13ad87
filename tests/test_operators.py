import random

from pyspark.sql import functions as F

from plumbline import functions as R
from plumbline.operators import counts, ids, ledgers, references, sections
from plumbline.sources import shared_dir


def norm(text):
    return " ".join(x for x in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x)


def test_contained_equals_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", "\t", " "]) for _ in range(n))
    texts = [(i // 3, text(rnd.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (None, text(30))]
    texts += texts[:5]  # repeated rows, and ids that several texts have
    quotes = []
    for j in range(120):
        own = rnd.choice(texts[:60])[1]
        lo = rnd.randrange(max(1, len(own) - 10))
        quotes.append((j // 2, own[lo : lo + rnd.choice([2, 4, 7, 10, 25, 60])]))
    quotes += [(900, None), (902, "zz yy xx ww vv uu"), (903, "w1 w2"), (904, "w1"), *quotes[:4]]
    want = sorted(((i, j) for i, t in texts if t is not None for j, q in quotes if q is not None and norm(q) in norm(t)), key=str)
    a, b = spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(quotes, "j long, q string")
    for most in (references.MOST_SENT, 0):
        assert sorted((tuple(r) for r in references.contained(a, "i", "t", b, "j", "q", most).collect()), key=str) == want
    lengths = {len(norm(q).split(" ")) for _, q in quotes if q is not None}
    assert len(want) > 100 and {1, 2, 3, 4, 5} <= lengths
    assert references.contained(a.limit(0), "i", "t", b, "j", "q").count() == references.contained(a, "i", "t", b.limit(0), "j", "q").count() == 0


def test_contained_finds_short_quotes_and_keeps_rows(spark):
    texts = [(1, "alpha beta  gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon"), (None, "xalpha betax gamma"), (4, ""), (5, None)]
    quotes = [(1, "alpha"), (2, "pha be"), (2, "pha be"), (3, "ha beta ga"), (4, "a\tbeta gamma d"), (5, ""), (6, None), (7, "alpha beta gamma delta eps"), (8, "eta"), (9, "amma"), (10, "zz yy")]
    want = sorted(((i, j) for i, t in texts if t is not None for j, q in quotes if q is not None and norm(q) in norm(t)), key=str)
    a, b = spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(quotes, "j long, q string")
    for most in (references.MOST_SENT, 0):
        assert sorted((tuple(r) for r in references.contained(a, "i", "t", b, "j", "q", most).collect()), key=str) == want


def test_multiplied_rows_hold_no_text(spark):
    a, b = spark.createDataFrame([(1, "a b c d e f")], "i long, t string"), spark.createDataFrame([(1, "a b c d e")], "j long, q string")
    plan = references.contained(a, "i", "t", b, "j", "q")._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.split("\n") if "Generate" in x)
    assert "__text" not in generate.split("false, [")[-1] and "split" not in generate


def test_groups_of_a_chain_and_a_star(spark):
    n = list(range(150))
    random.Random(1).shuffle(n)
    edges = [(f"t{a}", f"t{b}") for a, b in zip(n[:60], n[1:60])] + [("t900", f"t{x}") for x in n[70:110]] + [("t1000", "t1000"), (None, "t1")]
    got = {r.node: r.root for r in ids.groups(spark.createDataFrame(edges, "a string, b string"), "a", "b", shared_dir(spark)).collect()}
    assert len(got) == 101
    for own in (n[:60], n[70:110]):
        assert {got[f"t{x}"] for x in own} == {min(f"t{x}" for x in [*own, *([900] if own == n[70:110] else [])])}


def test_places(spark):
    rows = spark.range(500).selectExpr("cast(id * 7919 % 500 as string) s").repartition(7)
    got = sorted((r.p, r.s) for r in ids.places(rows, "p", [F.length("s"), F.col("s")], shared_dir(spark)).collect())
    assert got == [(i + 1, str(i)) for i in range(500)]


def test_a_damaged_last_row_does_not_fall_back(spark):
    rows = spark.createDataFrame([("t1", 1, "verified"), ("t1", 2, "perhaps"), ("t2", 1, "perhaps"), ("t2", 2, "failed"), ("t3", 1, None)], "id string, o long, word string")
    assert {tuple(r) for r in ledgers.quarantine(rows, "id", ["o"], "word", ["verified", "failed"]).collect()} == {("t1", "perhaps", False), ("t2", "failed", True), ("t3", None, False)}
    assert {(r.id, r.o) for r in ledgers.superseded_odd(rows, "id", ["o"], "word", ["verified", "failed"]).collect()} == {("t2", 1)}
    assert {tuple(r) for r in ledgers.voided(rows.withColumn("f", F.lit("x")).withColumn("id", F.when(F.col("o") == 1, F.col("id"))), "f", "id").collect()} == {("x", 2, True)}


def test_buckets_are_all_there(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "w string")
    assert {tuple(r) for r in counts.buckets(rows, "w", ["a", "b"], "other").collect()} == {("a", 2), ("b", 0), ("other", 2)}
    assert {tuple(r) for r in counts.buckets(rows.limit(0), "w", ["a", "b"]).collect()} == {("a", 0), ("b", 0)}


def test_digests(spark):
    import hashlib

    rows = spark.createDataFrame([("t", "b", "22"), ("t", "a", "11"), ("t", "é", "33"), ("t", "\U00010000", "44"), ("t", "￿", "55")], "tree string, name string, digest string")
    names = sorted([("b", "22"), ("a", "11"), ("é", "33"), ("\U00010000", "44"), ("￿", "55")], key=lambda x: x[0].encode())
    want = hashlib.sha256("".join(f"{n}\0{d}\n" for n, d in names).encode()).hexdigest()
    assert counts.tree_digest(rows, "tree", "name", "digest").first().tree_digest == want
    texts = ["---\r\nid: m1\r\nstatus: used\r\n---\r\nstatus: body\r\n", "---\nid: m1\n---\nstatus: body\n", "status: x\n", "---\nstatus : y\n---\n"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(R.material_body(F.col("t"))).collect()]
    assert got == ["---\nid: m1\n---\nstatus: body\n", "---\nid: m1\n---\nstatus: body\n", "status: x\n", "---\n---\n"]


def test_sections_islands_and_diffs(spark):
    lines = sections.lines_of(spark.createDataFrame([(1, "# a\nx\n- e\n  more\n# b\n- f")], "k int, t string"), "k", "t")
    carried = sections.carried(lines, "k", "line_no", F.when(F.startswith("line", F.lit("# ")), F.col("line"))).orderBy("line_no")
    assert [r.section for r in carried.collect()] == ["# a"] * 4 + ["# b"] * 2
    assert [r.entry for r in sections.islands(lines, "k", "line_no", F.startswith("line", F.lit("- "))).orderBy("line_no").collect()] == [0, 0, 1, 1, 1, 2]
    texts = spark.createDataFrame([(1, "x\n- a\n  b\n\n- c"), (2, "- a"), (3, "x\ny"), (4, ""), (5, None), (6, "- a\n- b\n")], "k int, t string")
    found = sections.runs(texts, "k", "t", lambda line: F.startswith(line, F.lit("- ")))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1, 1, None), (1, 1, 2, 4, "- a"), (1, 2, 5, 5, "- c"), (2, 1, 1, 1, "- a"), (3, 0, 1, 2, None), (4, 0, 1, 1, None), (6, 1, 1, 1, "- a"), (6, 2, 2, 3, "- b")]
    old, new = (spark.createDataFrame([(x,) for x in s], "line string") for s in ("aab", "abc"))
    assert {tuple(r) for r in sections.line_diff(old, new, "line").collect()} == {("a", "removed", 1), ("c", "added", 1)}


def test_numbers_in_ranges_equal_brute_force(spark):
    rnd = random.Random(11)
    spans = [(rnd.choice("tm"), lo := rnd.randint(-60, 60), lo + rnd.choice([-1, 0, 1, 3, 9, 10, 25])) for _ in range(60)]
    spans += [("t", 200, 200)] * 50 + [(None, 1, 5), ("t", None, 5), ("t", 5, None), ("m", 119, 128)]
    points = [(rnd.choice(["t", "m", None]), rnd.choice([None, *range(-70, 215)]), i) for i in range(500)]
    held = lambda k, n: k is not None and n is not None and any(x == k and lo is not None and hi is not None and lo <= n <= hi and hi - lo < 10 for x, lo, hi in spans)
    a, b = spark.createDataFrame(points, "letter string, n long, id long"), spark.createDataFrame(spans, "letter string, lo long, hi long")
    got = ids.in_ranges(a, "n", b, "lo", "hi", "letter", cap=10)
    assert got.columns == a.columns
    assert sorted(r.id for r in got.collect()) == [i for k, n, i in points if held(k, n)]
    plain = ids.in_ranges(a.select("n", "id"), "n", b.select("lo", "hi"), "lo", "hi", cap=10)
    assert sorted(r.id for r in plain.collect()) == [i for _, n, i in points if held("t", n) or held("m", n) or n is not None and 1 <= n <= 5]
    assert ids.in_ranges(a, "n", b.limit(0), "lo", "hi", "letter").count() == ids.in_ranges(a.limit(0), "n", b, "lo", "hi", "letter").count() == 0


def test_trees_of_many_files_are_hashed_in_order(spark):
    import hashlib

    rows = [(7, f"f{i:05}" if i % 2 else f"é{i:05}", f"{i:x}") for i in range(30_000)] + [(8, "a", "1"), (8, "a", "0"), (8, None, "2"), (8, "b", None), (None, "x", "9"), (9, None, None)]
    df = spark.createDataFrame(rows, "tree long, name string, digest string").repartition(5)
    want = {}
    for tree in (7, 8, None, 9):
        own = sorted((n.encode(), d) for t, n, d in rows if t == tree and n is not None and d is not None)
        want[tree] = hashlib.sha256(b"".join(n + b"\0" + d.encode() + b"\n" for n, d in own)).hexdigest()
    assert {r.tree: r.tree_digest for r in counts.tree_digest(df, "tree", "name", "digest").collect()} == want
    assert counts.tree_digest(df.limit(0), "tree", "name", "digest").count() == 0


def test_impact_of_all_materials(spark):
    from plumbline.operators import lookup

    materials = spark.createDataFrame([("m001", "Rent  agreement"), ("m002", "agreement"), ("m003", " "), ("m004", None), ("m005", "Rent agreement")], "id string, title string")
    truths = spark.createDataFrame([("m001", "t001"), ("m001", "t002"), ("m009", "t003")], "source string, truth string")
    citing = spark.createDataFrame([("t001", "d1"), ("t001", "d1"), ("t003", "d2"), (None, "d3")], "cited string, doc string")
    texts = spark.createDataFrame([("d1", "see m1 and m01, the Rent\nagreement"), ("d2", "am002 m0020"), ("d3", None), ("d4", "(m4)")], "unit string, body string")
    got = lookup.impact_all(materials, "id", "title", truths, "source", "truth", citing, "cited", "doc", texts, "unit", "body")
    want = {("m001", "truth", "t001"), ("m001", "truth", "t002"), ("m001", "by_truths", "d1"), ("m001", "by_id", "d1"), ("m004", "by_id", "d4"), ("m001", "by_title", "d1"), ("m002", "by_title", "d1"), ("m005", "by_title", "d1")}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_titles_with_one_common_word_between_are_looked_up_by_what_stands_around_it(spark):
    titles = [(i, f"rent{i % 50:02} of h{i:03}ouse") for i in range(600)]
    texts = [(i, f"A{i} \t{t}s, and of their own of it") for i, t in titles] + [(700, "of of of"), (701, "rent00 of"), (702, None)]
    flat = lambda rows, name: spark.createDataFrame([(i, norm(t)) for i, t in rows if t], f"{name} long, t string")
    for most_sent in (1 << 20, 20_000, 0):  # quotes are sent, only hashes, nothing
        near, few = references.candidates(flat(texts, "i"), "i", "t", flat(titles, "j").select(F.col("t").alias("q")), "q", most_sent)
        assert few == (most_sent == 1 << 20)
        assert sorted(map(tuple, near.collect())) == titles  # 361,200 pairs share the middle word
        found = references.contained(spark.createDataFrame(texts, "i long, t string"), "i", "t", spark.createDataFrame(titles, "j long, q string"), "j", "q", most_sent)
        assert sorted(map(tuple, found.collect())) == [(i, i) for i, _ in titles]


def test_impact_by_titles_that_many_share(spark):
    from plumbline.operators import lookup

    materials = [(f"m{i:03}", ["a bb c", "bb c", "x", " "][i % 4]) for i in range(40)] + [("m000", "x"), ("m000", "a  bb c"), ("m001", "bb  c"), (None, "a bb c")]
    texts = [(f"d{i}", ["a bb c", "za bb\ncz", "abb c", "x bb c", None][i % 5]) for i in range(30)] + [("d0", "x"), ("d0", "a bb c"), ("d7", "x")]
    want = {(m, "by_title", d) for m, t in materials for d, text in texts if norm(t) and text and norm(t) in norm(text)}
    empty = spark.createDataFrame([], "a string, b string")
    a, b = spark.createDataFrame(materials, "id string, title string"), spark.createDataFrame(texts, "unit string, body string")
    for most_sent in (1 << 20, 0):
        got = [tuple(r) for r in lookup.impact_all(a, "id", "title", empty, "a", "b", empty, "a", "b", b, "unit", "body", most_sent=most_sent).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_many_titles_shuffle_only_what_may_be_one(spark):
    titles = [(i, f"rent{i % 50:02} of h{i:03}ouse") for i in range(400)]
    texts = [(i, " ".join(f"w{i}x{k} {k}of{k}" for k in range(100)) + f" A{t}s") for i, t in titles]  # 80,000 words
    a, b = spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(titles, "j long, q string")
    sc = spark.sparkContext
    sc.setJobGroup("many-titles", "")
    try:
        near, few = references.candidates(a, "i", "t", b, "q", most_sent=0)
        got = sorted(map(tuple, near.collect()))
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("many-titles") for s in sc.statusTracker().getJobInfo(j).stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == titles and not few
    store = sc._jsc.sc().statusStore()
    written = [x.shuffleWriteRecords() for x in map(store.lastStageAttempt, stages) if x.status().toString() == "COMPLETE"]
    assert 400 <= max(written) < 8_000  # the table of bits has 1,024 rows and the titles' bits


def test_impact_by_titles_of_any_length_in_lists_and_parts(spark, monkeypatch):
    from plumbline.operators import lookup

    monkeypatch.setattr(lookup, "CHUNK", 3)
    monkeypatch.setattr(lookup, "SPREAD", 2)
    rnd = random.Random(5)
    words = ["a", "bb", "ccc", "ñdéd", "eeeee", "ab"]
    body = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "\n", "  "]) for _ in range(n))
    texts = [(f"d{i // 2}", body(rnd.randint(0, 40))) for i in range(50)] + [(None, body(30)), ("d0", None), ("d1", "")]
    cut = lambda t: t[rnd.randrange(max(1, len(t) - 20)) :][: rnd.choice([1, 3, 5, 6, 9, 14, 25])]
    materials = [(f"m{i:03}", cut(rnd.choice(texts[:50])[1])) for i in range(150)] + [(f"n{i}", "bb ccc ñdé") for i in range(20)]
    materials += [("m000", "bb ccc ñdé"), ("m001", " a  bb"), (None, "b ccc ñ"), ("m002", None), ("m003", " \n"), *materials[:3]]
    want = {(m, "by_title", d) for m, t in materials for d, text in texts if t and norm(t) and text and norm(t) in norm(text)}
    empty = spark.createDataFrame([], "a string, b string")
    a, b = spark.createDataFrame(materials, "id string, title string"), spark.createDataFrame(texts, "unit string, body string")
    assert {1, 2, 3, 4, 5, 6} <= {len(norm(t).split(" ")) for _, t in materials if t and norm(t)}
    for most_sent in (1 << 20, 0):
        got = [tuple(r) for r in lookup.impact_all(a, "id", "title", empty, "a", "b", empty, "a", "b", b, "unit", "body", most_sent=most_sent).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_marked_lines_and_lanes(spark):
    from plumbline.operators import lookup

    df = spark.createDataFrame([(1, "a TODO\n\nb\nTODO"), (2, None), (3, ""), (1, "TODO\r\n")], "id long, text string")
    found = lookup.marked_lines(df, "id", "text", "TODO|^$")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "TODO\r"), (1, 1, "a TODO"), (1, 2, ""), (1, 2, ""), (1, 4, "TODO"), (3, 1, "")]
    both = lookup.lanes({"gap": (df, F.col("id")), "note": (df.where("id = 1"), F.lit("x"))})
    assert sorted(tuple(r) for r in both.collect()) == [("gap", "1"), ("gap", "1"), ("gap", "2"), ("gap", "3"), ("note", "x"), ("note", "x")]
