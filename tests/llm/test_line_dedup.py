import random

from pyspark.sql import functions as F

from plumbline.llm import line_dedup as L


def sentences(rnd, n, words=12):
    return [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.text, r["__n_removed"]) for r in L.dedup_lines(df, **kw).collect()}


def brute(rows):
    """Removal from the chunks' texts in plain Python: neighbouring lines with text, and lines of fifty words."""
    first, cut = {}, {}
    for doc_id, text in sorted(set(rows)):
        lines = text.split("\n")
        inked = [i for i, x in enumerate(lines) if x.strip()]
        cut[doc_id] = [(a, b + 1) for a, b in zip(inked, inked[1:])] + [(i, i + 1) for i in inked if len(lines[i].split()) >= 50]
        for a, b in cut[doc_id]:
            body = tuple(lines[a:b])
            first[body] = min(first.get(body, (doc_id, a)), (doc_id, a))
    out = {}
    for doc_id, text in rows:
        lines = text.split("\n")
        gone = {i for a, b in cut[doc_id] if first[tuple(lines[a:b])] != (doc_id, a) for i in range(a, b)}
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def corpus(seed=1, docs=40):
    rnd = random.Random(seed)
    passages = [sentences(rnd, n) for n in (6, 8, 5)] + [sentences(rnd, 1, 70)]
    rows = []
    for i in range(docs):
        own = sentences(rnd, rnd.randint(1, 8))
        if i % 3:
            at = rnd.randrange(len(own) + 1)
            own[at:at] = passages[i % 4]
        rows.append((i, "\n".join(own)))
    return rows, passages


def test_equals_brute_force(spark):
    rows, _ = corpus()
    rows += [(100, "\n".join(["same"] * 30)), (101, "a\na\na\na"), (102, "\n\n\n"), (103, rows[4][1])]
    assert run(spark, rows) == brute(rows)


def test_passages_stay_once_and_unshared_lines_stay(spark):
    rows, passages = corpus(2, 60)
    got = run(spark, rows)
    shared = {line for p in passages for line in p}
    for doc_id, text in rows:
        assert [x for x in text.split("\n") if x not in shared] == [x for x in got[doc_id][0].split("\n") if x and x not in shared]
    left = [x for text, _ in got.values() for x in text.split("\n") if x in shared]
    assert set(left) == shared
    before = [x for _, text in rows for x in text.split("\n") if x in shared]
    assert len(left) - len(shared) < 0.35 * (len(before) - len(shared))
    assert sum(x in passages[3] for x in left) == 1  # a long line is a chunk of its own


def test_clean_documents_are_left_alone(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(sentences(rnd, 5) + ["a common line"])) for i in range(30)]
    assert run(spark, rows) == {i: (t, 0) for i, t in rows}


def test_odd_rows(spark):
    passage = "\n".join(sentences(random.Random(4), 9))
    df = spark.createDataFrame([(None, passage, 1), (5, passage, 2), (5, passage, 3), (6, None, 4), (7, "", 5), (8, "one line", 6)], "doc_id long, text string, id long")
    got = L.dedup_lines(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "id", "__n_removed"}
    text = {r.id: r.text for r in got}
    assert text[1] == passage and text[2] == text[3] and len(text[2]) < len(passage) / 3
    assert text[4] is None and text[5] == "" and text[6] == "one line"
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_without_sending_hashes(spark):
    rows, _ = corpus(5)
    assert run(spark, rows, most_sent=0) == brute(rows)


def test_only_dataframe_functions(spark):
    plan = L.dedup_lines(spark.createDataFrame([(1, "a\nb"), (2, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_planted_passages_are_found_whole(spark):
    rnd = random.Random(6)
    rows, want, n = [], {}, 0
    for copies in (2, 10):
        for length in range(2, 9):
            for _ in range(6):
                passage = sentences(rnd, length)
                if length == 5:
                    passage[2] += " " + sentences(rnd, 1, 60)[0]  # short lines beside a long one
                if length == 7:
                    passage[3:3] = ["", " \t"]  # blank lines inside
                for copy in range(copies):
                    before, after = sentences(rnd, 3), sentences(rnd, 2)
                    kept = before + (passage if copy == 0 else []) + after
                    rows.append((n, "\n".join(before + passage + after)))
                    want[n] = ("\n".join(kept), len(before + passage + after) - len(kept))
                    n += 1
    assert run(spark, rows) == want


def test_a_common_line_before_a_blank_one_stays(spark):
    rnd = random.Random(7)
    rows = [(i, "\n\n".join([*sentences(rnd, 2), "a common line", *sentences(rnd, 2)])) for i in range(20)]
    assert run(spark, rows) == {i: (t, 0) for i, t in rows}


def test_lines_are_compared_by_their_bytes(spark):
    rows, _ = corpus(8)
    got = run(spark, rows, hash_of=F.length)  # nearly every hash stands for many lines
    want = brute(rows)
    assert all(got[i] in ((text, 0), want[i]) for i, text in rows)
    few = run(spark, rows, hash_of=lambda x: F.when(F.rlike(x, F.lit("^w[1-4]")), 7).otherwise(F.xxhash64(x)))
    assert any(few[i] != want[i] for i, _ in rows) and any(few[i][1] for i, _ in rows)
    whole = dict(rows)
    for i, (text, n) in few.items():  # what is removed stands elsewhere, what would have been unequal stays
        assert n <= want[i][1] and set(text.split("\n")) <= set(whole[i].split("\n"))


def test_clashing_names_and_emptied_documents(spark):
    body = "\n".join(sentences(random.Random(10), 5))
    names = ["__mark", "__of", "__id", "__lines", "__ranges", "__left", "lines", "hashes", "key", "own"]
    df = spark.createDataFrame([(i, t, *[i] * len(names)) for i, t in ((1, body), (2, body), (3, ""), (4, None), (5, body + "\nmore of it"))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "__n_removed"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: body, 2: "", 3: "", 4: None, 5: "more of it"}
    assert {r.doc_id for r in L.without_emptied(out).collect()} == {1, 3, 4, 5}


def test_words_of_a_long_line(spark):
    rnd = random.Random(9)
    lines = [gap.join(f"w{rnd.randrange(10**6)}" for _ in range(n)) for gap, n in (("\t", 50), ("\u00a0", 50), (" \t ", 50), (" ", 49))] + ["short" + " " * 80 + "line"]
    rows, want = [], {}
    for i, line in enumerate(lines):
        for copy in range(2):
            own = sentences(rnd, 2)
            gone = copy and i < 3
            rows.append((2 * i + copy, "\n".join([own[0], line, own[1]])))
            want[2 * i + copy] = ("\n".join(own), 1) if gone else (rows[-1][1], 0)
    assert run(spark, rows) == want
