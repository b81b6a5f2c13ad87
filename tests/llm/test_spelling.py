import random
import re
import zlib
from collections import Counter

import pytest
from plumbline.llm import spelling as S


def differ_by_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def invented(rnd, n, letters="abé", lo=1, hi=7):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(lo, hi))) for _ in range(n)})


def test_numbers_are_places_and_states_are_shared():
    words = invented(random.Random(1), 400)
    automaton = S.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("abab" * 4) == automaton.number("") == -1
    shared = S.Automaton(sorted(a + b for a in ("x", "y", "z") for b in ("ing", "ed", "s")))
    assert len(shared.edges) == 6  # the three beginnings lead to one state: start, behind the first, i, in, e, end
    assert S.Automaton([]).completed("ab", 1) == [] and S.Automaton([""]).number("") == 0


def test_completions_are_all_near_words_with_the_half_once():
    rnd = random.Random(2)
    words = invented(rnd, 500)
    automaton = S.Automaton(words)
    for word in words[:120] + invented(rnd, 60):
        for exact in range(len(word) + 1):
            found = automaton.completed(word, exact)
            want = [i for i, w in enumerate(words) if w[:exact] == word[:exact] and differ_by_one(w, word)]
            assert sorted(found) == want, (word, exact)


def test_blocks_that_can_hold_near_words_are_never_skipped():
    rnd = random.Random(3)
    words = invented(rnd, 300)
    for word in words[:100]:
        for other in words:
            if differ_by_one(word, other):
                for exact in range(len(word) + 1):
                    if other[:exact] == word[:exact]:
                        assert all(S.may_meet(word, exact, other[:k]) for k in range(len(other) + 1)), (word, other, exact)


@pytest.mark.parametrize("letters", [S.BLOCK_LETTERS, 60])
def test_near_words_equal_brute_force(spark, letters):
    rnd = random.Random(4)
    counts = {w: rnd.randint(1, 6) for w in invented(rnd, 250)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n) for r in S.near_words(df, block_letters=letters).collect()}
    want = {}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if differ_by_one(v, w))
        want[w] = (n, len(near), near[0][1] if near else None, -near[0][0] if near else None)
    assert got == want


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    words = {w: n for w, n in counts.items() if n >= 3}
    form = {}
    near = {w: sorted((-words[v], v) for v in words if differ_by_one(v, w)) for w in words}
    for w, n in words.items():
        form[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def test_variants_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["planet", "plane", "planets", "plänet", "PLANET", "Été", "étude", "ÉTUDE", "etude", "x" * 300, "a-b", "river", "rivers", "1234567", "half" * 3]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(150)] + [(1, None), (None, "planet planet"), (None, "planet planet"), (2, ""), (3, "÷×÷×÷ " * 4)]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(df, block_letters=200).collect()}
    assert got == brute(docs) and len(got) >= 20
    assert S.variants(df.limit(0)).count() == 0
    assert S.variants(df.where("text IS NULL")).count() == 0


def test_long_ways_end_at_one_root_and_circles_are_named(spark):
    way = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(40)] + [("w40", None)]
    df = spark.createDataFrame(way, "word string, form string")
    assert {(r.word, r.root) for r in S.roots(df).collect()} == {(w, "w40") for w, f in way if f}
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string")
    with pytest.raises(RuntimeError):
        S.roots(circle, most_rounds=4)
