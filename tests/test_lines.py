"""Numbered lines, ledgers of any size, and edit scripts."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.core import state
from plumbline.operators import diff, ids
from plumbline.sources import lines, shared_dir


@pytest.fixture
def splits(spark):
    """Splits of a few bytes, so that any file has many."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def read(spark, path):
    return [(r.line_no, r.line) for r in lines.numbered_lines(spark, f"file://{path}").orderBy("line_no").collect()]


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\n\n\nb\r\n\r\n", "x" * 200 + "\n" + "é \x0c\n" * 30, "".join(f"line {i}\n" for i in range(60)) + "no end"])
def test_lines_are_numbered_across_splits(spark, splits, tmp_path, text):
    (tmp_path / "f.txt").write_bytes(text.encode())
    want = text.split("\n")
    want = want[:-1] if want[-1] == "" else want
    assert read(spark, tmp_path / "f.txt") == list(enumerate(want, 1))
    torn = text != "" and not text.endswith("\n")
    assert lines.unended(spark, f"file://{tmp_path}/f.txt").isEmpty() is not torn
    (tmp_path / "f.txt").write_bytes(b"\xef\xbb\xbf" + text.encode())
    assert lines.unended(spark, f"file://{tmp_path}/f.txt").isEmpty() is not torn


def test_parts_of_a_folder_follow_their_names(spark, splits, tmp_path):
    for name in ("part-1", "part-0", "part-2"):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(12)))
    assert read(spark, tmp_path) == list(enumerate([f"part-{k} {i}" for k in range(3) for i in range(12)], 1))


DIGEST = "0123456789abcdef" * 4
ROWS = [
    f"t001\t{DIGEST}\tverified\t1\tstd\t2026-02-01",
    "t2\t-\tfailed\t-\tstd\t2026-02-01\r",
    "t003\t-\tverifed\t1\tstd\t2026-02-01",
    "t003\t-\tverified\t1\tstd\t2026-02-01\t",
    "m001\t-\tverified\t1\ts\rd\t2026-02-01",
    "m001\t-\tverified\t1\ts\x7fd\t2026-02-01",
    "m001\tbroken",
    "x1\t-\tverified\t1\tstd\t2026-02-01",
    "t4\t-\tverified\tone\tstd\t2026-02-01",
    "t5\t-\tverified\t1\tstd\t2026-02-30",
    "t6\tABC\tverified\t1\t\t2026-02-01",
    "# a comment\twith tabs",
    "",
    "\r",
    "t007\t-\tlegacy-unbound\t2\tstd\t2026-02-01\r\r",
]


def ledger(spark, tmp_path, text, grammar=lines.VERDICTS):
    (tmp_path / "ledger.tsv").write_bytes(text.encode())
    rows, read = lines.read_ledger(spark, f"file://{tmp_path}/ledger.tsv", grammar)
    return [tuple(r) for r in rows.orderBy("row_ord").collect()], read


def by_hand(text, columns, holds, words):
    parsed, read = state.ledger_rows(text, columns)
    rows = []
    for number, values, grammar in parsed:
        fit = len(values) == columns and holds(values, grammar)
        values = (values + [None] * columns)[:columns]
        known = fit and values[2] in words
        rows.append((number, state.canon_id(values[0]) or values[0], values[1], values[2] if known else None, *values[3:], fit, known))
    return ([] if read in ("torn", "headless") else rows), read


@pytest.mark.parametrize("tail", ["\n", "", "\n# torn", "\n\t\n", "\n \t-\tverified\n", "\n \t-\n"])
def test_ledgers_equal_the_rule_for_one_text(spark, splits, tmp_path, tail):
    text = "# id\tsha\n" + "\n".join(ROWS) + tail
    assert ledger(spark, tmp_path, text) == by_hand(text, 6, state.verify_row_ok, state.VERDICTS)


def test_declarations_equal_the_rule_for_one_text(spark, tmp_path):
    rows = [[i, a, w, n, b, "note", d] for i in ("m1", "t1", "m") for a in (DIGEST, "-", "x") for w in ("declared", "no-source", "other") for n in ("0", "2", "02") for b in (DIGEST, "-") for d in ("2026-01-31",)]
    text = "".join("\t".join(r) + "\n" for r in rows) + "m2\t-\tno-source\t0\t-\tnote\t2026-13-01\n"
    assert ledger(spark, tmp_path, text, lines.DECLARATIONS) == by_hand(text, 7, state.intake_row_ok, state.DECLARATIONS)


def frame(spark, view):
    return spark.createDataFrame(list(enumerate(view, 1)), "at long, text string").repartition(3)


def script_of(spark, old, new, **more):
    shared = shared_dir(spark)
    a = frame(spark, old)
    script = diff.edit_script(a, frame(spark, new), "at", "text", shared, **more)
    back = diff.replayed(a, script, "at", "text", shared)
    return [tuple(r) for r in script.orderBy("kept_before", F.desc("change"), "place").collect()], [(r.place, r.line) for r in back.orderBy("place").collect()]


def patched(old, rows):
    """The view that a script in normal format makes of another."""
    out, at = [], 0
    for row in rows:
        if row[0] in "<-":
            continue
        if row[0] == ">":
            out.append(row[2:])
            continue
        head = row.split("c")[0].split("d")[0].split("a")[0].split(",")
        lo, hi = int(head[0]), int(head[-1])
        out += old[at : lo if "a" in row else lo - 1]
        at = lo if "a" in row else hi
    return out + old[at:]


def views(rnd, n):
    old = [rnd.choice(["", "}", "x"]) if rnd.random() < 0.4 else f"line {rnd.randint(0, 2 * n)}" for _ in range(n)]
    new = [x for x in old if rnd.random() < 0.85]
    for _ in range(n // 10):
        new.insert(rnd.randint(0, len(new)), rnd.choice([*old, "new one"]))
    return old, new[n // 2 :] + new[: n // 2] if rnd.random() < 0.4 else new


def test_scripts_replay_to_the_new_view(spark):
    rnd = random.Random(3)
    for k in range(2):
        old, new = views(rnd, 80)
        script, back = script_of(spark, old, new, **({"most_runs": 7} if k == 1 else {}))
        assert back == list(enumerate(new, 1))
        assert {(p, x) for c, p, _, x in script if c == "removed"} <= set(enumerate(old, 1))
        assert patched(old, diff.normal_format(script)) == new
        assert len(script) < len(old) + len(new)


def test_equal_and_empty_views(spark):
    view = ["a", "b", "b", "", "a"]
    assert script_of(spark, view, view) == ([], list(enumerate(view, 1)))
    script, back = script_of(spark, view, [])
    assert [r[:3] for r in script] == [("removed", i, 0) for i in range(1, 6)] and back == []
    script, back = script_of(spark, [], ["x", "x"])
    assert script == [("added", 1, 0, "x"), ("added", 2, 0, "x")] and back == [(1, "x"), (2, "x")]


def test_the_first_difference_is_found_before_and_after_the_head(spark, monkeypatch):
    monkeypatch.setattr(diff, "HEAD", 3)
    for at in (1, 3, 4, 6):
        old = [f"l{i}" for i in range(1, 7)]
        new = [*old[: at - 1], "other", *old[at:]]
        script, back = script_of(spark, old, new)
        assert script == [("removed", at, at - 1, f"l{at}"), ("added", at, at - 1, "other")] and back == list(enumerate(new, 1))


def test_a_chain_is_written_in_three_steps(spark, monkeypatch):
    names = []
    for module in (diff, ids):
        monkeypatch.setattr(module, "fresh_stored", lambda df, shared, name, f=module.fresh_stored: names.append(name) or f(df, shared, name))
    kept = diff.rising(spark.createDataFrame([(1, 2), (2, 3), (5, 1), (7, 9)], "i long, j long"), shared_dir(spark))
    assert sorted(map(tuple, kept.collect())) == [(1, 2), (2, 3), (7, 9)]
    assert names == ["runs", "dealt", "kept"]


def test_normal_format(spark):
    old, new = ["a", "b", "c", "d", "e", "f"], ["a", "x", "y", "c", "e", "f", "g"]
    script, _ = script_of(spark, old, new)
    assert diff.normal_format(script) == ["2c2,3", "< b", "---", "> x", "> y", "4d4", "< d", "6a7", "> g"]


def test_longest_chain_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(0, 7)
        starts = sorted(rnd.sample(range(0, 200, 10), n))
        rnd.shuffle(starts)
        runs = [(10 * k, j, rnd.randint(1, 9)) for k, j in enumerate(starts)]
        best = 0
        for mask in range(1 << n):
            own = [r for k, r in enumerate(runs) if mask >> k & 1]
            if all(a[1] < b[1] for a, b in zip(own, own[1:])):
                best = max(best, sum(r[2] for r in own))
        chain = diff.longest_chain(runs)
        assert sum(r[2] for r in chain) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))


def test_a_chain_among_many_runs_takes_few_bytes_a_run():
    import tracemalloc

    import numpy as np

    rnd = np.random.default_rng(7)
    n = 100_000
    runs = np.stack([np.arange(n) * 10, np.arange(n) * 10 + rnd.permutation(n) % 400, rnd.integers(1, 9, n)])
    parts = [runs[:, lo : lo + 5_000].copy() for lo in range(0, n, 5_000)]
    want = diff.longest_chain([tuple(r) for r in runs.T.tolist()])
    list(diff._batches([runs[:, :9].copy()]))  # what is loaded once counts for no run
    tracemalloc.start()
    got = sum(batch.num_rows for batch in diff._batches(parts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(want) < n
    assert peak < 120 * n


def test_runs_longer_than_a_cut_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(diff, "CUT", 8)
    pairs = [(i, i + 3) for i in range(1, 60)] + [(70 + i, 5 + i * 0) for i in range(1)]
    df = spark.createDataFrame(pairs, "i long, j long")
    kept = {tuple(r) for r in diff.rising(df.where("j <> 5 OR i = 2"), shared_dir(spark)).collect()}
    assert kept == {(i, i + 3) for i in range(1, 60)}


def test_places_count_rows_of_equal_order_once_each(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v").repartition(7)
    got = ids.places(df, "at", ["k"], shared_dir(spark)).collect()
    assert sorted(r["at"] for r in got) == list(range(1, 1001))
    assert [r.k for r in sorted(got, key=lambda r: r["at"])] == sorted(r.k for r in got)
    assert ids.places(df.limit(0), "at", ["k"], shared_dir(spark)).count() == 0
