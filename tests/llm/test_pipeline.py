import random

import corpus_pipeline
import pytest
from plumbline.llm import packing, toxicity
from plumbline.llm.encoding import tokenizer_path

from .test_decontamination import brute as overlaps_by_hand
from .test_line_dedup import brute as dedup_by_hand
from .test_ngram_join import brute as groups_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic words, a shared passage, near copies and a benchmark passage."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8)))
    line = lambda n=14: " ".join(word() for _ in range(n))
    passage, item = [line() for _ in range(8)], line(30)
    base = line(120).split()
    docs, labels = [], []
    for i in range(240):
        lines = [line() for _ in range(rnd.randint(2, 7))]
        if i % 5 == 0:
            lines[0] += " vilk" + word() + " zgrok vilk" + word() + " zgrok"
        if i % 7 == 1:
            lines[1:1] = passage
        if i % 11 == 2:
            copy = base[:]
            copy[rnd.randrange(120)] = word()
            lines = [" ".join(copy)]
        if i % 13 == 3:
            lines.insert(1, "so " + item + " end")
        docs.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0 and i % 11 != 2)))
    docs += [(900, None, None, None, None), (901, "", "en", "src0", 0), (950, next(d[1] for d in docs if d[0] == 6), "en", "src0", 0)]
    home = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item), (2, line(25))], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
            docs = spark.createDataFrame(docs.collect(), before.schema)
        kept[name] = docs
    given = rows(spark.read.parquet(f"{folder}/documents.parquet"))

    toxic = {i for i in given if i < 900 and i % 5 == 0 and i % 11 != 2}
    assert set(rows(kept["toxicity"])) == set(given) - toxic
    model = toxicity.train(*toxicity.sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))
    scored = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), model)
    assert {r.doc_id for r in scored.where("predicted = 1").collect()} == toxic

    first = rows(kept["toxicity"])
    second = rows(kept["line_dedup"])
    by_hand = dedup_by_hand([(i, t) for i, t in first.items() if t is not None])
    emptied = {i for i, (text, n) in by_hand.items() if n and not text.strip()}
    assert second == {i: by_hand[i][0] if t is not None else None for i, t in first.items() if i not in emptied}
    assert emptied == {950} and second[901] == "" and second[900] is None
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].collect() if r.text != first[r.doc_id])

    groups = groups_by_hand(list(second.items()), 5, 80, 100)
    third = rows(kept["ngram_join"])
    assert third == {i: second[i] for i, _, c in groups if i == c} and len(third) < len(second)

    leaks = {d for d, _, _ in overlaps_by_hand(list(third.items()), [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])}
    fourth = rows(kept["decontamination"])
    assert leaks and fourth == {i: t for i, t in third.items() if i not in leaks}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    pieces = {}
    for r in kept["packing"].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(fourth)
    for i, own in pieces.items():
        ids = [*library.encode(fourth[i] or "", add_special_tokens=False).ids, packing.END_ID]
        data = b"".join(r.ids for r in sorted(own, key=lambda r: r.start))
        assert data == b"".join(x.to_bytes(4, "little") for x in ids)


def test_run_is_the_stages_in_turn(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() == out.select("sequence_id").distinct().count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, home, docs, labels, benchmark, schema=FIELDS):
    spark.createDataFrame(docs, schema).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def ids_of(df):
    return sorted((r.doc_id for r in df.select("doc_id").distinct().collect()), key=str)


def test_empty_tables(spark, tmp_path):
    docs = [(i, f"document {i} speaks of its own number {i} and of nothing else at all", "en", "s", 1) for i in range(6)]
    assert ids_of(corpus_pipeline.run(spark, put(spark, tmp_path / "a", docs, [], []))) == list(range(6))
    assert ids_of(corpus_pipeline.run(spark, put(spark, tmp_path / "b", docs, [(i, 1, None) for i in range(6)], [(1, None), (2, "number")]))) == list(range(6))
    assert corpus_pipeline.run(spark, put(spark, tmp_path / "c", [], [(1, 1, 1), (2, 1, 0)], [(1, "x " * 20)])).count() == 0


def test_repeated_rows_and_ids(spark, tmp_path):
    """No text is lost where rows share an id, and of repeated rows one stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = [(1, a), (1, a), (5, a), (5, b), (9, b + " more"), (9, b + " more"), (None, "one of a kind")]
    home = put(spark, tmp_path / "d", docs, [], [], "doc_id long, text string")  # without n_chars and the rest
    out = corpus_pipeline.run(spark, home)
    assert ids_of(out) == [1, 5, None]
    got = [(r.doc_id, r.doc_tokens) for r in out.where("start = 0").collect()]
    assert len(got) == 3
