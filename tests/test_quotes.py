import pytest
from pyspark.sql import functions as F

from plumbline.core.quotes import KEYWORD, STATES, read_marker, spans
from plumbline.operators import quotes as Q


def mark(rest):
    return f"<!-- {KEYWORD}{rest} -->"


@pytest.mark.parametrize("rest", ["", " mode=verbatim", " source=self sourced=self", " source=self source=m001", " source=self mode=exact", " source=", " source=self file=", " source=M001", " source=m1a", " source=t001", " source=self mode=not-checkable", " source=self mode=not-checkable file=a"])
def test_markers_that_are_refused(rest):
    assert read_marker(mark(rest)).errors


def test_markers():
    m = read_marker(mark(' source=self location="chapter 4, line 2"'))
    assert not m.errors and m.attrs == {"source": "self", "location": "chapter 4, line 2", "mode": "verbatim"}
    assert read_marker(f"<!--{KEYWORD} source=self-->").attrs["source"] == "self"
    assert read_marker("<!-- a note -->") is None and read_marker(mark("foo source=self")) is None
    assert "QUOTE-SOURCE-TRUTH" in read_marker(mark(" source=t001")).errors


def test_spans():
    text = "\n".join(["# c", mark(" source=self"), "> one", "> two", "", "> loose", "", "```", "> example", "```", mark(" source=self"), "", "prose", mark(" source=self"), ">", mark(" source=t1"), "> x"])
    got = spans(text)
    assert [(s.state, s.text) for s in got] == [("", "one\ntwo"), ("unmarked", "loose"), ("empty", ""), ("empty", ""), ("malformed-marker", "x")]
    assert text[got[0].start : got[0].end] == "> one\n> two"
    assert {s.state for s in spans(text + "\n- > nested\n")} <= {"unsupported-structure", "unmarked", "empty", "malformed-marker"}


def states(*lines):
    return [(s.state, s.codes, s.text) for s in spans("\n".join(lines) + "\n")]


def test_quotations_that_go_on_without_a_mark():
    marker = mark(" source=self")
    got = states(marker, "> alpha", "forged continuation", "and more", "", marker, "> beta")
    assert [(s, c) for s, c, _ in got] == [("unsupported-structure", ["QUOTE-LAZY-CONTINUATION"]), ("unsupported-structure", ["QUOTE-FILE-STRUCTURE-UNSUPPORTED"])]
    for boundary in ("# heading", "- item", "* item", "+ item", "1. item", "---", "* * *", "<!-- note -->", "```", "", "   "):
        assert states(marker, "> alpha", boundary, *["```"] * (boundary == "```"))[0][0] == "", boundary
    assert states(marker, "> alpha", "---x")[0][1] == ["QUOTE-LAZY-CONTINUATION"]


def test_structure_that_never_ends_hides_nothing():
    marker = mark(" source=self")
    assert (states("# c", marker, "> alpha", "", "```md", marker, "> hidden")[-1][:2]) == ("unsupported-structure", ["QUOTE-UNTERMINATED-FENCE"])
    assert states(marker, "> alpha", "", "<!-- from here on", "> hidden")[-1][1] == ["QUOTE-UNTERMINATED-COMMENT"]
    assert {s for s, _, _ in states(marker, "> alpha", "", "```md")} == {"unsupported-structure"}


@pytest.mark.parametrize("quote", ["a.b (c)", "x \\E y", "\\Q\\E", "[a] {2} $1 ^|*", "naïve"])
def test_places_are_found_with_any_white_space(spark, quote):
    body = "\u00e9 start " + quote.replace(" ", " \r\n\t") + " end"
    row = spark.createDataFrame([(body, quote)], "body string, quote string").select(F.regexp_instr("body", Q.in_any_space(F.col("quote"))).alias("n")).first()
    assert row.n == body.index(quote.split(" ")[0]) + 1


def test_judged(spark):
    bodies = {
        "m001": f"{mark(' source=self')}\n> one  two\n> three\n\n{mark(' source=self')}\n> absent\n\n> loose\n",
        "m002": f"{mark(' source=m001')}\n> naïve three\n\n{mark(' source=m009')}\n> x\n\n{mark(' source=self')}\n> x\n\n{mark(' source=self file=source.b')}\n> second\n",
        "m003": f"{mark(' source=self')}\n> AB\n\n{mark(' source=self mode=not-checkable file=source.bin location=p1')}\n> AB\n",
        "m005": f"{mark(' source=self')}\n> one\n\n{mark(' source=m002')}\n> second\n",
        "m004": f"{mark(' source=m001 mode=not-checkable file=source.md location=p1')}\n> one\n",
    }
    files = [("materials/m001/source.md", "one two\tthree\nnaïve\nthree".encode()), ("materials/m002/source.a", b"first"), ("materials/m002/source.b", b"second \xff"), ("materials/m003/source.bin", b"\x01\x02AB"), ("materials/m005/source.md", b"one"), ("materials/m005/Source.md", b"x"), ("materials/m004/converted.md", b"")]
    table = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in files], "path string, content binary, length long")
    materials = spark.createDataFrame(list(bodies.items()), "id string, body string")
    raw = Q.raw_sources(table, "materials")
    unsound = spark.createDataFrame([("m005", "invalid"), ("m001", "complete")], "unit string, state string")
    rows = Q.judged(Q.quote_spans(materials), raw, unsound).collect()
    assert {(r.unit, r.state) for r in Q.judged(Q.quote_spans(materials.where("id = 'm005'")), raw).collect()} == {("m005", "sealed"), ("m005", "unresolved")}
    got = sorted((r.unit, r.line, r.state, tuple(r.codes)) for r in rows)
    content = dict(files)
    placed = {(r.unit, r.line): content[f"materials/{r.owner}/{r.file}"][r["at"] : r["at"] + r.size] for r in rows if r.state == "sealed"}
    assert placed == {("m001", 2): b"one two\tthree", ("m002", 2): "naïve\nthree".encode(), ("m002", 11): b"second"}
    assert all((r["at"] is None) == (r.state != "sealed") for r in rows)
    assert [c for u, _, _, c in got if u == "m005"] == [("QUOTE-SOURCE-INVALID-SET",), ("QUOTE-SOURCE-AMBIGUOUS",)]
    assert [(u, s) for u, _, s, _ in got] == [("m001", "sealed"), ("m001", "mismatch"), ("m001", "unmarked"), ("m002", "sealed"), ("m002", "source-unavailable"), ("m002", "unresolved"), ("m002", "sealed"), ("m003", "mismatch"), ("m003", "binary-cold-debt"), ("m004", "mismatch"), ("m005", "source-unavailable"), ("m005", "unresolved")]
    assert {s for _, _, s, _ in got} <= set(STATES) and got[-3][3] == ("QUOTE-NOT-CHECKABLE-ON-TEXT",)
    assert {r.unit: (r.state, r.n) for r in Q.raw_states(raw, materials).collect()} == {"m001": ("complete", 1), "m002": ("complete", 2), "m003": ("complete", 1), "m004": ("empty", 0), "m005": ("invalid", 1)}


@pytest.mark.parametrize(("name", "valid"), [("source.md", True), ("source.tar.gz", True), ("source.a", True), ("source", False), ("source.", False), ("sources.md", False), ("SOURCE.md", False), (".source.md", False)])
def test_raw_names(spark, name, valid):
    table = spark.createDataFrame([(f"materials/m001/{name}", bytearray(b"abc"), 3)], "path string, content binary, length long")
    row = Q.raw_sources(table, "materials").first()
    assert (row.name, row.valid, row.digest) == (name, valid, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
