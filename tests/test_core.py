import itertools

import pytest

from plumbline.core import cards as C
from plumbline.core import markdown as M
from plumbline.core import registers as G
from plumbline.core import state as S

INNER = ["## no heading", "- [open] x", "<!-- c", "--- ", "text"]


@pytest.mark.parametrize(("eol", "fence", "inner"), list(itertools.product(["\n", "\r\n"], ["```", "````", "~~~", "~~~~"], INNER)))
def test_fences_hide_what_is_in_them(eol, fence, inner):
    scanned = M.scan(eol.join(["# A", fence + "info", inner, fence, "after"]))
    assert [x.context for x in scanned.lines] == ["text", "fence", "fence", "fence", "text"]
    assert [x.title for x in scanned.lines if x.level] == ["A"] and not scanned.problems


def test_fence_grammar():
    assert M.scan("    ```\n# h").lines[1].level == 1
    assert M.scan("``` a`b\n# h").lines[1].level == 1
    assert M.scan("````\n```\n# h\n````").lines[2].context == "fence"
    assert M.scan("~~~\n```\n~~~\n# h").lines[3].level == 1
    assert M.scan("```\nx").problems == [(1, "unterminated-fence")]
    assert M.scan("x\n<!-- y").problems == [(2, "unterminated-comment")]
    assert M.scan("---\nx").problems == [(1, "unterminated-frontmatter")]
    assert M.scan("<!-- a -->\nb").problems == [] and M.scan("<!-- a --> b").problems == [(1, "comment-suffix")]


def test_comments_mask_and_make_nothing():
    scanned = M.scan("a <!-- b --># c\n<!--\n# x\n```\n-->\n# y")
    assert scanned.lines[0].live == "a " + " " * 10 + "# c" and scanned.lines[0].level == 0
    assert [x.title for x in scanned.lines if x.level] == ["y"]


@pytest.mark.parametrize(("text", "state"), [("x", "missing"), ("[open", "unclosed"), ("[] x", "blank"), ("[ ] x", "blank"), ("[{kind}] x", "placeholder"), ("[open] x", "known"), ("[Open] x", "unknown"), ("[open ] x", "unknown")])
def test_slots(text, state):
    assert M.slot(text, ("open",))[0] == state


@pytest.mark.parametrize("text", ["---\na: 1\n---\nbody", "--- \na : 1\n---\t\nbody", "---\na:1\n---\nbody", "---\r\na: '1' # c\r\n---\r\nbody"])
def test_frontmatter_spellings(text):
    card = C.read_card(text)
    assert (card.state, card.fields["a"], card.body) == ("ok", "1", "body")


def test_frontmatter_values():
    card = C.read_card("---\nclaim: \"a # b\" # c\ntags: [a, 'b, c', \"d\"] # x\nclaim: again\nopen: [a\nempty:\n---\n")
    assert card.fields["claim"] == "a # b" and card.lists["tags"] == ["a", "b, c", "d"]
    assert card.duplicates == ["claim"] and card.unclosed_lists == ["open"] and card.fields["empty"] == ""
    assert C.read_card("---\na: 1\n").state == "unclosed" and C.read_card("a: 1").state == "missing"


def test_lists_are_set_in_place():
    text = "---\r\ntags: [a, b] # c\r\nother: [a]\n---\r\ntags: [a]\r\n"
    assert C.set_list(text, "tags", lambda t: ["z", *t[1:]]) == text.replace("tags: [a, b]", "tags: [z, b]")
    assert C.set_list("---\ntags: [a\n---\n", "tags", lambda t: ["z"]) == "---\ntags: [a\n---\n"
    with pytest.raises(ValueError, match="frontmatter"):
        C.set_fields("---\na: 1\n", {"b": "2"})


STATES = ["[open]", "[ruled]", "[Open]", "[opened]", "[]", "[{state}]", "open", "[open"]
OWNERS = ["[user-only]", "[recommended]", "[machine]", "[nobody]", "[]", "", "{owner}"]
BODIES = ["text", "", "`code` text"]
AFTER = ["", "  more", "\n  more", "  - sub"]


def test_human_queue_grid():
    cases = list(itertools.product(STATES, OWNERS, BODIES, AFTER))
    assert len(cases) == 672
    for state, owner, body, after in cases:
        got = G.queue_items(M.scan(f"## Human queue\n\n- {state} {owner} {body}\n{after}\n"))
        if state in ("[open]", "[ruled]"):
            assert len(got) == 1 and got[0][1] == state[1:-1]
            assert got[0][2] == (owner[1:-1] if owner in OWNERS[:3] else "")
        else:
            assert got == []


@pytest.mark.parametrize(("parent", "child"), list(itertools.product(range(0, 8, 2), repeat=2)))
def test_only_deeper_entries_are_detail(parent, child):
    text = "## Human queue\n\n" + " " * parent + "- [open] a\n" + " " * child + "- [open] b\n"
    assert len(G.queue_items(M.scan(text))) == (1 if child > parent else 2)


def test_questions_and_gaps():
    text = "- [open] a\n- [answered] b\n- [proposed] c\n- [later] d\n- e\n  - [open] f\n- (none)\n- [{state}] {text}\n"
    assert [s for _, s, _ in G.questions(M.scan(text))] == ["open", "answered", "proposed", "unrecognised", "unrecognised", "unrecognised"]
    good = "## Open\n\n- [declared] a\n  more\n- [symmetry] b\n\n## Accepted\n\n- [reference] c\n"
    assert [(s, k) for _, s, k, _ in G.gap_register(M.scan(good))] == [("Open", "declared"), ("Open", "symmetry"), ("Accepted", "reference")]
    for bad in (good.replace("[symmetry]", "[both]"), good.replace("[symmetry] b", "[symmetry] [declared] b"), good.replace("## Accepted\n", ""), good + "\n## Open\n", "- [declared] x\n\n" + good, good.replace("- [symmetry] b", "prose"), "```\n" + good):
        assert "malformed" in [k for _, _, k, _ in G.gap_register(M.scan(bad))], bad


@pytest.mark.parametrize("shape", ["- {}", "* {}", "+ {}", "1. {}", "> {}", "| {} |", "**{}**", "- [ ] {}", "```\n{}\n```", "<!-- x --> {}"])
@pytest.mark.parametrize("kind", ["[contradiction]", "[Unsupported]", "[missing required]", "[unsup​ported]", "[missing-required"])
def test_gate_blocks_every_shape(shape, kind):
    inside = f"## Fidelity violations\n\n{shape.format(kind + ' x')}\n\n## Findings\n"
    outside = f"## Fidelity violations\n\n## Findings\n\n{shape.format(kind + ' x')}\n"
    assert G.gate_findings(inside) and G.gate_findings(outside)


@pytest.mark.parametrize("text", ["Prose about a contradiction.", "A [note] in brackets.", "<!-- - [unsupported] old -->", "\n"])
def test_gate_passes_prose(text):
    assert G.gate_findings(f"## Fidelity violations\n\n- [{{kind}}] {{what}}\n\n## Findings\n\n{text}\n") == []


@pytest.mark.parametrize(("line", "codes"), [("## [typo] open", ["REVIEW-KIND-UNKNOWN"]), ("# [typo] open", ["REVIEW-KIND-UNKNOWN"]), ("--> [typo] open", ["REVIEW-KIND-UNKNOWN"]), ("- [typo] open", ["REVIEW-KIND-UNKNOWN"]), ("# Part [contradiction] open", ["GATE-OPEN"]), ("# [{kind}] {what}", ["GATE-OPEN"]), ("- [Contradiction] open", ["GATE-OPEN"]), ("- [ ] open", ["GATE-OPEN"]), ("- [{kind}] {what}", [])])
def test_gate_names_unknown_kinds(line, codes):
    assert [c for _, c in G.gate_findings(f"# Fidelity violations\n\n{line}\n\n# Findings\n\n[note] x\n")] == codes


def test_versions():
    wanted = {("", "3"): "missing", ("3", ""): "missing", ("x", "3"): "not-integer", ("3.0", "3.0"): "not-integer", ("2", "3"): "disagree", ("3", "2"): "disagree", ("99", "99"): "future"}
    assert {k: S.negotiate(*k) for k in wanted} == {k: (None, "VERSION-MISMATCH", v) for k, v in wanted.items()}
    assert [S.negotiate(v, v) for v in ("3", "2", "1", "0")] == [(3, "", ""), (None, "VERSION-BELOW-FLOOR", "upgrade"), (None, "VERSION-BELOW-FLOOR", "bridge"), (None, "VERSION-BELOW-FLOOR", "bridge")]


def test_schema_lists():
    whole = "verify.sections: A|B|C\ngaps.sections: O|P\ngaps.enum.kind: k\n"
    assert S.read_contract(None, "absent") == (S.CONTRACT, []) and S.read_contract(whole, "ok") == ({"verify.sections": ["A", "B", "C"], "gaps.sections": ["O", "P"], "gaps.enum.kind": ["k"]}, [])
    for old, new, code in (("A|B|C", "|B|C", "SCHEMA-VERIFY-SECTIONS"), ("A|B|C", "A|B", "SCHEMA-VERIFY-SECTIONS"), ("O|P", "O|O", "SCHEMA-UNREADABLE"), ("O|P", "|P", "SCHEMA-UNREADABLE"), ("O|P", "O|P|Q", "SCHEMA-UNREADABLE"), ("gaps.enum.kind: k\n", "", "SCHEMA-UNREADABLE")):
        lists, found = S.read_contract(whole.replace(old, new), "ok")
        assert [c for c, _ in found] == [code] and (lists["verify.sections"] == []) == (code == "SCHEMA-VERIFY-SECTIONS") and (lists["gaps.sections"] == []) == (code == "SCHEMA-UNREADABLE")
    assert {c for c, _ in S.read_contract(None, "unreadable")[1]} == {"SCHEMA-UNREADABLE"}


def test_ids_and_days():
    assert [S.canon_id(x) for x in ("t1", "t001", "t0001", "m12", "c1000", "t" + "9" * 30, "x1", "t", "t-1")] == ["t001", "t001", "t001", "m012", "c1000", "t" + "9" * 30, None, None, None]
    assert [S.is_day(x) for x in ("2024-02-29", "2023-02-29", "2026-7-3", "", "٢٠٢٤-01-01")] == [True, False, False, False, False]


GOOD = {"id": "c001", "targets": ["t001"], "candidates": [{"claim": "x", "source": "m001"}], "created": "2026-01-01"}


@pytest.mark.parametrize(
    ("change", "code"),
    [({"id": "c1"}, "CONF-ID"), ({"id": "t001"}, "CONF-ID"), ({"targets": ["t1"]}, "CONF-TARGET"), ({"targets": "t001"}, "CONF-TARGET"), ({"targets": ["t001", "t001"]}, "CONF-TARGET"), ({"created": "today"}, "CONF-CREATED"), ({"note": ""}, "CONF-NOTE"), ({"note": 3}, "CONF-NOTE"), ({"candidates": []}, "CONF-CANDIDATE"), ({"candidates": [{"claim": "x"}]}, "CONF-CANDIDATE"), ({"candidates": [{"claim": "x", "source": "t001"}]}, "CONF-CANDIDATE"), ({"candidates": [{"claim": "x", "source": "m001", "rank": 1}]}, "CONF-KEY-UNKNOWN"), ({"winner": 1}, "CONF-KEY-UNKNOWN")],
)
def test_conflict_refusals(change, code):
    with pytest.raises(S.Refused) as e:
        S.check_entry(GOOD | change)
    assert e.value.code == code


def test_state_files():
    for text, code in (("{", "CONF-JSON"), ("[]", "CONF-SHAPE"), ('{"version":2,"open":[]}', "CONF-SHAPE"), ('{"version":1,"open":[],"closed":[]}', "CONF-KEY-UNKNOWN"), ('{"version":1,"version":1,"open":[]}', "CONF-JSON")):
        with pytest.raises(S.Refused) as e:
            S.read_conflicts(text)
        assert e.value.code == code
    entries = [GOOD | {"id": "c1000"}, GOOD | {"id": "c002", "targets": [], "note": "é"}, GOOD]
    text = S.write_conflicts(entries)
    assert [e["id"] for e in S.read_conflicts(text)] == ["c001", "c002", "c1000"] and S.write_conflicts(S.read_conflicts(text)) == text and text.endswith("}\n")
    with pytest.raises(S.Refused, match="CONF-DUP"):
        S.read_conflicts(S.write_conflicts([GOOD, GOOD]))
    for n in ("{", "[]", '{"version":1,"next":{}}', '{"version":1,"next":{"conflict":1,"material":1,"truth":0}}', '{"version":1,"next":{"conflict":1,"material":1,"truth":1.5}}', '{"version":1,"next":{"conflict":1,"material":1,"truth":1234567890123456}}'):
        with pytest.raises(S.Refused, match="IDSEQ"):
            S.read_sequences(n)
    assert S.grant({"truth": 999, "material": 1, "conflict": 1}, "truth") == ("t999", {"truth": 1000, "material": 1, "conflict": 1})


def test_ledger_grammar():
    row = "t001\t" + "a" * 64 + "\tverified\t1\ts\t2026-01-01"
    fit = lambda text: [S.verify_row_ok(f, ok) for _, f, ok in S.ledger_rows(text, 6)[0]]
    assert fit(row + "\n" + row + "\r\n# c\n\n") == [True, True]
    for bad in (row + "\t\n", row.replace("\t1\t", "\t\t1\t") + "\n", row.replace("a" * 64, "A" * 64) + "\n", row.replace("01-01", "13-01") + "\n", row.replace("\ts\t", "\ts\x01\t") + "\n"):
        assert fit(bad) == [False]
    assert S.ledger_rows(row, 6)[1] == "torn" and S.ledger_rows("\t\t\t\t\t\n", 6)[1] == "headless" and S.ledger_rows("", 6) == ([], "ok")
    intake = ["m001", "a" * 64, "declared", "1", "b" * 64, "-", "2026-01-01"]
    assert S.intake_row_ok(intake, True)
    for i, v in ((0, "t001"), (1, "-"), (3, "0"), (4, "-"), (6, "2026-02-30")):
        assert not S.intake_row_ok(intake[:i] + [v] + intake[i + 1 :], True)


def test_contract():
    assert S.contract("a: x|y|\nb: x||y\nc: x|x\nd: z\r\n# e: q\n") == {"a": ["x", "y"], "b": [], "c": [], "d": ["z"]}


def test_coverage_and_verified_units():
    rows = G.coverage_rows(M.scan("## m001\n\n- rent: t1, t002\n- notice: skipped, no\n- bare\n\n## legacy\n\n- m002\n"))
    assert [(m, e, t, ok) for _, m, e, t, ok in rows] == [("m001", "rent", ["t1", "t002"], True), ("m001", "notice", [], True), ("m001", "- bare", [], False), ("legacy", "m002", [], True)]
    ids, prose = G.verified_units(M.scan("## Verified units\n\n- t001 by hand verified\n| t003-t004 | verified |\n- t005 unverified\nt006 was verified once\n"))
    assert ids == ["t001", "t003-t004"] and len(prose) == 2


def test_pointer_blocks():
    from plumbline.core.pointer import block_state

    own = "<!-- a -->\nread this\n<!-- z -->"
    states = [block_state(t, own, "<!-- a -->", "<!-- z -->") for t in (None, "x", f"x\r\n{own}\r\ny".replace("this\n", "this\r\n"), own.replace("this", "that"), own * 2, "<!-- a --> x", "<!-- z --> <!-- a -->")]
    assert states == ["none", "none", "ok", "stale", "many", "broken", "broken"]
    assert block_state(own, None, "<!-- a -->", "<!-- z -->") == "no-template"
