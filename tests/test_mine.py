import os
import shutil

import pytest
from .mines import REVIEW, edit, get, index_line, material, pristine, put, scale, truth

from plumbline.commit import Refusal, append_lines, guarded, replace_all, single_writer, writers
from plumbline.core import state as S
from plumbline.plans import commands
from plumbline.sources.mine import MineError, open_mine


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    return pristine(str(tmp_path_factory.mktemp("mines") / "base"))


@pytest.fixture
def root(base, tmp_path):
    return shutil.copytree(base, tmp_path / "mine").__str__()


def verdict(spark, root):
    return commands.validate(open_mine(spark, root))


def codes(spark, root):
    return [d["code"] for d in verdict(spark, root)["diagnostics"]]


def test_pristine(spark, root):
    got = verdict(spark, root)
    assert (got["result"], got["diagnostics"], got["warnings"]) == ("ok", [], [])
    assert got["examined"] == {"materials": 1, "truths": 1, "sealed": 1, "not_checked": 0, "failed": 0, "documents": 1, "consecrated": 1, "gate_checked": 1, "digest_bound": 0, "legacy_unbound": 1}
    mine = open_mine(spark, root)
    census = commands.census(mine)
    assert (census["truths"], census["index"], census["covered"], census["of"], census["intake_declared"]) == (1, 1, 1, 1, 1)
    assert commands.scope_counts(mine) == {("truth", "unverified"): 1, ("material", "unverified"): 1}
    assert commands.status_open(mine) == []
    assert commands.reindex_check(mine) == {"index.md": 0, "tree.md": 0}
    assert commands.gaps(mine) == {"markers": 0, "unchecked": 0, "accepted": 0, "malformed": 0, "open": 0}
    assert commands.impact(mine, "m1") == {"truths": ["t001"], "by_id": [], "by_title": [], "by_truths": ["d1"]}
    assert [r.id for r in commands.pull(mine, "claim").collect()] == ["t001"] == [r.id for r in commands.pull(mine, "naïve").collect()]
    assert not commands.intake_staleness(mine).where("source_stale OR copy_stale").count()


def test_scale(spark, tmp_path):
    got = verdict(spark, scale(str(tmp_path / "scale")))
    assert got["examined"]["materials"] == 8 and got["examined"]["truths"] == got["examined"]["sealed"] == 60
    assert got["result"] == "ok" and len(got["warnings"]) == 7


BREAKS = {
    "TRUTH-SOURCE-DANGLING": lambda r: edit(r, "truths/t001.md", "source: m001", "source: m009"),
    "SEAL-QUOTE-MISSING": lambda r: edit(r, "truths/t001.md", "900", "901"),
    "SEAL-SPLIT-BLOCK": lambda r: edit(r, "truths/t001.md", "It falls due on the third.", "Notice is three months."),
    "TRUTH-BODY-FRAGMENT": lambda r: put(r, "truths/t001.md", truth(1, "rent")),
    "RAW-SOURCE-IRREGULAR": lambda r: os.symlink("/etc/hostname", os.path.join(r, "materials/m001/source.link")),
    "TRUTH-BODY-EMPTY": lambda r: put(r, "truths/t001.md", truth(1, "")),
    "FM-UNCLOSED": lambda r: edit(r, "truths/t001.md", "---\nThe rent", "The rent"),
    "FM-MISSING": lambda r: put(r, "truths/t001.md", "no frontmatter"),
    "FM-DUPLICATE-KEY": lambda r: edit(r, "truths/t001.md", "provenance:", "source: again\nprovenance:"),
    "FM-LIST-UNCLOSED": lambda r: edit(r, "truths/t001.md", "tags: [rent]", "tags: [rent"),
    "FIELD-REQUIRED": lambda r: edit(r, "truths/t001.md", "claim: claim 1", "claim: {claim}"),
    "ENUM-UNKNOWN": lambda r: edit(r, "truths/t001.md", "stated", "guessed"),
    "DATE-INVALID": lambda r: edit(r, "materials/m001/converted.md", "2026-02-01", "2026-02-30"),
    "ID-MISMATCH": lambda r: edit(r, "truths/t001.md", "id: t001", "id: t1"),
    "ID-SPELLING": lambda r: os.rename(os.path.join(r, "truths/t001.md"), os.path.join(r, "truths/t1.md")),
    "TRUTH-V2-FIELD": lambda r: edit(r, "truths/t001.md", "location:", "resolution: kept\nlocation:"),
    "TRUTH-DERIVED-FROM": lambda r: edit(r, "truths/t001.md", "stated", "derived"),
    "PLAN-LABELS": lambda r: edit(r, "documents/d1/plan.md", "tone:", "audience: external\ntone:"),
    "MAT-RESEARCH": lambda r: edit(r, "materials/m001/converted.md", "origin: file", "origin: research"),
    "MAT-ROLE": lambda r: edit(r, "materials/m001/converted.md", "role: contract", "role: diary"),
    "PLAN-CITED-DANGLING": lambda r: edit(r, "documents/d1/plan.md", "[t1]", "[t1, t044]"),
    "MAT-NO-CONVERTED": lambda r: put(r, "materials/m002/source.md", "x"),
    "REQTAG-EMPTY": lambda r: edit(r, "project.md", "required_tags: []", "required_tags: [deposit]"),
    "CAT-MISSING": lambda r: os.unlink(os.path.join(r, "catalog.md")),
    "CAT-ORPHAN": lambda r: edit(r, "catalog.md", "m001", "m002"),
    "INDEX-DUPLICATE": lambda r: put(r, "truths/index.md", index_line(1) * 2),
    "INDEX-OUT-OF-SYNC": lambda r: put(r, "truths/index.md", index_line(2)),
    "COVERAGE-DANGLING": lambda r: edit(r, "truths/coverage.md", "t001", "t002"),
    "COVERAGE-MALFORMED": lambda r: edit(r, "truths/coverage.md", "- rent: t001", "- rent"),
    "VERIFY-SECTION": lambda r: edit(r, "truths/verify.md", "## Adjudications\n", ""),
    "HQ-UNTAGGED": lambda r: edit(r, "truths/verify.md", "## Human queue\n", "## Human queue\n\n- [open] what now\n"),
    "STATE-MISSING": lambda r: os.unlink(os.path.join(r, "conflicts.json")),
    "STATE-MALFORMED": lambda r: put(r, "id-sequences.json", "{}"),
    "IDSEQ-BEHIND": lambda r: put(r, "id-sequences.json", S.write_sequences({"conflict": 1, "material": 1, "truth": 2})),
    "LEDGER-MALFORMED": lambda r: put(r, "truths/verify-ledger.tsv", "t001\tx\tverified\t1\ts\t2026-01-01\n"),
    "LEDGER-VERDICT": lambda r: put(r, "truths/verify-ledger.tsv", "t001\t-\tmaybe\t1\ts\t2026-01-01\n"),
    "MAT-INTAKE-LEDGER": lambda r: edit(r, "materials/intake-ledger.tsv", "\t1\t", "\t0\t"),
    "GATE-OPEN": lambda r: edit(r, "documents/d1/review.md", "- [{kind}] {what}", "1. [unsupported] line 3"),
    "GATE-ZONE": lambda r: edit(r, "documents/d1/review.md", "Reads well.", "A [Missing Required] one."),
    "GATE-MISSING": lambda r: edit(r, "documents/d1/review.md", "## Fidelity violations", "## Fidelity violations so far"),
    "GATE-DUPLICATE": lambda r: edit(r, "documents/d1/review.md", "## Findings", "## Fidelity violations\n\n## Findings"),
    "GATE-NO-REVIEW": lambda r: os.unlink(os.path.join(r, "documents/d1/review.md")),
    "GATE-UNSEALED": lambda r: edit(r, "documents/d1/review.md", "review_legacy: 2026-01-05\n", ""),
    "GATE-SEAL-MARKER": lambda r: edit(r, "documents/d1/review.md", "---\n#", "reviewed_kind: draft\n---\n#"),
    "GATE-DUAL-FINAL": lambda r: put(r, "documents/d1/final/one.md", "x"),
    "REVIEW-UNTERMINATED-FENCE": lambda r: edit(r, "documents/d1/review.md", "Reads well.", "```\nReads well."),
    "REVIEW-UNTERMINATED-COMMENT": lambda r: edit(r, "documents/d1/review.md", "Reads well.", "<!-- Reads well."),
    "REVIEW-KIND-UNKNOWN": lambda r: edit(r, "documents/d1/review.md", "- [{kind}] {what}", "- [{kind}] {what}\n### [typo] still open"),
    "REVIEW-UNREADABLE": lambda r: (os.unlink(os.path.join(r, "documents/d1/review.md")), os.makedirs(os.path.join(r, "documents/d1/review.md"))),
    "SEAL-RETRACTED": lambda r: edit(r, "materials/m001/converted.md", "status: used", "status: retracted"),
    "TRUTH-DIR": lambda r: os.makedirs(os.path.join(r, "truths/t009.md")),
    "SCHEMA-UNREADABLE": lambda r: put(r, "schema", "verify.sections: Verified units|Adjudications|Human queue\ngaps.sections: Open|Open\ngaps.enum.kind: declared|reference\n"),
    "SCHEMA-VERIFY-SECTIONS": lambda r: put(r, "schema", "verify.sections: |Human queue|Adjudications\ngaps.sections: Open|Accepted\ngaps.enum.kind: declared\n"),
    "CONSEC-INTERRUPTED": lambda r: put(r, "documents/d1/.consecrate-in-flight", "d1"),
    "COMP-NO-REGISTER": lambda r: edit(r, "config.yaml", "completeness: off", "completeness: required"),
    "COMP-OPEN-GAPS": lambda r: (edit(r, "config.yaml", "completeness: off", "completeness: required"), put(r, "gaps.md", "## Open\n\n- [declared] no deposit\n\n## Accepted\n")),
    "COMP-MALFORMED": lambda r: (edit(r, "config.yaml", "completeness: off", "completeness: required"), put(r, "gaps.md", "## Open\n\n- no kind\n\n## Accepted\n")),
}


#: Breaks that don't touch one another share a mine.
ROUNDS = [
    "TRUTH-SOURCE-DANGLING DATE-INVALID PLAN-LABELS MAT-NO-CONVERTED CAT-MISSING INDEX-DUPLICATE COVERAGE-DANGLING VERIFY-SECTION STATE-MISSING GATE-OPEN LEDGER-MALFORMED REQTAG-EMPTY COMP-NO-REGISTER CONSEC-INTERRUPTED",
    "SEAL-QUOTE-MISSING MAT-RESEARCH PLAN-CITED-DANGLING CAT-ORPHAN INDEX-OUT-OF-SYNC COVERAGE-MALFORMED HQ-UNTAGGED STATE-MALFORMED GATE-ZONE LEDGER-VERDICT COMP-OPEN-GAPS",
    "SEAL-SPLIT-BLOCK MAT-ROLE IDSEQ-BEHIND GATE-MISSING MAT-INTAKE-LEDGER COMP-MALFORMED",
    "TRUTH-BODY-FRAGMENT GATE-DUPLICATE GATE-DUAL-FINAL SEAL-RETRACTED",
    "TRUTH-BODY-EMPTY GATE-NO-REVIEW TRUTH-DIR SCHEMA-UNREADABLE",
    "FM-UNCLOSED GATE-UNSEALED REVIEW-KIND-UNKNOWN SCHEMA-VERIFY-SECTIONS",
    "REVIEW-UNREADABLE RAW-SOURCE-IRREGULAR",
    "FM-MISSING GATE-SEAL-MARKER",
    "FM-DUPLICATE-KEY FIELD-REQUIRED ENUM-UNKNOWN ID-MISMATCH TRUTH-V2-FIELD REVIEW-UNTERMINATED-FENCE",
    "FM-LIST-UNCLOSED TRUTH-DERIVED-FROM REVIEW-UNTERMINATED-COMMENT",
    "ID-SPELLING",
]


def test_every_break_is_in_a_round():
    assert sorted(" ".join(ROUNDS).split()) == sorted(BREAKS)


@pytest.mark.parametrize("names", ROUNDS)
def test_each_break_is_named(spark, root, names):
    for name in names.split():
        BREAKS[name](root)
    assert set(names.split()) <= set(codes(spark, root))


def test_forms_that_pass(spark, root):
    edit(root, "truths/t001.md", "source: m001", "source : 'm1'  # lenient")
    edit(root, "truths/t001.md", "---\nThe", "---  \nThe")
    put(root, "truths/t001.md", get(root, "truths/t001.md").replace("\n", "\r\n"))
    edit(root, "documents/d1/review.md", "Reads well.", "Reads well. A contradiction in prose, a [note], <!-- - [unsupported] archived -->")
    put(root, "gaps.md", "## Open\n\n- [declared] a gap\n\n## Accepted\n")
    assert codes(spark, root) == []


def test_other_versions_get_one_answer(spark, root):
    for name in ("project.md", "config.yaml"):
        edit(root, name, "version: 3", "version: 2")
    with pytest.raises(MineError, match="VER-V2-UPGRADE"):
        open_mine(spark, root)
    for name in ("project.md", "config.yaml"):
        edit(root, name, "version: 2", "version: 1")
    with pytest.raises(MineError, match="VER-V1-BRIDGE"):
        open_mine(spark, root)
    for name in ("project.md", "config.yaml"):
        edit(root, name, "version: 1", "version: 9")
    with pytest.raises(MineError, match="VERSION-MISMATCH.*future"):
        open_mine(spark, root)
    for name in ("project.md", "config.yaml"):
        edit(root, name, "version: 9", "version: 2")
    edit(root, "config.yaml", "version: 2", "version: 3")
    with pytest.raises(MineError, match="VERSION-MISMATCH"):
        open_mine(spark, root)
    edit(root, "project.md", "version: 2", "version: 3")
    shutil.rmtree(os.path.join(root, "inbox"))
    with pytest.raises(MineError, match="CFG-PATH-MISSING"):
        open_mine(spark, root)


def test_undeclared_is_a_warning(spark, root):
    os.unlink(os.path.join(root, "materials/intake-ledger.tsv"))
    got = verdict(spark, root)
    assert got["result"] == "ok" and [w["code"] for w in got["warnings"]] == ["MAT-UNDECLARED"]


def test_attest_and_scope(spark, root):
    mine = open_mine(spark, root)
    writers.attest(mine, "verified", "1", "by hand", ["t1", "m001"], "2026-03-01")
    assert commands.scope_counts(open_mine(spark, root)) == {("truth", "verified"): 1, ("material", "verified"): 1}
    edit(root, "materials/m001/converted.md", "status: used", "status: verified")
    edit(root, "truths/t001.md", "claim 1", "claim one")
    assert commands.scope_counts(open_mine(spark, root)) == {("truth", "stale"): 1, ("material", "verified"): 1}
    put(root, "truths/verify-ledger.tsv", get(root, "truths/verify-ledger.tsv") + "m1\t-\tperhaps\t1\ts\t2026-01-01\n")
    assert commands.scope_counts(open_mine(spark, root))[("material", "unverified")] == 1
    put(root, "truths/verify-ledger.tsv", get(root, "truths/verify-ledger.tsv") + "t044\t-\tfailed\t1\ts\t2026-01-01\n")
    assert commands.ghosts(open_mine(spark, root)) == ["t044"]
    put(root, "truths/verify-ledger.tsv", get(root, "truths/verify-ledger.tsv") + "\t-\tfailed\t1\ts\t2026-01-01\n")
    assert commands.scope_counts(open_mine(spark, root)) == {("truth", "unverified"): 1, ("material", "unverified"): 1}
    for bad in (["t9"], ["x1"], []):
        with pytest.raises(Refusal):
            writers.attest(mine, "verified", "1", "s", bad)
    with pytest.raises(Refusal):
        writers.attest(mine, "verified", "1", "two\tfields", ["t1"])


def test_legacy_evidence(spark, root):
    edit(root, "truths/verify.md", "## Verified units\n", "## Verified units\n\n- t001-t003 verified\n- m001 verified\n")
    assert commands.scope_counts(open_mine(spark, root)) == {("truth", "legacy-unbound"): 1, ("material", "unverified"): 1}
    put(root, "truths/verify-ledger.tsv", "t1\t-\tperhaps\t1\ts\t2026-01-01\n")
    assert commands.scope_counts(open_mine(spark, root))[("truth", "unverified")] == 1


def test_intake(spark, root):
    os.unlink(os.path.join(root, "materials/intake-ledger.tsv"))
    put(root, "materials/m002/converted.md", material(2, "x y\n"))
    mine = open_mine(spark, root)
    with pytest.raises(Refusal, match="no source"):
        writers.intake(mine, "m2")
    writers.intake(mine, "m2", no_source=True, note="spoken", day="2026-03-01")
    assert [x.split("\t")[:3:2] for x in writers.intake(mine, anchor_existing=True)] == [["m001", "anchored"]]
    assert writers.intake(mine, anchor_existing=True) == [] and writers.backfill(mine) == []
    split = {r.bucket: r.n for r in commands.intake_split(open_mine(spark, root)).collect()}
    assert split == {"declared": 0, "anchored": 1, "no-source": 1, "legacy-unbound": 0, "undeclared": 0}
    put(root, "materials/m001/source.md", "changed")
    edit(root, "materials/m002/converted.md", "x y", "x z")
    stale = {r.id: (r.source_stale, r.copy_stale) for r in commands.intake_staleness(open_mine(spark, root)).collect()}
    assert stale == {"m001": (True, False), "m002": (False, True)}


def test_ids_and_conflicts(spark, root):
    mine = open_mine(spark, root)
    assert [writers.alloc(mine, "truth"), writers.alloc(mine, "truth"), writers.alloc(mine, "material")] == ["t002", "t003", "m002"]
    entry = {"targets": ["t001"], "candidates": [{"claim": "another rent", "source": "m001"}], "created": "2026-03-01"}
    assert writers.conflict_add(mine, entry) == "c001"
    assert codes(spark, root) == ["CONFLICT-OPEN"]
    assert commands.status_open(open_mine(spark, root)) == [("conflict", "c001: another rent")]
    with pytest.raises(Refusal):
        writers.conflict_add(mine, entry | {"id": "c007"})
    with pytest.raises(S.Refused, match="CONF-CANDIDATE"):
        writers.conflict_add(mine, entry | {"candidates": []})
    writers.conflict_remove(mine, "c1")
    assert codes(spark, root) == [] and writers.conflict_add(mine, entry) == "c002"
    with pytest.raises(Refusal):
        writers.conflict_remove(mine, "c1")


def test_retag_and_reindex(spark, root):
    put(root, "truths/t001.md", get(root, "truths/t001.md").replace("tags: [rent]", "tags: [rent, é]  # kept").replace("\n", "\r\n"))
    mine = open_mine(spark, root)
    assert writers.retag(mine, "rent", "lease", dry=True) == ["documents/d1/plan.md", "truths/t001.md"]
    writers.retag(mine, "rent", "lease")
    assert "tags: [lease, é]  # kept\r\n" in get(root, "truths/t001.md") and "scope_tags: [lease]" in get(root, "documents/d1/plan.md")
    edit(root, "project.md", "required_tags: []", "required_tags: [lease]")
    writers.retag(open_mine(spark, root), "lease", "é")
    assert "tags: [é]  # kept\r\n" in get(root, "truths/t001.md")
    assert commands.reindex_check(open_mine(spark, root))["index.md"] > 0
    moves = []

    def failing(a, b):
        if moves:
            raise OSError("full")
        moves.append(b)
        os.replace(a, b)

    before = get(root, "truths/index.md")
    with pytest.raises(OSError, match="full"):
        writers.reindex(mine, failing)
    assert get(root, "truths/index.md") == before
    writers.reindex(mine)
    assert commands.reindex_check(open_mine(spark, root)) == {"index.md": 0, "tree.md": 0}


def test_seal_and_consecrate(spark, root):
    edit(root, "documents/d1/draft.md", "900.", "900 a month.")
    mine = open_mine(spark, root)
    with pytest.raises(Refusal):
        writers.consecrate(mine, "d1")
    writers.seal_review(mine, "d1")
    assert "review_legacy" not in get(root, "documents/d1/review.md")
    writers.consecrate(mine, "d1")
    assert get(root, "documents/d1/final.md") == get(root, "documents/d1/draft.md") and codes(spark, root) == []
    assert verdict(spark, root)["examined"]["digest_bound"] == 1
    edit(root, "truths/t001.md", "claim 1", "claim one")
    assert "GATE-CONTEXT-DIGEST" in codes(spark, root)
    edit(root, "truths/t001.md", "claim one", "claim 1")
    edit(root, "documents/d1/final.md", "900", "901")
    assert "GATE-FINAL-DIGEST" in codes(spark, root)
    before = get(root, "documents/d1/final.md")

    def boom(_):
        raise RuntimeError("check failed")

    with pytest.raises(RuntimeError):
        writers.consecrate(open_mine(spark, root), "d1", boom)
    assert get(root, "documents/d1/final.md") == before and not [x for x in os.listdir(os.path.join(root, "documents/d1")) if x.startswith(".")]
    edit(root, "documents/d1/review.md", "- [{kind}] {what}", "- [unsupported] x")
    with pytest.raises(Refusal, match="gate"):
        writers.consecrate(open_mine(spark, root), "d1")


def test_lock_guard_and_append(tmp_path):
    root = str(tmp_path)
    with single_writer(root), pytest.raises(Refusal), single_writer(root):
        pass
    with single_writer(root):
        pass
    with pytest.raises(Refusal):
        guarded(root, "..", "x")
    os.symlink("/tmp", os.path.join(root, "link"))
    with pytest.raises(Refusal):
        guarded(root, "link", "x")
    place = os.path.join(root, "l.tsv")
    append_lines(place, ["a\tb"], "# head\n")
    append_lines(place, ["c"])
    assert open(place).read() == "# head\na\tb\nc\n"
    with open(place, "a") as f:
        f.write("torn")
    with pytest.raises(Refusal):
        append_lines(place, ["d"])
    place = os.path.join(root, "n.tsv")
    append_lines(place, ["a"])
    for fault in (lambda f, data: f.write(data[:3]), lambda f, data: f.write(data[:3]) and f.fail()):
        with pytest.raises(Refusal, match="rolled back"):
            append_lines(place, ["bb", "cc"], write=fault)
        assert open(place).read() == "a\n"
    with pytest.raises(IsADirectoryError):
        replace_all({os.path.join(root, "a"): b"1", root: b"2"})
    assert not os.path.exists(os.path.join(root, "a"))


def test_review_template_is_clean():
    from plumbline.core.registers import gate_findings

    assert gate_findings(REVIEW.format("")) == []


def test_a_folder_as_review_is_unknown_not_absent(spark, root):
    BREAKS["REVIEW-UNREADABLE"](root)
    found = codes(spark, root)
    assert "GATE-NO-REVIEW" not in found and "REVIEW-UNREADABLE" in found
    assert ("violation", "d1: unknown (the review is a folder)") in commands.status_open(open_mine(spark, root))


def test_roles_of_sections_never_shift(spark, root):
    edit(root, "truths/verify.md", "## Human queue\n", "## Human queue\n\n- [open] [user-only] is t001 verified\n")
    BREAKS["SCHEMA-VERIFY-SECTIONS"](root)
    assert commands.scope_counts(open_mine(spark, root))["truth", "unverified"] == 1
    put(root, "schema", "verify.sections: Verified units|Adjudications|Human queue\ngaps.sections: |Accepted\ngaps.enum.kind: declared\n")
    put(root, "gaps.md", "## Accepted\n\n- [declared] must not become open\n")
    mine = open_mine(spark, root)
    assert commands.gaps(mine)["accepted"] is None and ("gap", "unknown (the schema's sections don't hold)") in commands.status_open(mine)
    put(root, "schema", "verify.sections: Verified units|Adjudications|Human queue\ngaps.sections: Pending|Waived\ngaps.enum.kind: own\n")
    put(root, "gaps.md", "## Pending\n\n- [own] a gap\n\n## Waived\n\n- [own] another\n")
    got = commands.gaps(open_mine(spark, root))
    assert (got["open"], got["accepted"], got["malformed"]) == (1, 1, 0) and "SCHEMA-UNREADABLE" not in codes(spark, root)


def test_pointer_block_warns_and_never_blocks(spark, root):
    block = "<!-- mine:begin -->\nread this first\n<!-- mine:end -->\n"
    put(root, "templates/claude-block.md", block)
    warned = lambda: [w["code"] for w in verdict(spark, root)["warnings"]]
    for text, codes_ in ((block.replace("\n", "\r\n") + "\r\nour own words\r\n", []), (block.replace("first", "last"), ["CLAUDE-BLOCK-STALE"]), (block + block, ["CLAUDE-BLOCK-STALE"]), ("<!-- mine:begin -->\n", ["CLAUDE-BLOCK-STALE"]), ("no block", [])):
        put(root, "CLAUDE.md", text)
        assert warned() == codes_ and codes(spark, root) == []
    put(root, "CLAUDE.md", block)
    os.unlink(os.path.join(root, "templates/claude-block.md"))
    assert warned() == ["CLAUDE-BLOCK-NOTEMPLATE"]


def test_a_mine_by_its_uri(spark, root):
    BREAKS["REVIEW-UNREADABLE"](root)
    BREAKS["CONSEC-INTERRUPTED"](root)
    here, there = verdict(spark, root), verdict(spark, "file://" + root)
    assert here == there and here["result"] == "fail"
    with pytest.raises(Refusal, match="on this machine"):
        writers.alloc(open_mine(spark, "file://" + root), "truth")
