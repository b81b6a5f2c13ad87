import os

import pytest

from plumbline.commit import Refusal
from plumbline.commit.upgrade import stripped, upgrade
from plumbline.core import state as S
from plumbline.plans import commands
from plumbline.sources.mine import open_mine

from .mines import edit, get, material, pristine, put, truth


@pytest.fixture
def root(tmp_path):
    """A mine of version 2: a winner, a loser, a pair in conflict, one that was taken back."""
    r = pristine(str(tmp_path / "old"))
    for name in ("project.md", "config.yaml"):
        edit(r, name, "version: 3", "version: 2")
    edit(r, "project.md", "required_tags: []", "required_tags: [rent]")
    for name in ("conflicts.json", "id-sequences.json", "materials/intake-ledger.tsv", "documents/d1/final.md", "documents/d1/review.md", "truths/tree.md"):
        os.unlink(os.path.join(r, name))
    body = "Rent is 900.\nRent is 950 from May.\nRent is 990 from June.\n"
    put(r, "materials/m001/converted.md", material(1, body))
    put(r, "truths/t001.md", truth(1, "Rent is 900.", status="ok", resolution="{type: pick, winner: t001, decided_by: machine}", superseded="[t002]"))
    put(r, "truths/t002.md", truth(2, "Rent is 900.", status="discarded"))
    put(r, "truths/t003.md", truth(3, "Rent is 950 from May.", status="conflict", conflict_with="[t4]"))
    put(r, "truths/t004.md", truth(4, "Rent is 990 from June.", status="conflict", conflict_with="[t003]"))
    put(r, "truths/t005.md", truth(5, "Nowhere.", status="retracted"))
    put(r, "truths/coverage.md", "## m001\n\n- rent: t001\n- old rent: t002\n- both: t001, t003\n")
    put(r, "truths/changelog.md", "- removed: t073\n")
    put(r, "truths/verify-ledger.tsv", "".join(f"t00{i}\t-\tverified\t1\ts\t2026-01-01\n" for i in (1, 5)))
    return r


def test_check_only_reads(spark, root):
    todo = upgrade(spark, root)
    assert (todo.keep, todo.delete, todo.move, todo.machine, todo.blocks) == (["t001"], ["t002", "t005"], ["t003", "t004"], ["t001"], [])
    assert todo.next == {"truth": 74, "material": 2, "conflict": 2}
    assert [(e["targets"], [c["claim"] for c in e["candidates"]]) for e in todo.entries] == [([], ["claim 3", "claim 4"])]
    assert not os.path.exists(os.path.join(root, "conflicts.json"))


def test_apply(spark, root):
    upgrade(spark, root, apply=True, day="2026-04-01", clean=lambda _: True)
    assert [d["code"] for d in commands.validate(open_mine(spark, root))["diagnostics"]] == ["CONFLICT-OPEN"]
    assert get(root, "truths/t001.md") == truth(1, "Rent is 900.") and not os.path.exists(os.path.join(root, "truths/t003.md"))
    assert get(root, "truths/verify-ledger.tsv").startswith("t001") and "t005" not in get(root, "truths/verify-ledger.tsv")
    assert "- old rent: skipped" in get(root, "truths/coverage.md") and "- both: t001\n" in get(root, "truths/coverage.md")
    assert S.read_conflicts(get(root, "conflicts.json"))[0]["candidates"][0]["quote"] == "Rent is 950 from May."
    assert "m001\t-\tlegacy-unbound" in get(root, "materials/intake-ledger.tsv")


def test_a_kept_partner_is_the_target(spark, root):
    edit(root, "truths/t003.md", "[t4]", "[t1, t4]")
    assert upgrade(spark, root).entries[0]["targets"] == ["t001"]


def test_blocks(spark, root):
    edit(root, "truths/t002.md", "discarded", "unsupported")
    edit(root, "truths/t001.md", "type: pick", "type: attribute")
    edit(root, "documents/d1/plan.md", "[t1]", "[t1, t5]")
    edit(root, "project.md", "[rent]", "[rent, gone]")
    edit(root, "truths/t005.md", "[rent]", "[gone]")
    assert len(upgrade(spark, root).blocks) == 4
    with pytest.raises(Refusal):
        upgrade(spark, root, apply=True, clean=lambda _: True)


def test_a_dirty_tree_and_a_misfit_change_nothing(spark, root):
    before = get(root, "truths/t003.md")
    with pytest.raises(Refusal, match="clean"):
        upgrade(spark, root, apply=True, clean=lambda _: False)
    edit(root, "truths/t001.md", "900", "901")
    with pytest.raises(Refusal, match="does not fit"):
        upgrade(spark, root, apply=True, clean=lambda _: True)
    assert get(root, "truths/t003.md") == before and "version: 2" in get(root, "project.md") and not os.path.exists(os.path.join(root, "conflicts.json"))


def test_only_its_lines_go():
    text = "---\r\nid: t001\r\nstatus : ok\r\nresolution: {a: b}\r\n---\r\nstatus: body\r\n"
    assert stripped(text) == "---\r\nid: t001\r\n---\r\nstatus: body\r\n"
