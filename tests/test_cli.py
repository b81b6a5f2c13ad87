import json

import pytest

from plumbline.__main__ import checked, run
from plumbline.commit import Refusal
from plumbline.plans.commands import config_findings

from .mines import edit, pristine


@pytest.mark.parametrize("argv", [[], ["validate"], ["unknown", "x"], ["validate", "x", "y"], ["validate", "x", "--fast"], ["retag", "x", "a"], ["attest", "x", "verified", "1", "s"], ["status", "x", "--opn"], ["upgrade", "x", "y"]])
def test_misuse_is_refused_before_reading(argv):
    with pytest.raises(Refusal):
        checked(argv)
    assert run(None, argv, lambda _: None) == 2


def test_commands(spark, tmp_path):
    root, said = pristine(str(tmp_path / "mine")), []

    def call(*argv):
        said.clear()
        return run(spark, [argv[0], root, *argv[1:]], said.append)

    assert call("validate") == 0 and said[-2:] == ["examined: materials 1 · truths 1 (1 sealed, 0 failed, 0 not checked) · documents 1 (1 consecrated, 1 gate-checked)", "ok"]
    assert call("validate", "--json") == 0 and json.loads(said[0])["output_schema_version"] == 1
    assert call("status", "--open") == 0 and said == ["nothing is waiting"]
    assert call("reindex", "--check") == 0 and call("reindex") == 0
    assert call("attest", "verified", "1", "by hand", "t001") == 0
    assert call("scope", "--json") == 0 and json.loads(said[0])["owed"] == ["m001"]
    assert call("pull", "claim") == 0 and said[0].startswith("t001: claim 1")
    assert call("alloc", "truth") == 0 and said == ['"t002"']
    assert call("conflict", "add", json.dumps({"targets": [], "candidates": [{"claim": "x", "source": "m001"}], "created": "2026-01-01"})) == 0
    assert call("conflict", "list") == 0 and said == ["c001 [] x"]
    assert call("validate") == 1 and call("conflict", "remove", "c1") == 0 and call("conflict", "remove", "c1") == 2
    assert call("attest", "verified", "1", "s", "t9") == 2 and call("gaps", "(") == 2
    assert call("version") == 0 and call("locale") == 0 and call("lang") == 0 and said == ['"en"']
    edit(root, "truths/coverage.md", "t001", "none, skipped")
    assert call("validate") == 1 and "[COVERAGE-UNLISTED] truths/coverage.md t001 m001" in said
    edit(root, "project.md", "version: 3", "version: 1")
    assert call("census") == 1


def test_config():
    assert config_findings({"version": "3", "verify": {"strength": "3", "scale": "small"}, "gaps": {"markers": "TBD"}}) == []
    found = config_findings({"verify": {"strength": "9", "scale": "huge", "sped": "x"}, "fidelity": {"completeness": "on"}, "colour": "red", "gaps": {"markers": "("}})
    assert [c for c, _, _ in found] == ["CFG-RANGE", "CFG-VALUE", "CFG-UNKNOWN-KEY", "CFG-VALUE", "CFG-UNKNOWN-KEY", "CFG-MARKERS"]
