"""Ledgers in parts: whole appends or none, on a file system that is given as a URI."""

import os

import pytest

from plumbline.commit import Refusal, parts
from plumbline.sources import lines

ROW = "id string, digest string, word string, round string, standard string, day string"


def rows(spark, *ids, standard="std"):
    return spark.createDataFrame([(i, "-", "verified", "1", standard, "2026-02-01") for i in ids], ROW)


def taken(spark, folder):
    found, state = lines.read_ledger(spark, f"{folder}/{parts.PARTS}", lines.VERDICTS)
    return [r.id for r in found.orderBy("row_ord").collect()], state


def test_appends_follow_each_other(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    names = list(lines.VERDICTS.names)
    assert parts.append_rows(rows(spark, "t3", "t1", "t2"), folder, names, ["id"]) == 1
    assert parts.append_rows(rows(spark, "t1"), folder, names, ["id"], expected=1) == 2
    assert parts.append_rows(rows(spark).where("false"), folder, names, ["id"]) is None
    assert taken(spark, folder) == (["t001", "t002", "t003", "t001"], "ok")
    with pytest.raises(Refusal, match="has part 2, not 1"):
        parts.append_rows(rows(spark, "t9"), folder, names, ["id"], expected=1)


def test_a_writer_that_fails_leaves_the_ledger_whole(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ledger"
    names = list(lines.VERDICTS.names)
    parts.append_rows(rows(spark, "t1"), folder, names, ["id"])
    for odd in ("two\tfields", "two\nlines", "a\x7fb"):
        with pytest.raises(Refusal, match="control"):
            parts.append_rows(rows(spark, "t2", "t3").unionByName(rows(spark, "t4", standard=odd)), folder, names, ["id"])
    (tmp_path / "ledger" / ".staged-lost").mkdir()
    (tmp_path / "ledger" / ".staged-lost" / "part-00000.txt").write_text("t7\t-\tverified\n")
    assert taken(spark, folder) == (["t001"], "ok") and parts.part_numbers(spark, folder) == [1]
    monkeypatch.setattr(parts, "part_numbers", lambda *_: [])  # as a writer that looked before the other's part was there
    with pytest.raises(Refusal, match="already"):
        parts.append_rows(rows(spark, "t5"), folder, names, ["id"])
    assert taken(spark, folder) == (["t001"], "ok")
    assert sorted(n for n in os.listdir(tmp_path / "ledger") if not n.endswith(".crc")) == [".staged-lost", "part-000000001"]
