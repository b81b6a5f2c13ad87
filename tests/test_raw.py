"""Raw sources: which files count, and what proves nothing."""

import hashlib
import os

from plumbline.sources.raw import STATES, read_raw_sources


def put(root, path, data=b"x"):
    place = os.path.join(root, path)
    os.makedirs(os.path.dirname(place), exist_ok=True)
    with open(place, "wb") as f:
        f.write(data)
    return place


def read(spark, root, *units, **more):
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    return {r.unit: r for r in read_raw_sources(df, "unit", str(root), **more).collect()}


def tree(*files):
    return hashlib.sha256(b"".join(n.encode() + b"\0" + hashlib.sha256(d).hexdigest().encode() + b"\n" for n, d in sorted(files))).hexdigest()


def test_names_and_digests(spark, tmp_path):
    for name in ("source.md", "source.tar.gz", "source.a", "source.원본", "source", "source.", "sources.md", "SOURCE.md", ".source.md", "notsource.md", "converted.md"):
        put(tmp_path, f"m001/{name}", name.encode())
    os.makedirs(tmp_path / "m002")
    got = read(spark, tmp_path, "m001", "m002", "m003", None)
    names = ("source.md", "source.tar.gz", "source.a", "source.원본")
    assert [e.name for e in got["m001"].entries] == sorted(names, key=str.encode) and got["m001"].state == "complete"
    assert got["m001"].tree_digest == tree(*((n, n.encode()) for n in names))
    assert (got["m002"].state, got["m002"].tree_digest) == ("empty", hashlib.sha256(b"").hexdigest())
    assert (got["m003"].state, got["m003"].code, got["m003"].tree_digest) == ("unreadable", "RAW-SOURCE-UNREADABLE", None)
    assert len(got) == 3


def test_aliases_are_no_evidence(spark, tmp_path):
    root, out = tmp_path / "mine", tmp_path / "outside"
    put(out, "m/source.md")
    put(root, "m001/source.md")
    os.symlink(out / "m", root / "m001" / "source.link")
    os.symlink(out / "m", root / "m002")
    put(root, "m003/converted.md")
    os.link(root / "m003" / "converted.md", root / "m003" / "source.alias")
    put(root, "m004/source.md")
    os.makedirs(root / "m004" / "source.dir")
    os.makedirs(root / "m005")
    os.mkfifo(root / "m005" / "source.pipe")
    got = read(spark, root, "m001", "m002", "m003", "m004", "m005", "../outside/m", "")
    assert {u: (r.state, r.code, [tuple(x) for x in r.rejected]) for u, r in got.items()} == {
        "m001": ("invalid", "RAW-SOURCE-IRREGULAR", [("source.link", "symlink")]),
        "m002": ("invalid", "RAW-SOURCE-ROOT-ALIAS", []),
        "m003": ("invalid", "RAW-SOURCE-IRREGULAR", [("source.alias", "hardlink")]),
        "m004": ("invalid", "RAW-SOURCE-IRREGULAR", [("source.dir", "irregular")]),
        "m005": ("invalid", "RAW-SOURCE-IRREGULAR", [("source.pipe", "irregular")]),
        "../outside/m": ("invalid", "RAW-SOURCE-ROOT-ESCAPE", []),
        "": ("invalid", "RAW-SOURCE-ROOT-ESCAPE", []),
    }
    assert all(r.tree_digest is None for r in got.values()) and [e.name for e in got["m001"].entries] == ["source.md"]
    os.makedirs(tmp_path / "mine-more" / "m001")
    assert read(spark, root, "../mine-more/m001")["../mine-more/m001"].code == "RAW-SOURCE-ROOT-ESCAPE"
    os.symlink(out, tmp_path / "alias")
    assert read(spark, tmp_path / "alias", "m")["m"].code == "RAW-SOURCE-TRUSTED-ROOT-ALIAS"


def test_files_that_change_or_go_between_two_readings(spark, tmp_path):
    put(tmp_path, "m001/source.md")
    put(tmp_path, "m002/source.a")
    put(tmp_path, "m003/source.md")

    def between(path):
        if "m001" in path:
            with open(path, "ab") as f:
                f.write(b"more")
        elif "m002" in path:
            os.unlink(path)

    got = read(spark, tmp_path, "m001", "m002", "m003", between=between)
    assert {u: (r.state, r.code) for u, r in got.items()} == {"m001": ("unstable", "RAW-SOURCE-UNSTABLE"), "m002": ("unreadable", "RAW-SOURCE-UNREADABLE"), "m003": ("complete", None)}
    assert {r.state for r in got.values()} <= set(STATES)
