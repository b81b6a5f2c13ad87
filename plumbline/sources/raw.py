"""The raw sources of materials, read where the files are: links, aliases and files that change under the reader prove nothing."""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

STATES = ("complete", "empty", "invalid", "unreadable", "unstable")
NAME = re.compile(r"source\..+", re.S)
ENTRY = pa.struct([("name", pa.string()), ("size", pa.int64()), ("digest", pa.string())])
REJECTED = pa.struct([("name", pa.string()), ("reason", pa.string())])
SCHEMA = "unit string, state string, code string, tree_digest string, entries array<struct<name:string,size:bigint,digest:string>>, rejected array<struct<name:string,reason:string>>"


def read_raw_sources(units: DataFrame, unit: str, materials: str, between: Callable[[str], None] | None = None) -> DataFrame:
    """unit, state, code, tree_digest, entries, rejected of each material's folder under ``materials``, a path that all executors see.

    Sources are the regular files named source.<extension>, case and all. A link,
    a second name of the same file or anything else under such a name makes the
    set invalid, as does a folder that is a link, lies elsewhere, or whose parent
    is a link. Every file is read twice; one that differs, in bytes or in what
    the file system says of it, makes the set unstable. A folder that can't be
    listed, or a file that can't be read, makes it unreadable, which is not empty.

    Only complete and empty sets have a tree_digest: SHA-256 over name NUL digest
    LF in the byte order of the names. rejected names what is refused and why.
    Files are hashed as they are read, so their size doesn't matter. ``between``
    is called with each path between its two readings.
    """

    def run(batches):
        for batch in batches:
            rows = [(u, *_folder(os.path.join(materials, u), materials, between)) for u in batch.column(0).to_pylist() if u is not None]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string()] * 4 + [pa.list_(ENTRY), pa.list_(REJECTED)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["unit", "state", "code", "tree_digest", "entries", "rejected"])

    return units.select(units[unit].cast("string").alias("unit")).mapInArrow(run, SCHEMA)


def _folder(place: str, trusted: str, between) -> tuple:
    """(state, code, tree digest, entries, rejected)"""
    fail = lambda state, code: (state, code, None, [], [])
    if os.path.islink(trusted.rstrip("/")):
        return fail("invalid", "RAW-SOURCE-TRUSTED-ROOT-ALIAS")
    base, real = os.path.realpath(trusted), os.path.realpath(place)
    if os.path.islink(place):
        return fail("invalid", "RAW-SOURCE-ROOT-ALIAS")
    if os.path.commonpath([base, real]) != base or base == real:
        return fail("invalid", "RAW-SOURCE-ROOT-ESCAPE")
    try:
        names = sorted((n for n in os.listdir(place) if NAME.fullmatch(n)), key=os.fsencode)
    except OSError:
        return fail("unreadable", "RAW-SOURCE-UNREADABLE")
    entries, rejected, troubles = [], [], set()
    for name in names:
        path = os.path.join(place, name)
        try:
            status = os.lstat(path)
            if reason := _refused(status):
                rejected.append((name, reason))
                continue
            first = _digest(path)
            if between:
                between(path)
            same = first == _digest(path) and _mark(status) == _mark(os.lstat(path))
        except OSError:
            troubles.add("unreadable")
            continue
        entries.append((name, status.st_size, first[1]))
        if not same:
            troubles.add("unstable")
    state = "invalid" if rejected else "unreadable" if "unreadable" in troubles else "unstable" if troubles else "complete" if entries else "empty"
    code = {"invalid": "RAW-SOURCE-IRREGULAR", "unreadable": "RAW-SOURCE-UNREADABLE", "unstable": "RAW-SOURCE-UNSTABLE"}.get(state)
    tree = hashlib.sha256(b"".join(os.fsencode(n) + b"\0" + d.encode() + b"\n" for n, _, d in entries)).hexdigest() if code is None else None
    shown = lambda n: os.fsencode(n).decode("utf-8", "replace")
    return state, code, tree, [{"name": shown(n), "size": s, "digest": d} for n, s, d in entries], [{"name": shown(n), "reason": r} for n, r in rejected]


def _refused(status: os.stat_result) -> str | None:
    if stat.S_ISLNK(status.st_mode):
        return "symlink"
    if not stat.S_ISREG(status.st_mode):
        return "irregular"
    return "hardlink" if status.st_nlink > 1 else None


def _mark(status: os.stat_result) -> tuple:
    return status.st_dev, status.st_ino, status.st_size, status.st_mtime_ns


def _digest(path: str) -> tuple:
    """(what the file system says of the open file, SHA-256 of its bytes); a link is not followed."""
    with open(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
        mark = _mark(os.fstat(f.fileno()))
        return mark, hashlib.file_digest(f, "sha256").hexdigest()
