"""A mine as tables: materials, truths, documents and their ledgers, read from a folder or a URI.

Executors read and parse the files; each file is read once, into one table of
cards. The driver reads the few files that there is one of. Absent, unreadable
and empty are told apart: every table of one file has a state beside it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import cards as C
from ..core import registers, state
from ..core.markdown import scan
from . import lines
from .files import Local, Remote, folder

SCHEMA_VERSION = 3
PATHS = {"inbox": "inbox", "materials": "materials", "truths": "truths", "documents": "documents"}
CARD_SCHEMA = "path string, family string, unit string, state string, fields map<string,string>, lists map<string,array<string>>, duplicates array<string>, open_lists array<string>, body string, digest string, copy_digest string"
DIAGNOSTIC = "code string, path string, subject string, detail string, severity string"


class MineError(Exception):
    """A mine that can't be judged at all; code says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def copy_text(text: str) -> str:
    """A converted copy without the status line of its frontmatter, with LF ends; what its digest is taken of."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and C.FENCE.match(lines[0]):
        end = next((i for i in range(1, len(lines)) if C.FENCE.match(lines[i])), 0)
        lines = [x for i, x in enumerate(lines) if not (0 < i < end and re.match(r"^status[ \t]*:", x))]
    return "\n".join(lines)


def parse_config(text: str) -> dict[str, dict[str, str] | str]:
    """Two levels of ``key: value``; indentation opens a level."""
    out: dict = {}
    group = None
    for line in C.lines_of(text):
        line = C.without_comment(line)
        m = re.match(r"^([ \t]*)([A-Za-z_]+)[ \t]*:[ \t]*(.*)$", line)
        if not m:
            continue
        if m[1] and isinstance(group, dict):
            group[m[2]] = C.unquoted(m[3])
        elif m[3]:
            out[m[2]] = C.unquoted(m[3])
        else:
            group = out.setdefault(m[2], {})
    return out


@dataclass
class Mine:
    spark: SparkSession
    root: str
    home: Local | Remote
    config: dict = field(default_factory=dict)
    project: C.Card = field(default_factory=C.Card)
    paths: dict[str, str] = field(default_factory=dict)
    files: DataFrame | None = None
    cards: DataFrame | None = None
    ledgers: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)

    def place(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def text(self, *parts: str) -> tuple[str | None, str]:
        """(text, state) of a file of which there is one: ok, absent, or unreadable."""
        content, read = self.home.read(*parts)
        return (content.decode("utf-8", "surrogateescape") if content is not None else None), read

    @functools.cached_property
    def contract(self) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
        """The lists of the mine's schema file, and what is wrong with it."""
        return state.read_contract(*self.text("schema"))

    def roster(self, key: str) -> list[str]:
        return self.contract[0][key]

    def family(self, name: str) -> DataFrame:
        return self.cards.where(F.col("family") == name)

    @property
    def truths(self) -> DataFrame:
        f = F.col("fields")
        return self.family("truth").select("path", F.col("unit").alias("id"), "state", "fields", "lists", f["claim"].alias("claim"), f["source"].alias("raw_source"), F.coalesce(_canon(f["source"]), f["source"]).alias("source"), f["provenance"].alias("provenance"), F.coalesce(F.col("lists")["tags"], F.array()).alias("tags"), "body", "digest")

    @property
    def materials(self) -> DataFrame:
        f = F.col("fields")
        return self.family("material").select("path", F.col("unit").alias("id"), "state", "fields", "lists", f["title"].alias("title"), f["role"].alias("role"), f["origin"].alias("origin"), f["status"].alias("status"), f["stage"].alias("stage"), "body", "digest", "copy_digest")

    @property
    def plans(self) -> DataFrame:
        return self.family("plan").select("path", F.col("unit").alias("doc"), "state", "fields", "lists", F.coalesce(F.col("lists")["cited_truths"], F.array()).alias("cited"))

    def verify_rows(self) -> tuple[DataFrame, str]:
        return self._ledger("truths", "verify-ledger.tsv", lines.VERDICTS)

    def intake_rows(self) -> tuple[DataFrame, str]:
        return self._ledger("materials", "intake-ledger.tsv", lines.DECLARATIONS)

    def _ledger(self, family: str, name: str, grammar: lines.Grammar) -> tuple[DataFrame, str]:
        """Rows in append order; word is null where the row is no evidence. A ledger that is voided, absent or unreadable has no rows."""
        if name not in self.ledgers:
            read = self.home.state(self.paths[family], name)
            if read == "ok":
                self.ledgers[name] = lines.read_ledger(self.spark, self.home.uri(self.paths[family], name), grammar)
            else:
                schema = ", ".join(["row_ord long", *(f"{n} string" for n in grammar.names), "fit boolean, known boolean"])
                self.ledgers[name] = self.spark.createDataFrame([], schema), read
        return self.ledgers[name]

    def lines_table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


#: The cards of each mine that is kept in memory; reading it again lets the earlier ones go.
_OPEN: dict[str, DataFrame] = {}


def _canon(col):
    from .. import functions

    return functions.canon_id(col)


def _classify(path: str, paths: dict[str, str]) -> tuple[str, str]:
    for family, pattern in (
        ("material", rf"{re.escape(paths['materials'])}/(m\d+)/converted\.md"),
        ("raw", rf"{re.escape(paths['materials'])}/(m\d+)/(source\..+)"),
        ("truth", rf"{re.escape(paths['truths'])}/(t\d+)\.md"),
        ("plan", rf"{re.escape(paths['documents'])}/([^/]+)/plan\.md"),
        ("review", rf"{re.escape(paths['documents'])}/([^/]+)/review\.md"),
        ("draft", rf"{re.escape(paths['documents'])}/([^/]+)/draft(?:\.md|/.+)"),
        ("final", rf"{re.escape(paths['documents'])}/([^/]+)/final(?:\.md|/.+)"),
    ):
        if m := re.fullmatch(pattern, path, re.S):
            return family, m[1]
    return "other", ""


def open_mine(spark: SparkSession, root: str, version: int = SCHEMA_VERSION) -> Mine:
    """Reads a mine. Refuses one of another version, and one whose configured folders are not there."""
    home = folder(spark, root)
    mine = Mine(spark, home.root, home)
    text, read = mine.text("config.yaml")
    if text is None:
        raise MineError("CONFIG-" + read.upper(), "config.yaml")
    mine.config = parse_config(text)
    project, read = mine.text("project.md")
    if project is None:
        raise MineError("PROJ-" + read.upper(), "project.md")
    mine.project = C.read_card(project)
    says, configured = mine.project.fields.get("version", ""), str(mine.config.get("version", ""))
    if {says, configured} != {str(version)}:  # an upgrade opens an earlier version
        _, code, reason = state.negotiate(says, configured)
        if code == "VERSION-BELOW-FLOOR":
            raise MineError(*(("VER-V2-UPGRADE", f"version {says}: upgrade it; only {version} is judged") if reason == "upgrade" else ("VER-V1-BRIDGE", f"version {says}: an earlier release must bring it to version 2 before it can be upgraded")))
        raise MineError(code or "VERSION-MISMATCH", f"{reason or 'other'}: project {says or 'none'}, configuration {configured or 'none'}")
    own = mine.config.get("paths", {})
    mine.paths = {k: os.path.normpath(own.get(k, v)) for k, v in PATHS.items()} if isinstance(own, dict) else dict(PATHS)
    for name, own in mine.paths.items():
        if not home.is_dir(own):
            raise MineError("CFG-PATH-MISSING", f"{name}: {own}")
    prefix = home.prefix
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(mine.root)
    mine.files = found.select(F.substring(F.col("path"), len(prefix) + 1, 1_000_000).alias("path"), "content", "length")
    paths, opened = mine.paths, uuid.uuid4().hex

    def parse(batches, opened=opened):  # a name of its own: Spark must not take an earlier reading of these files for this one
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                family, unit = _classify(path, paths)
                if family == "other":
                    continue
                text = content.decode("utf-8", "replace")
                card = C.read_card(text) if family in ("material", "truth", "plan", "review") else C.Card("raw", body="" if family == "raw" else text)
                rows.append((path, family, unit, card.state, list(card.fields.items()), list(card.lists.items()), card.duplicates, card.unclosed_lists, text if family == "review" else card.body, hashlib.sha256(content).hexdigest(), hashlib.sha256(copy_text(text).encode("utf-8", "replace")).hexdigest() if family == "material" else None))
            kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string())), pa.list_(pa.string()), pa.list_(pa.string())] + [pa.string()] * 3
            names = "path family unit state fields lists duplicates open_lists body digest copy_digest".split()
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    if earlier := _OPEN.pop(mine.root, None):
        earlier.unpersist()
    mine.cards = _OPEN[mine.root] = mine.files.select("path", "content").mapInArrow(parse, CARD_SCHEMA).cache()
    return mine


def register(mine: Mine, *parts: str):
    """(scanned file or None, state)."""
    text, read = mine.text(*parts)
    return (scan(text) if text is not None else None), read


__all__ = ["Mine", "MineError", "open_mine", "register", "registers"]
