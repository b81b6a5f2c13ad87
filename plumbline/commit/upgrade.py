"""From schema 2 to 3: every card is kept, deleted or moved to an open conflict, exactly once.

Dispositions, groups of conflicting cards and the conservation of their number
are DataFrames; the driver writes all files or puts all of them back.
"""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..core import state as S
from ..core.cards import FENCE, KEY
from ..operators import counts, ids
from ..plans import commands
from ..sources import shared_dir
from ..sources.mine import Mine, open_mine
from . import Refusal, guarded, single_writer, writers

#: Lines of a kept card that go; every other byte stays.
V2_LINES = ("status", "conflict_with", "resolution", "superseded")


@dataclass
class Plan:
    keep: list[str] = field(default_factory=list)
    delete: list[str] = field(default_factory=list)
    move: list[str] = field(default_factory=list)
    entries: list[dict] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    machine: list[str] = field(default_factory=list)
    next: dict[str, int] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)


def stripped(text: str) -> str:
    """A card without its version 2 lines."""
    lines = text.split("\n")
    if not FENCE.match(lines[0].rstrip("\r")):
        return text
    end = next((i for i in range(1, len(lines)) if FENCE.match(lines[i].rstrip("\r"))), 0)
    return "\n".join(x for i, x in enumerate(lines) if not (0 < i < end and (m := KEY.match(x.rstrip("\r"))) and m[1] in V2_LINES))


def plan(mine: Mine, day: str) -> Plan:
    """What the upgrade would do, and what keeps it from being done."""
    f = F.col("fields")
    status = F.coalesce(f["status"], F.lit("ok"))
    word = F.when(status == "ok", "keep").when(status.isin("discarded", "retracted"), "delete").when(status == "conflict", "move").otherwise("block")
    cards = mine.truths.select("path", "id", "state", "claim", "source", "body", "tags", f["location"].alias("location"), f["resolution"].alias("resolution"), F.coalesce(F.col("lists")["conflict_with"], F.array()).alias("with"), word.alias("disposition"))
    rows = {r.id: r for r in cards.collect()}  # cards are written by the driver, one by one
    out = Plan(paths={i: r.path for i, r in rows.items()})
    for i in sorted(rows, key=lambda x: (len(x), x)):
        r = rows[i]
        if r.disposition == "block" or r.state != "ok":
            out.blocks.append(f"{i}: unsupported or unreadable")
        else:
            getattr(out, r.disposition).append(i)
        if r.resolution and re.search(r"type:\s*attribute", r.resolution):
            out.blocks.append(f"{i}: two attributed claims need their difference in words first")
        if r.resolution and re.search(r"decided_by:\s*machine", r.resolution):
            out.machine.append(i)
    tally = counts.conservation(cards, "disposition", ["keep", "delete", "move", "block"]).first()
    if not tally.conserved:
        raise Refusal("cards are not conserved")
    edges = cards.select(F.col("id").alias("a"), F.explode("with").alias("raw")).select("a", F.expr("raw").alias("b"))
    from ..functions import canon_id

    edges = edges.select("a", canon_id(F.col("b")).alias("b"))
    roots = {r.node: r.root for r in ids.groups(edges, "a", "b", shared_dir(mine.spark)).collect()}
    members: dict[str, list[str]] = {}
    for i in out.move:
        members.setdefault(roots.get(i, i), []).append(i)
    for number, (root, moved) in enumerate(sorted(members.items(), key=lambda kv: (len(kv[1][0]), kv[1][0])), 1):
        candidate = lambda r: {k: v for k, v in (("claim", r.claim), ("source", r.source), ("location", r.location), ("quote", (r.body or "").strip("\n")), ("tags", list(r.tags))) if v}
        targets = sorted(i for i in out.keep if roots.get(i) == root)
        out.entries.append({"id": f"c{number:03}", "targets": targets, "candidates": [candidate(rows[i]) for i in moved], "created": day, "note": "moved from " + ", ".join(moved)})
    leaving = set(out.delete) | set(out.move)
    cited = mine.plans.select("doc", F.explode("cited").alias("raw")).select("doc", canon_id(F.col("raw")).alias("t"))
    inline = mine.cards.where(F.col("family").isin("draft", "final")).select(F.col("unit").alias("doc"), F.explode(F.regexp_extract_all("body", F.lit(r"<!--[ \t]*t:[ \t]*(t[0-9]+)[ \t]*-->"), 1)).alias("raw")).select("doc", canon_id(F.col("raw")).alias("t"))
    for r in cited.unionByName(inline).distinct().where(F.col("t").isin(*leaving) if leaving else F.lit(False)).orderBy("doc", "t").collect():
        out.blocks.append(f"{r.doc} cites {r.t}, which would go")
    kept_tags = {t for i in out.keep for t in rows[i].tags}
    out.blocks += [f"required tag {t} would have no card" for t in mine.project.lists.get("required_tags", []) if t not in kept_tags and any(t in rows[i].tags for i in leaving)]
    tokens = mine.files.select(F.explode(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"\b([tmc][0-9]+)\b"), 1)).alias("x"))
    paths = mine.files.select(F.explode(F.regexp_extract_all("path", F.lit(r"\b([tmc][0-9]+)\b"), 1)).alias("x"))
    top = tokens.unionByName(paths).where("length(x) <= 15").groupBy(F.substring("x", 1, 1).alias("kind")).agg(F.max(F.expr("CAST(substring(x, 2) AS BIGINT)")).alias("n"))
    high = {r.kind: r.n for r in top.collect()}
    out.next = {"truth": high.get("t", 0) + 1, "material": high.get("m", 0) + 1, "conflict": max(high.get("c", 0), len(out.entries)) + 1}
    return out


def _git_is_clean(root: str) -> bool:
    got = subprocess.run(["git", "-C", root, "status", "--porcelain"], capture_output=True, text=True, check=False)
    return got.returncode == 0 and not got.stdout.strip()


def upgrade(spark, root: str, apply: bool = False, day: str | None = None, clean=_git_is_clean) -> Plan:
    """The plan; with ``apply`` it is carried out, on a clean git worktree only.

    Afterwards the mine must fit but for its open conflicts, or all files are put back.
    """
    root, day = os.path.abspath(root), day or writers.today()
    mine = open_mine(spark, root, version=2)
    todo = plan(mine, day)
    if not apply:
        return todo
    if todo.blocks:
        raise Refusal("; ".join(todo.blocks))
    if not clean(root):
        raise Refusal("the git worktree is not clean; it is the backup")
    leaving = set(todo.delete) | set(todo.move)
    with single_writer(root):
        before: dict[str, bytes | None] = {}

        def read(*parts):
            with open(guarded(root, *parts), "rb") as f:
                return f.read()

        def write(data: bytes | None, *parts):
            place = guarded(root, *parts)
            if place not in before:
                before[place] = read(*parts) if os.path.lexists(place) else None
            if data is None:
                os.unlink(place)
            else:
                with open(place, "wb") as f:
                    f.write(data)

        try:
            for i in todo.keep:
                write(stripped(read(todo.paths[i]).decode("latin-1")).encode("latin-1"), todo.paths[i])
            for i in sorted(leaving):
                write(None, todo.paths[i])
            ledger = os.path.join(mine.paths["truths"], "verify-ledger.tsv")
            if os.path.lexists(os.path.join(root, ledger)):
                rows = read(ledger).split(b"\n")
                write(b"\n".join(x for x in rows if S.canon_id(x.split(b"\t")[0].decode("latin-1")) not in leaving), ledger)
            coverage = os.path.join(mine.paths["truths"], "coverage.md")
            if os.path.lexists(os.path.join(root, coverage)):
                write(_scrubbed(read(coverage).decode("latin-1"), leaving).encode("latin-1"), coverage)
            write(S.write_conflicts(todo.entries).encode(), "conflicts.json")
            write(S.write_sequences(todo.next).encode(), "id-sequences.json")
            for name in ("project.md", "config.yaml"):
                write(re.sub(rb"(?m)^version:[ \t]*2(?=[ \t\r]*$)", b"version: 3", read(name), count=1), name)
            after = open_mine(spark, root)
            for name, text in zip(("index.md", "tree.md"), commands.views(after)):
                write(text.encode(), mine.paths["truths"], name)
            intake = os.path.join(mine.paths["materials"], "intake-ledger.tsv")
            if not os.path.lexists(os.path.join(root, intake)):
                listed = [r.id for r in after.materials.select("id").orderBy("id").collect()]
                write((writers.INTAKE_HEADER + "".join("\t".join([m, "-", "legacy-unbound", "0", "-", "-", day]) + "\n" for m in listed)).encode(), intake)
            found = commands.validate(open_mine(spark, root))["diagnostics"]
            odd = [d for d in found if d["code"] != "CONFLICT-OPEN"]
            if odd or len(found) != len(todo.entries) or len(todo.keep) != open_mine(spark, root).truths.count():
                raise Refusal(f"the upgraded mine does not fit: {odd[:3]}")
        except BaseException:
            for place, data in before.items():
                if data is None:
                    if os.path.lexists(place):
                        os.unlink(place)
                else:
                    with open(place, "wb") as f:
                        f.write(data)
            raise
    return todo


def _scrubbed(text: str, leaving: set[str]) -> str:
    """A coverage register without mentions of cards that leave; an element that has none left is marked as skipped."""
    out = []
    for line in text.split("\n"):
        m = re.match(r"^([-*] .+?[ \t]*:[ \t]*)(.*?)(\r?)$", line)
        refs = re.findall(r"\bt\d+\b", m[2]) if m else []
        if refs and any(S.canon_id(t) in leaving for t in refs):
            left = [t for t in refs if S.canon_id(t) not in leaving]
            line = m[1] + (", ".join(left) if left else "skipped, its card left with the upgrade") + m[3]
        out.append(line)
    return "\n".join(out)
