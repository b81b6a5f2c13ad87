"""Write commands of a mine. Rows are computed as DataFrames; the driver commits them."""

from __future__ import annotations

import datetime
import hashlib
import os
import re
import shutil
import uuid

from pyspark.sql import functions as F

from ..core import cards as C
from ..core import registers as G
from ..core import state as S
from ..operators import counts, ledgers, references
from ..plans import commands
from ..sources.mine import Mine, open_mine
from . import Refusal, append_lines, guarded, replace_all, single_writer

VERIFY_HEADER = "# id\tsha256\tverdict\tround\tstandard\tdate\n"
INTAKE_HEADER = "# id\tsource digest\tword\tsources\tcopy digest\tnote\tdate\n"


def today() -> str:
    return datetime.date.today().isoformat()


def _one_field(value: str, what: str) -> str:
    if not value or re.search(r"[\x00-\x1f\x7f]", value):
        raise Refusal(f"{what} must be one field without control characters")
    return value


def attest(mine: Mine, verdict: str, round_: str, standard: str, ids: list[str], day: str | None = None) -> list[str]:
    """Appends a verdict for each id, bound to its current digest; all are there and none is retracted, or nothing is written."""
    if verdict not in ("verified", "failed") or not re.fullmatch(r"\d+", round_):
        raise Refusal("usage: verified|failed, a round number, a standard, ids")
    _one_field(standard, "the standard")
    wanted = [S.canon_id(i) for i in ids]
    if not wanted or None in wanted:
        raise Refusal("an id is misspelt")
    with single_writer(mine.root):
        fresh = open_mine(mine.spark, mine.root)  # digests are taken under the lock
        units = fresh.truths.select("id", "digest", F.lit(False).alias("retracted")).unionByName(fresh.materials.select("id", F.col("copy_digest").alias("digest"), F.coalesce(F.col("status") == "retracted", F.lit(False)).alias("retracted")))
        found = {r.id: r for r in units.where(F.col("id").isin(*wanted)).collect()}
        if missing := [i for i in wanted if i not in found]:
            raise Refusal(f"no such unit: {missing[0]}")
        if gone := [i for i in wanted if found[i].retracted]:
            raise Refusal(f"retracted: {gone[0]}")
        lines = ["\t".join([i, found[i].digest, verdict, round_, standard, day or today()]) for i in wanted]
        append_lines(guarded(mine.root, mine.paths["truths"], "verify-ledger.tsv"), lines, VERIFY_HEADER)
    return lines


def intake(mine: Mine, material: str | None = None, note: str = "-", no_source: bool = False, anchor_existing: bool = False, day: str | None = None) -> list[str]:
    """Declares one material, or anchors all that no row binds yet; stale ones are never bound anew."""
    if anchor_existing and (no_source or material):
        raise Refusal("anchoring takes all unbound materials and no other option")
    _one_field(note, "the note")
    with single_writer(mine.root):
        fresh = open_mine(mine.spark, mine.root)
        raw = fresh.family("raw").select(F.col("unit").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "digest")
        trees = counts.tree_digest(raw, "id", "name", "digest").join(raw.groupBy("id").agg(F.count("*").alias("sources")), "id")
        live = fresh.materials.where("status IS NULL OR status <> 'retracted'").select("id", "copy_digest").join(trees, "id", "left")
        if anchor_existing:
            last = ledgers.last_row_wins(fresh.intake_rows()[0].where("id IS NOT NULL"), "id", "row_ord")
            bound = last.where(F.col("word").isin("declared", "anchored", "no-source")).select("id")
            rows = references.unresolved(live, "id", bound.withColumnRenamed("id", "b"), "b").where("sources > 0")
            word = "anchored"
        else:
            own = S.canon_id(material or "")
            rows = live.where(F.col("id") == own)
            word = "no-source" if no_source else "declared"
        got = rows.orderBy("id").collect()
        if not anchor_existing:
            if not got:
                raise Refusal(f"no such live material: {material}")
            if not no_source and not got[0].sources:
                raise Refusal("there is no source file; if that is right, say so with no_source")
        lines = ["\t".join([r.id, "-" if no_source else r.tree_digest, word, "0" if no_source else str(r.sources), r.copy_digest, note, day or today()]) for r in got]
        if lines:
            append_lines(guarded(mine.root, mine.paths["materials"], "intake-ledger.tsv"), lines, INTAKE_HEADER)
    return lines


def backfill(mine: Mine, day: str | None = None) -> list[str]:
    """A legacy-unbound row for each material without any; a second run adds nothing."""
    with single_writer(mine.root):
        fresh = open_mine(mine.spark, mine.root)
        seen = fresh.intake_rows()[0].where("id IS NOT NULL").select(F.col("id").alias("b")).distinct()
        rows = references.unresolved(fresh.materials.select("id"), "id", seen, "b").orderBy("id").collect()
        lines = ["\t".join([r.id, "-", "legacy-unbound", "0", "-", "-", day or today()]) for r in rows]
        if lines:
            append_lines(guarded(mine.root, mine.paths["materials"], "intake-ledger.tsv"), lines, INTAKE_HEADER)
    return lines


def _state(mine: Mine, name: str, reader):
    text, read = mine.text(name)
    if text is None:
        raise Refusal(f"{name} is {read}")
    return reader(text)


def alloc(mine: Mine, namespace: str) -> str:
    """The next id of a namespace; it is never granted again."""
    with single_writer(mine.root):
        granted, after = S.grant(_state(mine, "id-sequences.json", S.read_sequences), namespace)
        replace_all({guarded(mine.root, "id-sequences.json"): S.write_sequences(after).encode()})
    return granted


def conflict_add(mine: Mine, entry: dict) -> str:
    """Adds an open conflict under an id that is granted here; the whole store fits its contract before anything is written."""
    if "id" in entry:
        raise Refusal("ids are granted, not chosen")
    S.check_entry(entry, with_id=False)
    with single_writer(mine.root):
        found = _state(mine, "conflicts.json", S.read_conflicts)
        granted, after = S.grant(_state(mine, "id-sequences.json", S.read_sequences), "conflict")
        text = S.write_conflicts([*found, {"id": granted, **entry}])
        S.read_conflicts(text)
        replace_all({guarded(mine.root, "id-sequences.json"): S.write_sequences(after).encode(), guarded(mine.root, "conflicts.json"): text.encode()})
    return granted


def conflict_remove(mine: Mine, entry_id: str) -> None:
    """Removes an open conflict that has been decided; one that is not there is an error."""
    own = S.canon_id(entry_id)
    with single_writer(mine.root):
        found = _state(mine, "conflicts.json", S.read_conflicts)
        if own not in {e["id"] for e in found}:
            raise Refusal(f"no such conflict: {entry_id}")
        replace_all({guarded(mine.root, "conflicts.json"): S.write_conflicts([e for e in found if e["id"] != own]).encode()})


def reindex(mine: Mine, move=os.replace) -> None:
    """Writes both generated views or neither."""
    with single_writer(mine.root):
        texts = commands.views(open_mine(mine.spark, mine.root))
        places = [guarded(mine.root, mine.paths["truths"], n) for n in ("index.md", "tree.md")]
        replace_all({p: t.encode() for p, t in zip(places, texts)}, move)


def retag(mine: Mine, old: str, new: str, dry: bool = False, move=os.replace) -> list[str]:
    """Renames or merges a tag in all tag lists; every other byte stays. Rolls back if the mine fits less than before."""
    _one_field(old, "a tag")
    _one_field(new, "a tag")
    change = lambda members: list(dict.fromkeys(new if t == old else t for t in members)) if old in members else members
    with single_writer(mine.root):
        fresh = open_mine(mine.spark, mine.root)
        paths = [(r.path, "tags") for r in fresh.truths.where(F.array_contains("tags", old)).select("path").collect()]
        paths += [(r.path, "scope_tags") for r in fresh.plans.where(F.array_contains(F.coalesce(F.col("lists")["scope_tags"], F.array()), F.lit(old))).select("path").collect()]
        if old in fresh.project.lists.get("required_tags", []):
            paths.append(("project.md", "required_tags"))
        changes, before = {}, {}
        for path, key in sorted(paths):
            place = guarded(mine.root, path)
            with open(place, "rb") as f:
                before[place] = f.read()
            changes[place] = C.set_list(before[place].decode("latin-1"), key, lambda members: _latin(change, members)).encode("latin-1")
        if dry or not changes:
            return [p for p, _ in sorted(paths)]
        was = {(d["code"], d["message"]) for d in commands.validate(fresh)["diagnostics"]}
        replace_all(changes, move)
        now = {(d["code"], d["message"]) for d in commands.validate(open_mine(mine.spark, mine.root))["diagnostics"]}
        if now - was:
            replace_all(before)
            raise Refusal(f"the renamed mine does not fit: {sorted(now - was)[0]}")
    return [p for p, _ in sorted(paths)]


def _latin(change, members: list[str]) -> list[str]:
    """change() on members whose bytes were read as Latin-1."""
    return [x.encode("utf-8").decode("latin-1") for x in change([m.encode("latin-1").decode("utf-8") for m in members])]


def _artifact(mine: Mine, doc: str, kind: str) -> tuple[dict[str, bytes], str]:
    """(files by name, digest) of a draft or final, a single file or a tree."""
    base = mine.place(mine.paths["documents"], doc, kind)
    files: dict[str, bytes] = {}
    if os.path.isfile(base + ".md"):
        with open(base + ".md", "rb") as f:
            files[""] = f.read()
    elif os.path.isdir(base):
        for folder, _, names in os.walk(base):
            for name in names:
                place = os.path.join(folder, name)
                with open(place, "rb") as f:
                    files[os.path.relpath(place, base)] = f.read()
    if not files:
        raise Refusal(f"{doc} has no {kind}")
    digest = {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    if "" in files:
        return files, digest[""]
    return files, hashlib.sha256("".join(f"{n}\0{digest[n]}\n" for n in sorted(digest, key=str.encode)).encode()).hexdigest()


def _doc(doc: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", doc):
        raise Refusal(f"no document id: {doc}")
    return doc


def seal_review(mine: Mine, doc: str, kind: str = "draft") -> None:
    """Binds a review to the bytes and the context that it judged; a legacy marker goes."""
    with single_writer(mine.root):
        fresh = open_mine(mine.spark, mine.root)
        _, digest = _artifact(fresh, _doc(doc), kind)
        context = commands.context_digests(fresh).where(F.col("doc") == doc).first()
        if context is None:
            raise Refusal(f"{doc} has no plan")
        place = guarded(mine.root, mine.paths["documents"], doc, "review.md")
        try:
            with open(place, encoding="utf-8", newline="") as f:
                text = C.set_fields(f.read(), {"review_legacy": None, "reviewed_kind": kind, "reviewed_digest": digest, "review_context_digest": context.context_digest})
        except (OSError, ValueError) as e:
            raise Refusal(str(e)) from None
        replace_all({place: text.encode()})


def consecrate(mine: Mine, doc: str, check=None) -> None:
    """Promotes a draft to the final version if its review's gate is clean and its seal current; any failure restores what was there."""
    with single_writer(mine.root):
        fresh = open_mine(mine.spark, mine.root)
        files, digest = _artifact(fresh, _doc(doc), "draft")
        home = guarded(mine.root, mine.paths["documents"], doc)
        with open(os.path.join(home, "review.md"), encoding="utf-8") as f:
            review = f.read()
        if found := G.gate_findings(review):
            raise Refusal(f"the gate is not clean: {found[0][1]}")
        fields = C.read_card(review).fields
        context = commands.context_digests(fresh).where(F.col("doc") == doc).first()
        if fields.get("reviewed_digest") != digest or context is None or fields.get("review_context_digest") != context.context_digest:
            raise Refusal("the review does not cover this draft in its present context")
        was = {(d["code"], d["message"]) for d in commands.validate(fresh)["diagnostics"]}
        final, keep, mark = os.path.join(home, "final"), os.path.join(home, f".consecrate-backup-{uuid.uuid4().hex}"), os.path.join(home, ".consecrate-in-flight")
        names = [n for n in ("final", "final.md") if os.path.lexists(os.path.join(home, n))]
        os.mkdir(keep)
        with open(mark, "w") as f:
            f.write(doc)
        try:
            for n in names:
                shutil.move(os.path.join(home, n), os.path.join(keep, n))
            for name, data in files.items():
                place = final + ".md" if not name else os.path.join(final, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as f:
                    f.write(data)
            os.unlink(mark)
            shutil.move(keep, (aside := f"{mine.root}.{uuid.uuid4().hex}.backup"))
            keep = aside
            now = {(d["code"], d["message"]) for d in (check or commands.validate)(open_mine(mine.spark, mine.root))["diagnostics"]}
            if now - was:
                raise Refusal(f"the mine would not fit: {sorted(now - was)[0]}")
        except BaseException:
            for n in ("final", "final.md"):
                place = os.path.join(home, n)
                if os.path.isdir(place):
                    shutil.rmtree(place)
                elif os.path.lexists(place):
                    os.unlink(place)
            for n in names:
                shutil.move(os.path.join(keep, n), os.path.join(home, n))
            shutil.rmtree(keep)
            if os.path.lexists(mark):
                os.unlink(mark)
            raise
        shutil.rmtree(keep)
