"""Read commands over a mine: validate, census, scope, pull, impact, gaps, status, reindex and the rest.

Checks of cards are DataFrames that give diagnostics; the few files of which
there is one are judged on the driver and join in as rows. Every check counts
what it has looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as R
from ..core import registers as G
from ..core import state as S
from ..core.markdown import section
from ..core.pointer import BEGIN, END, POINTER, TEMPLATE, block_state
from ..operators import counts, diff, ids, ledgers, lookup, references
from ..operators import registers as tables
from ..sources import lines, shared_dir
from ..sources.mine import DIAGNOSTIC, Mine, register
from ..sources.raw import read_raw_sources

TRUTH_KEYS = ("id", "claim", "source", "tags")
MATERIAL_KEYS = ("id", "title", "origin", "role", "format", "added", "status", "summary")
PLAN_KEYS = ("doc_id", "doc_type", "tone", "status")
V2_KEYS = ("status", "resolution", "conflict_with")
ENUMS = {
    ("truth", "provenance"): ("stated", "adopted", "derived"),
    ("material", "origin"): ("file", "user-answer", "prior-doc", "conversation", "research"),
    ("material", "status"): ("collected", "converted", "verified", "used", "retracted"),
    ("material", "stage"): ("plan", "applied"),
    ("plan", "status"): ("planned", "drafting", "reviewing", "done", "stale"),
    ("plan", "audience"): ("internal", "external"),
}
DATES = {"material": ("added", "dated", "retrieved_at"), "truth": ("as_of",)}
SEAL_CODES = {"empty": "TRUTH-BODY-EMPTY", "fragment": "TRUTH-BODY-FRAGMENT", "split-block": "SEAL-SPLIT-BLOCK", "mismatch": "SEAL-QUOTE-MISSING", "unavailable": "SEAL-UNCHECKED"}


def _diag(df: DataFrame, code, subject, detail="", path="path", severity: str = "error") -> DataFrame:
    as_col = lambda x: x if not isinstance(x, str) else F.lit(x)
    return df.select(as_col(code).alias("code"), F.col(path).alias("path"), F.col(subject).cast("string").alias("subject"), as_col(detail).cast("string").alias("detail"), F.lit(severity).alias("severity"))


# card checks


def card_checks(mine: Mine) -> DataFrame:
    """Form of every card, in one pass: frontmatter, keys, vocabularies, dates, ids."""
    f, lists, unit, family = F.col("fields"), F.col("lists"), F.col("unit"), F.col("family")
    ok = F.col("state") == "ok"
    finding = lambda code, detail=None: F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))
    is_ = lambda name: ok & (family == name)
    few = lambda key: F.coalesce(F.size(lists[key]), F.lit(0)) < 1
    no = lambda key: F.trim(F.coalesce(f[key], F.lit(""))) == ""
    own = F.when(family == "plan", f["doc_id"]).otherwise(f["id"])
    roles = mine.project.lists.get("roles", [])
    single = [
        F.when(F.col("state") == "missing", finding("FM-MISSING")),
        F.when(F.col("state") == "unclosed", finding("FM-UNCLOSED")),
        F.when(ok & own.isNotNull() & (own != unit), finding("ID-MISMATCH", own)),
        F.when((family != "plan") & (R.canon_id(unit) != unit), finding("ID-SPELLING", R.canon_id(unit))),
        F.when(is_("truth") & R.has_field(f, list(V2_KEYS)), finding("TRUTH-V2-FIELD")),
        F.when(is_("truth") & (f["provenance"] == "derived") & few("derived_from"), finding("TRUTH-DERIVED-FROM")),
        F.when(is_("plan") & (f["audience"] == "external") & few("publication_labels"), finding("PLAN-LABELS")),
        F.when(is_("material") & (f["origin"] == "research") & (no("url") | no("retrieved_at")), finding("MAT-RESEARCH")),
        F.when(is_("material") & f["role"].isNotNull() & ~f["role"].isin(*roles), finding("MAT-ROLE", f["role"])) if roles else F.lit(None),
    ]
    single += [F.when(is_(kind) & f[key].isNotNull() & ~f[key].isin(*words), finding("ENUM-UNKNOWN", F.concat(F.lit(f"{key}: "), f[key]))) for (kind, key), words in ENUMS.items()]
    single += [F.when(is_(kind) & f[key].isNotNull() & ~R.date_valid(f[key]), finding("DATE-INVALID", f[key])) for kind, keys in DATES.items() for key in keys]
    for kind, keys in (("truth", TRUTH_KEYS), ("material", MATERIAL_KEYS), ("plan", PLAN_KEYS)):
        for key in keys:
            problem = F.when(lists[key].isNull() | (F.trim(f[key]) == ""), R.field_problem(f[key]))  # a list is no placeholder
            single.append(F.when(is_(kind) & problem.isNotNull(), finding("FIELD-REQUIRED", F.concat(F.lit(f"{key}: "), problem))))
    every = F.concat(F.array(*single), F.transform("duplicates", lambda k: finding("FM-DUPLICATE-KEY", k)), F.transform("open_lists", lambda k: finding("FM-LIST-UNCLOSED", k)))
    found = mine.cards.where(family.isin("truth", "material", "plan")).select("path", "unit", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("d"))
    return _diag(found, F.col("d.code"), "unit", F.col("d.detail"))


def seals(mine: Mine) -> DataFrame:
    """Truths with the state of their seal against their source's converted text."""
    texts = mine.materials.where("state = 'ok'")
    return references.seal_states(mine.truths, "source", "body", texts, "id", "body")


def reference_checks(mine: Mine) -> list[DataFrame]:
    """Every reference between artifacts."""
    truths, materials, plans = mine.truths, mine.materials, mine.plans
    tid = truths.select("id")
    out = [
        _diag(references.unresolved(truths, "source", materials, "id"), "TRUTH-SOURCE-DANGLING", "id", F.col("source")),
        _diag(references.resolved(truths, "source", materials.where("status = 'retracted'"), "id"), "SEAL-RETRACTED", "id", F.concat(F.lit(mine.paths["materials"] + "/"), F.col("source"), F.lit("/converted.md"))),
        _diag(references.resolved(truths.where("provenance = 'stated'"), "source", materials.where("origin = 'research'"), "id"), "TRUTH-RESEARCH-STATED", "id"),
        _diag(references.unresolved(truths.select("path", "id", F.explode(F.transform(F.coalesce(F.col("lists")["derived_from"], F.array()), lambda x: F.coalesce(R.canon_id(x), x))).alias("ref")), "ref", tid.withColumnRenamed("id", "t"), "t"), "TRUTH-DERIVED-DANGLING", "id", F.col("ref")),
        _diag(truths.where(F.array_contains(F.coalesce(F.col("lists")["derived_from"], F.array()), F.col("id"))), "TRUTH-SELF", "id"),
        _diag(materials.where(F.col("fields")["corrects"] == F.col("id")), "MAT-SELF", "id"),
        _diag(references.unresolved(materials.where(F.col("fields")["corrects"].isNotNull()).withColumn("ref", F.coalesce(R.canon_id(F.col("fields")["corrects"]), F.col("fields")["corrects"])), "ref", materials.select(F.col("id").alias("m")), "m"), "MAT-CORRECTS-DANGLING", "id", F.col("ref")),
    ]
    listed = plans.select("path", "doc", F.explode("cited").alias("raw")).withColumn("ref", F.coalesce(R.canon_id(F.col("raw")), F.col("raw")))
    inline = mine.cards.where(F.col("family").isin("draft", "final")).select("path", F.col("unit").alias("doc"), F.explode(F.regexp_extract_all("body", F.lit(r"<!--[ \t]*t:[ \t]*(t[0-9]+)[ \t]*-->"), 1)).alias("raw")).withColumn("ref", R.canon_id(F.col("raw")))
    for cited in (listed, inline):
        out.append(_diag(references.unresolved(cited, "ref", tid.withColumnRenamed("id", "t"), "t"), "PLAN-CITED-DANGLING", "doc", F.col("ref")))
    out.append(_diag(seals(mine).where("seal <> 'sealed'"), functools.reduce(lambda c, kv: c.when(F.col("seal") == kv[0], kv[1]), SEAL_CODES.items(), F), "id", F.col("source")))
    folders = mine.files.select(F.regexp_extract("path", rf"^{re.escape(mine.paths['materials'])}/(m[0-9]+)/", 1).alias("folder")).where("folder <> ''").distinct().withColumn("path", F.col("folder"))
    out.append(_diag(references.unresolved(folders, "folder", materials, "id"), "MAT-NO-CONVERTED", "folder"))
    out.append(_diag(_repeated(mine, "truth"), "ID-REPEATED", "unit"))
    tags = mine.project.lists.get("required_tags", [])
    if tags:
        words = mine.spark.createDataFrame([(t, "project.md") for t in tags], "tag string, path string")
        out.append(_diag(references.uncovered(words, "tag", truths, "tags"), "REQTAG-EMPTY", "tag"))
    return out


def _repeated(mine: Mine, family: str) -> DataFrame:
    own = mine.family(family).withColumn("canon", R.canon_id(F.col("unit")))
    return own.join(counts.duplicates(own, "canon").select("canon"), "canon", "left_semi")


def ledger_checks(mine: Mine) -> list[DataFrame]:
    out = []
    for rows, read, folder, name in ((*mine.verify_rows(), mine.paths["truths"], "verify-ledger.tsv"), (*mine.intake_rows(), mine.paths["materials"], "intake-ledger.tsv")):
        path = f"{folder}/{name}"
        if read in ("headless", "torn", "unreadable"):
            out.append(mine.lines_table([("LEDGER-UNREADABLE" if read == "unreadable" else "LEDGER-MALFORMED", path, name, read, "error")], DIAGNOSTIC))
        marked = rows.withColumn("path", F.lit(path))
        out.append(_diag(marked.where("NOT fit"), "LEDGER-MALFORMED" if name.startswith("verify") else "MAT-INTAKE-LEDGER", "id", F.concat(F.lit("row "), F.col("row_ord").cast("string"))))
        out.append(_diag(marked.where("fit AND NOT known"), "LEDGER-VERDICT", "id", F.concat(F.lit("row "), F.col("row_ord").cast("string"))))
    last = ledgers.last_row_wins(mine.intake_rows()[0].where("id IS NOT NULL"), "id", "row_ord").where("known")
    live = mine.materials.where("status IS NULL OR status <> 'retracted'")
    out.append(_diag(references.unresolved(live, "id", last, "id"), "MAT-UNDECLARED", "id", severity="warning"))
    return out


# files of which there is one


def single_checks(mine: Mine) -> list[DataFrame]:
    """Diagnostics of the catalog, index, coverage, verify and state files, the queue and the gap register.

    The driver parses these files; what they mention is joined with the cards.
    """
    out: list[tuple] = []
    mentions: list[tuple] = []  # code, path, subject, detail, family, ref
    listed: list[tuple] = []  # code, path, family, ref
    bad = lambda code, path, subject="", detail="", severity="error": out.append((code, path, str(subject), str(detail), severity))
    truths_dir, counters = mine.paths["truths"], {}
    sectioned: dict[str, set[str]] = {}

    text, read = mine.text("catalog.md")
    if text is None:
        bad("CAT-MISSING" if read == "absent" else "CAT-UNREADABLE", "catalog.md")
    else:
        rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in text.split("\n") if x.strip().startswith("|")]
        listed += [("CAT-ORPHAN", "catalog.md", "material", S.canon_id(r[0])) for r in rows if S.canon_id(r[0])] or [("CAT-ORPHAN", "catalog.md", "material", None)]
    text, read = mine.text(truths_dir, "index.md")
    if text is not None:
        found = Counter(S.canon_id(x) for x in re.findall(r"(?m)^- (t\d+):", text))
        for t in sorted(x for x, n in found.items() if n > 1):
            bad("INDEX-DUPLICATE", f"{truths_dir}/index.md", t)
        listed += [("INDEX-OUT-OF-SYNC", f"{truths_dir}/index.md", "truth", t) for t in found] or [("INDEX-OUT-OF-SYNC", f"{truths_dir}/index.md", "truth", None)]
    elif read == "unreadable":
        bad("INDEX-UNREADABLE", f"{truths_dir}/index.md")
    scanned, read = register(mine, truths_dir, "coverage.md")
    if scanned is not None:
        path = f"{truths_dir}/coverage.md"
        for number, material, element, refs, fit in G.coverage_rows(scanned):
            if not fit:
                bad("COVERAGE-MALFORMED", path, material, f"line {number}")
            if material != "legacy" and fit:
                sectioned.setdefault(S.canon_id(material), set()).update(map(S.canon_id, refs))
            if material != "legacy":
                mentions.append(("COVERAGE-DANGLING", path, material, f"line {number}", "material", S.canon_id(material)))
            mentions += [("COVERAGE-DANGLING", path, t, f"line {number}", "truth", S.canon_id(t)) for t in refs]
    elif read == "unreadable":
        bad("COVERAGE-UNREADABLE", f"{truths_dir}/coverage.md")
    scanned, read = register(mine, truths_dir, "verify.md")
    if scanned is not None:
        path = f"{truths_dir}/verify.md"
        roles = mine.roster("verify.sections")
        for name in roles:
            if not section(scanned, name):
                bad("VERIFY-SECTION", path, name)
        for number, what in scanned.problems:
            if what in G.UNENDED:
                bad(f"HQ-UNTERMINATED-{G.UNENDED[what]}", path, number)
        for number, st, owner, _ in G.queue_items(scanned, roles[2]) if roles else ():
            if st == "open" and not owner:
                bad("HQ-UNTAGGED", path, number)
    elif read == "unreadable":
        bad("VERIFY-UNREADABLE", f"{truths_dir}/verify.md")
    for name, reader in (("conflicts.json", S.read_conflicts), ("id-sequences.json", S.read_sequences)):
        text, read = mine.text(name)
        if text is None:
            bad("STATE-MISSING" if read == "absent" else "STATE-UNREADABLE", name)
            continue
        try:
            found = reader(text)
        except S.Refused as e:
            bad("STATE-MALFORMED", name, e.code, e)
            continue
        if name == "conflicts.json":
            for e in found:
                bad("CONFLICT-OPEN", name, e["id"])
                mentions += [("CONF-TARGET-DANGLING", name, e["id"], t, "truth", t) for t in e["targets"]]
                mentions += [("CONF-SOURCE-DANGLING", name, e["id"], c["source"], "material", c["source"]) for c in e["candidates"]]
        else:
            counters = found
    for code, detail, severity in config_findings(mine.config):
        bad(code, "config.yaml", "", detail, severity)
    for code, key in mine.contract[1]:
        bad(code, "schema", "", key)
    block = block_state(mine.text(POINTER)[0], mine.text(TEMPLATE)[0], BEGIN, END)
    if block not in ("none", "ok"):  # a stale pointer is no fault of the mine
        bad("CLAUDE-BLOCK-NOTEMPLATE" if block == "no-template" else "CLAUDE-BLOCK-STALE", POINTER, "", block, "warning")
    for name in mine.home.names(truths_dir):
        if re.fullmatch(r"t\d+\.md", name) and mine.home.is_dir(truths_dir, name):
            bad("TRUTH-DIR", f"{truths_dir}/{name}", name.removesuffix(".md"))
    finals = False
    for doc in mine.home.names(mine.paths["documents"]):
        own = mine.home.names(mine.paths["documents"], doc)
        finals |= "final" in own or "final.md" in own
        if left := [x for x in own if x.startswith((".consecrate-in-flight", ".consecrate-backup"))]:
            bad("CONSEC-INTERRUPTED", f"{mine.paths['documents']}/{doc}", doc, left[0])
    for doc, read in unread_reviews(mine).items():
        bad("REVIEW-UNREADABLE", f"{mine.paths['documents']}/{doc}/review.md", doc, read)
    if _completeness(mine) == "required" and finals and mine.roster("gaps.sections"):
        scanned, read = register(mine, "gaps.md")
        if scanned is None:
            bad("COMP-NO-REGISTER", "gaps.md", read)
        else:
            for number, name, kind, detail in _gap_register(mine, scanned):
                if kind == "malformed":
                    bad("COMP-MALFORMED", "gaps.md", number, detail)
                elif name == mine.roster("gaps.sections")[0]:
                    bad("COMP-OPEN-GAPS", "gaps.md", number, kind)

    units = mine.cards.where(F.col("family").isin("truth", "material")).select(F.col("family").alias("f"), R.canon_id(F.col("unit")).alias("u"))
    parts = [mine.lines_table(out, DIAGNOSTIC)]
    if mentions:
        rows = mine.lines_table(mentions, "code string, path string, subject string, detail string, family string, ref string")
        parts.append(_diag(rows.join(units, (F.col("family") == F.col("f")) & (F.col("ref") == F.col("u")), "left_anti"), F.col("code"), "subject", F.col("detail")))
    if sectioned:  # a material that has a section lists all its truths there
        have = mine.lines_table([(m, t) for m, ts in sectioned.items() for t in ts], "m string, t string")
        own = mine.truths.select("id", "source", F.lit(f"{truths_dir}/coverage.md").alias("path")).where(F.col("source").isin(*sectioned))
        parts.append(_diag(own.join(have, (F.col("source") == F.col("m")) & (F.col("id") == F.col("t")), "left_anti"), "COVERAGE-UNLISTED", "id", F.col("source")))
    if listed:
        rows = mine.lines_table(listed, "code string, path string, family string, ref string")
        heads = rows.select("code", "path", "family").distinct()
        both = units.join(F.broadcast(heads), F.col("f") == F.col("family")).select("code", "path", "f", "u")
        same = ["code", "path"]
        off = rows.where("ref IS NOT NULL").select("code", "path", F.col("ref").alias("id")).join(both.select("code", "path", F.col("u").alias("id")).withColumn("there", F.lit(1)), [*same, "id"], "full_outer")
        known = rows.where("ref IS NOT NULL").select("code", "path", F.col("ref").alias("id")).withColumn("listed", F.lit(1))
        off = off.join(known, [*same, "id"], "left").where("there IS NULL OR listed IS NULL")
        parts.append(_diag(off, F.col("code"), "id", F.when(F.col("there").isNull(), "not on disk").otherwise("not listed")))
    if counters:
        table = mine.lines_table([(n, v) for n, v in counters.items()], "namespace string, next long").withColumn("next", F.col("next").cast("decimal(38,0)"))
        observed = units.where("u IS NOT NULL").select(F.col("f").alias("namespace"), F.expr("CAST(substring(u, 2) AS DECIMAL(38,0))").alias("number"))
        behind = ids.counters_behind(observed, "namespace", "number", table).withColumn("path", F.lit("id-sequences.json"))
        parts.append(_diag(behind, "IDSEQ-BEHIND", "namespace", F.concat(F.col("next").cast("string"), F.lit(" is next, "), F.col("observed").cast("string"), F.lit(" is there"))))
    return parts


#: Keys of the configuration by section, with the values or the range that each may have.
CONFIG = {
    "paths": {"inbox": None, "materials": None, "truths": None, "documents": None},
    "fidelity": {"completeness": ("off", "required")},
    "conflicts": {"detection": None, "attribution": None},
    "verify": {"strength": (1, 5), "scale": ("small", "medium", "large"), "repeat": None, "max_rounds": (1, 99)},
    "review": {"strength": (1, 5), "max_rounds": (1, 99)},
    "gaps": {"markers": None},
}


def config_findings(config: dict) -> list[tuple[str, str, str]]:
    """(code, detail, severity): values outside their range are errors, unknown keys warnings."""
    out = []
    for name, own in config.items():
        if name in ("version", "authority"):
            continue
        known = CONFIG.get(name)
        if known is None or not isinstance(own, dict):
            out.append(("CFG-UNKNOWN-KEY", name, "warning"))
            continue
        for key, value in own.items():
            rule = known.get(key)
            if key not in known:
                if not (name == "verify" and value.isdigit()):  # members of repeat
                    out.append(("CFG-UNKNOWN-KEY", f"{name}.{key}", "warning"))
            elif rule and isinstance(rule[0], int):
                if not value.isdigit() or not rule[0] <= int(value) <= rule[1]:
                    out.append(("CFG-RANGE", f"{name}.{key}: {value}", "error"))
            elif rule and value not in rule:
                out.append(("CFG-VALUE", f"{name}.{key}: {value}", "error"))
    own = config.get("gaps", {})
    if isinstance(own, dict) and own.get("markers"):
        try:
            re.compile(own["markers"])
        except re.error:
            out.append(("CFG-MARKERS", own["markers"], "error"))
    return out


def unread_reviews(mine: Mine) -> dict[str, str]:
    """Documents whose review is there but can't be read; it is unknown, not absent."""
    out = {}
    documents = mine.paths["documents"]
    for doc in mine.home.names(documents):
        if "review.md" in mine.home.names(documents, doc) and not mine.home.can_read(documents, doc, "review.md"):
            out[doc] = "a folder" if mine.home.is_dir(documents, doc, "review.md") else "unreadable"
    return out


def _gap_register(mine: Mine, scanned) -> list:
    """The gap register by the mine's own sections and kinds; nothing where these don't hold."""
    names = mine.roster("gaps.sections")
    return G.gap_register(scanned, tuple(mine.roster("gaps.enum.kind")), tuple(names)) if names else []


def _completeness(mine: Mine) -> str:
    own = mine.config.get("fidelity", {})
    return own.get("completeness", "off") if isinstance(own, dict) else "off"


# documents


def artifact_digests(mine: Mine, family: str) -> DataFrame:
    """doc, digest, kinds: of a single file its own digest, of a tree the manifest's."""
    files = mine.family(family).select(F.col("unit").alias("doc"), F.regexp_replace("path", rf"^.*?/{family}(\.md$|/)", "").alias("name"), "digest")
    one = files.groupBy("doc").agg(F.max(F.when(F.col("name") == "", F.col("digest"))).alias("single"), F.countDistinct(F.col("name") == "").alias("kinds"))
    tree = counts.tree_digest(files.where("name <> ''"), "doc", "name", "digest")
    return one.join(tree, "doc", "left").select("doc", F.coalesce("single", "tree_digest").alias("digest"), "kinds")


def context_digests(mine: Mine) -> DataFrame:
    """doc, context_digest: a manifest of the cited cards, their sources' copies, the configuration and the schema."""
    cited = mine.plans.select("doc", F.explode("cited").alias("raw")).select("doc", R.canon_id(F.col("raw")).alias("t")).distinct()
    truths = cited.join(mine.truths.select(F.col("id").alias("t"), "source", F.col("digest").alias("d")), "t")
    parts = truths.select("doc", F.concat(F.lit("truth "), F.col("t")).alias("name"), F.col("d").alias("digest"))
    copies = mine.materials.select(F.col("id").alias("source"), "copy_digest")
    parts = parts.unionByName(truths.select("doc", "source").distinct().join(copies, "source").select("doc", F.concat(F.lit("material "), F.col("source")).alias("name"), F.col("copy_digest").alias("digest")))
    for name, file in (("config", "config.yaml"), ("schema", "schema")):
        text, _ = mine.text(file)
        parts = parts.unionByName(mine.plans.select("doc", F.lit(name).alias("name"), F.lit(hashlib.sha256((text or "").encode("utf-8", "surrogateescape")).hexdigest()).alias("digest")))
    return counts.tree_digest(parts, "doc", "name", "digest").withColumnRenamed("tree_digest", "context_digest")


def document_checks(mine: Mine) -> list[DataFrame]:
    """The gate and the seals of documents that have a final version."""
    finals = artifact_digests(mine, "final").withColumn("path", F.concat(F.lit(mine.paths["documents"] + "/"), "doc"))
    reviews = mine.family("review").select("path", F.col("unit").alias("doc"), "fields", "body")
    shipped = references.resolved(reviews, "doc", finals, "doc")
    found = tables.gate(shipped, "path", "body").withColumn("doc", F.element_at(F.split("path", "/"), -2))
    f = F.col("fields")
    legacy, kind = F.coalesce(f["review_legacy"], F.lit("")) != "", f["reviewed_kind"]
    bound = F.array(kind, f["reviewed_digest"], f["review_context_digest"])
    n = F.size(F.filter(bound, lambda x: x.isNotNull() & (x != "")))
    seal = shipped.join(finals.select("doc", F.col("digest").alias("now")), "doc").join(context_digests(mine), "doc", "left")
    code = (
        F.when(legacy & (n > 0), "GATE-SEAL-MARKER")
        .when(legacy, None)
        .when((n < 3) | ~kind.isin("draft", "final"), "GATE-UNSEALED")
        .when(f["reviewed_digest"] != F.col("now"), "GATE-FINAL-DIGEST")
        .when(~f["review_context_digest"].eqNullSafe(F.col("context_digest")), "GATE-CONTEXT-DIGEST")
    )
    return [
        _diag(references.unresolved(finals, "doc", reviews, "doc").where(~F.col("doc").isin(*unread_reviews(mine))), "GATE-NO-REVIEW", "doc"),
        _diag(finals.where("kinds > 1"), "GATE-DUAL-FINAL", "doc"),
        _diag(found, F.col("code"), "doc", F.concat(F.lit("line "), F.col("line").cast("string"))),
        _diag(seal.withColumn("code", code).where("code IS NOT NULL"), F.col("code"), "doc", F.when(F.col("code") != "GATE-UNSEALED", "").when(n == 0, "no seal").when(n < 3, "part of a seal").otherwise(F.concat(F.lit("of an unknown kind: "), kind))),
    ]


# commands


def diagnostics(mine: Mine) -> DataFrame:
    """All diagnostics: code, path, subject, detail, severity."""
    parts = [card_checks(mine), *reference_checks(mine), *ledger_checks(mine), *document_checks(mine), *single_checks(mine), *raw_checks(mine)]
    return functools.reduce(DataFrame.unionByName, parts)


def examined(mine: Mine) -> dict[str, int]:
    """How many of everything was looked at; a check that ran zero times shows."""
    sealed = {r.seal: r.n for r in seals(mine).groupBy("seal").agg(F.count("*").alias("n")).collect()}
    finals = artifact_digests(mine, "final").select("doc")
    reviews = references.resolved(mine.family("review").withColumnRenamed("unit", "doc"), "doc", finals, "doc")
    legacy = F.coalesce(F.col("fields")["review_legacy"], F.lit("")) != ""
    tally = counts.tallies(reviews, legacy=legacy, bound=~legacy & F.col("fields")["reviewed_digest"].isNotNull()).first()
    unchecked = sealed.get("unavailable", 0)
    return {
        "materials": mine.family("material").count(),
        "truths": sum(sealed.values()),
        "sealed": sealed.get("sealed", 0),
        "not_checked": unchecked,
        "failed": sum(sealed.values()) - sealed.get("sealed", 0) - unchecked,
        "documents": mine.family("plan").count(),
        "consecrated": finals.count(),
        "gate_checked": tally.population,
        "digest_bound": tally.bound,
        "legacy_unbound": tally.legacy,
    }


def validate(mine: Mine) -> dict:
    """The verdict as one object; diagnostics in the order of their path, code and subject."""
    rows = [r.asDict() for r in diagnostics(mine).orderBy("path", "code", "subject", "detail").collect()]
    message = lambda r: " ".join(x for x in (r["path"], r["subject"], r["detail"]) if x)
    errors = [{"code": r["code"], "message": message(r)} for r in rows if r["severity"] == "error"]
    return {"output_schema_version": 1, "result": "fail" if errors else "ok", "diagnostics": errors, "warnings": [{"code": r["code"], "message": message(r)} for r in rows if r["severity"] == "warning"], "examined": examined(mine)}


def validate_json(mine: Mine) -> str:
    return json.dumps(validate(mine), ensure_ascii=False)


def census(mine: Mine) -> dict[str, int]:
    """Truth files against index lines, and materials with a record of coverage against all that need one."""
    scanned, _ = register(mine, mine.paths["truths"], "coverage.md")
    rows = G.coverage_rows(scanned) if scanned is not None else []
    have = [(S.canon_id(m),) for _, m, _, _, fit in rows if m != "legacy" and fit]
    exempt = [S.canon_id(e) for _, m, e, _, _ in rows if m == "legacy"]
    covered = mine.spark.createDataFrame(have, "m string")
    live = mine.materials
    got = counts.coverage(live, "id", covered, "m", F.col("id").isin(*exempt) & F.coalesce(F.col("status") != "retracted", F.lit(True)) if exempt else F.lit(False)).first()
    text, _ = mine.text(mine.paths["truths"], "index.md")
    index = re.findall(r"(?m)^- (t\d+):", text or "")
    return {"truths": mine.family("truth").count(), "index": len(index), "covered": got.covered, "of": got.denominator, "exempt": got.exempt, **{f"intake_{r.bucket}": r.n for r in intake_split(mine).collect()}}


def intake_split(mine: Mine) -> DataFrame:
    """bucket, n: live materials by the last word of the intake ledger, all buckets."""
    last = ledgers.last_row_wins(mine.intake_rows()[0].where("id IS NOT NULL"), "id", "row_ord").select("id", "word")
    live = mine.materials.where("status IS NULL OR status <> 'retracted'").select("id").join(last, "id", "left")
    return counts.buckets(live, "word", ["declared", "anchored", "no-source", "legacy-unbound"], "undeclared")


def scope(mine: Mine) -> DataFrame:
    """family, id, evidence: every material and truth with its class.

    A truth that no ledger row names and that the Verified units section lists
    is legacy-unbound; a damaged row never falls back to that.
    """
    rows = mine.verify_rows()[0].where("id IS NOT NULL")
    units = mine.truths.select(F.lit("truth").alias("family"), "id", "digest").unionByName(mine.materials.select(F.lit("material").alias("family"), "id", F.col("copy_digest").alias("digest")))
    judged = ledgers.scope(units, "id", "digest", rows, "id", ["row_ord"], "word", "digest").select("family", "id", "evidence")
    scanned, _ = register(mine, mine.paths["truths"], "verify.md")
    roles = mine.roster("verify.sections")
    listed = G.verified_units(scanned, roles[0], tuple(roles[1:]))[0] if scanned is not None and roles else []
    spans = [(x[0], int(lo), int(hi or lo)) for x in listed for lo, hi in [(x.split("-")[0][1:], x.split("-")[1][1:] if "-" in x else "")] if len(lo) <= 15 and len(hi) <= 15]
    if not spans:
        return judged
    table = mine.lines_table(spans, "letter string, lo long, hi long")
    numbered = units.select(F.col("id").alias("old"), F.substring("id", 1, 1).alias("letter"), F.substring("id", 2, 100).alias("digits")).where(F.length("digits") <= 15)
    old = ids.in_ranges(numbered.withColumn("n", F.col("digits").cast("long")), "n", table, "lo", "hi", "letter").select("old").distinct()
    old = references.unresolved(old, "old", rows, "id").withColumn("legacy", F.lit(True))
    joined = judged.join(old, F.col("id") == F.col("old"), "left")
    return joined.select("family", "id", F.when(F.col("legacy") & (F.col("family") == "truth") & (F.col("evidence") == "unverified"), "legacy-unbound").otherwise(F.col("evidence")).alias("evidence"))


def scope_counts(mine: Mine) -> dict[tuple[str, str], int]:
    return {(r.family, r.evidence): r.n for r in scope(mine).groupBy("family", "evidence").agg(F.count("*").alias("n")).collect()}


def intake_staleness(mine: Mine) -> DataFrame:
    """id, source_stale, copy_stale: materials whose original or copy is no longer what was declared."""
    last = ledgers.last_row_wins(mine.intake_rows()[0].where("id IS NOT NULL"), "id", "row_ord").where("known")
    raw = counts.tree_digest(mine.family("raw").select(F.col("unit").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "digest"), "id", "name", "digest")
    now = mine.materials.select("id", F.col("copy_digest").alias("copy_now")).join(raw, "id", "left")
    bound = F.col("word").isin(*S.BINDING)
    joined = now.join(last.select("id", "word", "source_digest", "copy_digest"), "id")
    return joined.select("id", (bound & ~F.col("source_digest").eqNullSafe(F.col("tree_digest"))).alias("source_stale"), ((bound | (F.col("copy_digest") != "-")) & ~F.col("copy_digest").eqNullSafe(F.col("copy_now"))).alias("copy_stale"))


def labels(mine: Mine) -> DataFrame:
    """Truths with their labels."""
    sources = mine.materials.select(F.col("id").alias("source"), "stage", "status")
    joined = mine.truths.join(sources, "source", "left")
    text = R.label_text(F.col("stage"), F.col("fields")["as_of"], F.col("provenance"), F.coalesce(F.col("lists")["assumptions"], F.array()), F.coalesce(F.col("status") == "retracted", F.lit(False)))
    return joined.select("id", "claim", "source", "tags", "body", text.alias("label"))


def pull(mine: Mine, term: str) -> DataFrame:
    """Cards whose claim or tags hold the term; bodies are searched only if none does. Labels are not searched."""
    cards, needle = labels(mine), F.lit(term)
    return lookup.pull(cards, F.contains("claim", needle) | F.array_contains("tags", needle), F.contains("body", needle)).drop("lane").orderBy("id")


def impact(mine: Mine, material: str) -> dict[str, list[str]]:
    """What rests on a material: its truths, documents that name it, documents that cite its truths."""
    own = S.canon_id(material) or material
    truths = mine.truths.where(F.col("source") == own).select("id")
    title = (mine.materials.where(F.col("id") == own).select("title").first() or [None])[0]
    files = mine.cards.where(F.col("family").isin("plan", "draft", "final"))
    cited = mine.plans.select("doc", F.explode("cited").alias("raw")).select("doc", R.canon_id(F.col("raw")).alias("id"))
    listed = lambda df, c: [r[0] for r in df.select(c).distinct().orderBy(c).collect()]
    return {
        "truths": listed(truths, "id"),
        "by_id": listed(files.where(F.regexp_like("body", F.lit(rf"\b{own}\b"))), "unit"),
        "by_title": listed(files.where(F.contains("body", F.lit(title))), "unit") if title else [],
        "by_truths": listed(lookup.impact(mine.truths, "source", "id", cited, "id", "doc", own), "document"),
    }


def impact_all(mine: Mine) -> DataFrame:
    """material, way, unit: what rests on each material; the rows that impact() gives for one, for all at once."""
    files = mine.cards.where(F.col("family").isin("plan", "draft", "final"))
    cited = mine.plans.select("doc", F.explode("cited").alias("raw")).select("doc", R.canon_id(F.col("raw")).alias("cited"))
    return lookup.impact_all(mine.materials, "id", "title", mine.truths.select("source", F.col("id").alias("truth")), "source", "truth", cited, "cited", "doc", files, "unit", "body")


def gaps(mine: Mine, markers: str | None = None) -> dict[str, int]:
    """Lines that hold a marker, unchecked boxes, and accepted gaps, over converted texts and truths."""
    own = mine.config.get("gaps", {})
    pattern = markers or (own.get("markers") if isinstance(own, dict) else None) or "TBD|TODO|FIXME"
    re.compile(pattern)
    cards = mine.cards.where(F.col("family").isin("material", "truth")).select("body")
    tally = lookup.line_tally(cards, R.eol_lines(F.col("body")), markers=pattern, unchecked=r"^[ \t]*[-*] \[ \]")
    got = tally.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("markers", "unchecked"))).first()
    scanned, _ = register(mine, "gaps.md")
    names = mine.roster("gaps.sections")
    if not names:  # no tally by sections whose roles are unknown
        return {"markers": got.markers, "unchecked": got.unchecked, "accepted": None, "malformed": None, "open": None}
    found = _gap_register(mine, scanned) if scanned is not None else []
    accepted = [x for x in found if x[1] == names[1]]
    return {"markers": got.markers, "unchecked": got.unchecked, "accepted": sum(x[2] != "malformed" for x in accepted), "malformed": sum(x[2] == "malformed" for x in accepted), "open": sum(x[1] == names[0] and x[2] != "malformed" for x in found)}


def status_open(mine: Mine) -> list[tuple[str, str]]:
    """(lane, line) of everything that waits: conflicts, questions, queue, violations, gaps."""
    out: list[tuple[str, str]] = []
    text, read = mine.text("conflicts.json")
    try:
        out += [("conflict", f"{e['id']}: {e['candidates'][0]['claim']}") for e in S.read_conflicts(text or "")]
    except S.Refused as e:
        out.append(("conflict", f"unknown ({read}: {e.code})"))
    scanned, read = register(mine, "questions.md")
    if scanned is not None:
        out += [("question", f"[{s}] {t}") for _, s, t in G.questions(scanned) if s != "answered"]
    elif read == "unreadable":
        out.append(("question", "unknown (unreadable)"))
    scanned, _ = register(mine, mine.paths["truths"], "verify.md")
    if scanned is not None and (roles := mine.roster("verify.sections")):
        out += [("human-queue", f"[{o or 'untagged'}] {t}") for _, s, o, t in G.queue_items(scanned, roles[2]) if s == "open"]
    out += [("violation", f"{doc}: unknown (the review is {read})") for doc, read in unread_reviews(mine).items()]
    found = tables.gate(mine.family("review").select("unit", "body"), "unit", "body").where(F.col("code").isin("GATE-OPEN", "GATE-ZONE", "REVIEW-KIND-UNKNOWN"))
    out += [("violation", f"{r.unit}: line {r.line}") for r in found.orderBy("unit", "line").collect()]  # reviews are judged where they are read
    scanned, _ = register(mine, "gaps.md")
    names = mine.roster("gaps.sections")
    if not names:
        out.append(("gap", "unknown (the schema's sections don't hold)"))
    elif scanned is not None:
        out += [("gap", f"[{k}] {t}") for _, name, k, t in _gap_register(mine, scanned) if name == names[0]]
    return out


def status(mine: Mine) -> dict:
    """Documents by stage, materials, the queue by ownership, the completeness setting."""
    stage = mine.plans.select("doc", F.coalesce(F.col("fields")["status"], F.lit("")).alias("stage")).orderBy("doc").collect()
    scanned, _ = register(mine, mine.paths["truths"], "verify.md")
    roles = mine.roster("verify.sections")
    items = [x for x in G.queue_items(scanned, roles[2]) if x[1] == "open"] if scanned is not None and roles else []
    return {"documents": {r.doc: r.stage for r in stage}, "materials": mine.family("material").count(), "queue": {o: sum(x[2] == o for x in items) for o in (*G.OWNERSHIP, "")}, "completeness": _completeness(mine)}


VIEWS = ("index.md", "tree.md")


def view_lines(mine: Mine) -> dict[str, DataFrame]:
    """place, line of each generated view: one line for each card, and the cards under each of their tags."""
    shared = shared_dir(mine.spark)
    rows = labels(mine)
    label = F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.concat(F.lit(" ·· "), "label")).otherwise("")
    index = F.concat(F.lit("- "), "id", F.lit(": "), F.coalesce("claim", F.lit("None")), F.lit(" ["), F.coalesce("source", F.lit("None")), F.lit("] — ["), F.array_join("tags", ", "), F.lit("]"), label)
    members = ids.tag_tree(mine.truths, "id", "tags").join(rows.select(F.col("id").alias("member"), "claim"), "member")
    of = lambda part, line: F.struct(F.lit(part).alias("part"), line.alias("line"))
    heads = members.select("tag").distinct().select("tag", F.lit("").alias("member"), F.explode(F.array(of(0, F.concat(F.lit("## "), "tag")), of(1, F.lit("")), of(3, F.lit("")))).alias("x"))
    tree = heads.unionByName(members.select("tag", "member", of(2, F.concat(F.lit("- "), "member", F.lit(": "), F.coalesce("claim", F.lit("None")))).alias("x"))).select("tag", F.col("x.part").alias("part"), "member", F.col("x.line").alias("line"))
    return {
        "index.md": ids.places(rows.select("id", index.alias("line")), "place", ["id"], shared).select("place", "line"),
        "tree.md": ids.places(tree, "place", ["tag", "part", "member"], shared).select("place", "line"),
    }


def views(mine: Mine) -> tuple[str, str]:
    """The generated index and tag tree as texts, to be printed or written."""
    made = view_lines(mine)
    return tuple("".join(r.line + "\n" for r in made[name].orderBy("place").collect()) for name in VIEWS)


def view_scripts(mine: Mine) -> dict[str, DataFrame]:
    """For each view the edit script from the stored file to the generated lines; ends of lines may be either kind."""
    shared, out = shared_dir(mine.spark), {}
    for name, made in view_lines(mine).items():
        if mine.home.state(mine.paths["truths"], name) == "ok":
            found = lines.numbered_lines(mine.spark, mine.home.uri(mine.paths["truths"], name))
            stored = found.select(F.col("line_no").alias("place"), F.regexp_replace("line", r"\r\z", "").alias("line"))
        else:
            stored = made.where("false")
        out[name] = diff.edit_script(stored, made, "place", "line", shared)
    return out


def reindex_diff(mine: Mine) -> dict[str, list[str]]:
    """For each view the lines of the difference between the stored one and the generated one; none where they are equal."""
    order = ["kept_before", F.desc("change"), "place"]
    return {name: diff.normal_format(tuple(r) for r in script.orderBy(*order).toLocalIterator()) for name, script in view_scripts(mine).items()}


def reindex_check(mine: Mine) -> dict[str, int]:
    """For each view the number of lines by which the stored one differs."""
    return {name: script.count() for name, script in view_scripts(mine).items()}


def ghosts(mine: Mine) -> list[str]:
    """Ids in the ledgers that nothing on disk has."""
    units = mine.truths.select("id").unionByName(mine.materials.select("id"))
    seen = mine.verify_rows()[0].select("id").unionByName(mine.intake_rows()[0].select("id")).where("id IS NOT NULL")
    return [r[0] for r in ledgers.ghosts(seen, "id", units, "id").orderBy("id").collect()]


def conflict_list(mine: Mine) -> list[tuple[str, list[str], list[str]]]:
    """(id, targets, claims) of the open conflicts."""
    text, read = mine.text("conflicts.json")
    if text is None:
        raise S.Refused("STATE-MISSING", read)
    return [(e["id"], e["targets"], [c["claim"] for c in e["candidates"]]) for e in S.read_conflicts(text)]


def quotations(mine: Mine) -> DataFrame:
    """All quotations of converted texts with their state."""
    from ..operators import quotes

    return quotes.judged(quotes.quote_spans(mine.materials), quotes.raw_sources(mine.files, mine.paths["materials"]), raw_states(mine))


def raw_checks(mine: Mine) -> list[DataFrame]:
    """Materials whose sources are links or aliases, can't be read, or changed while they were read."""
    states = raw_states(mine)
    if states is None:
        return []
    odd = states.where("code IS NOT NULL").withColumn("path", F.concat(F.lit(mine.paths["materials"] + "/"), "unit"))
    return [_diag(odd, F.col("code"), "unit", F.array_join(F.transform("rejected", lambda r: F.concat(r["name"], F.lit(": "), r["reason"])), ", "))]


def raw_states(mine: Mine) -> DataFrame | None:
    """The state of each material's raw sources; nothing for a mine given by a URI, where links are not told apart."""
    if "://" in mine.root:
        return None
    return read_raw_sources(mine.materials.select("id"), "id", mine.place(mine.paths["materials"]))


def fingerprint() -> str:
    """A digest over this package's own files."""
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    rows = sorted((str(p.relative_to(home)), hashlib.sha256(p.read_bytes()).hexdigest()) for p in home.rglob("*.py") if "llm" not in p.relative_to(home).parts)
    return hashlib.sha256("".join(f"{n}\0{d}\n" for n, d in rows).encode()).hexdigest()
