"""State files and ledgers as text: strict grammars, named refusals, one canonical spelling."""

from __future__ import annotations

import json
import re
from datetime import date

HEX64 = re.compile(r"^[0-9a-f]{64}$")
CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
NAMESPACES = ("conflict", "material", "truth")
COUNTER_DIGITS = 15
VERDICTS = ("verified", "failed", "legacy-unbound")
DECLARATIONS = ("declared", "anchored", "no-source", "legacy-unbound")
#: Declarations that bind bytes.
BINDING = ("declared", "anchored")


def canon_id(text: str) -> str | None:
    """The one spelling of a lenient id, or nothing."""
    m = re.fullmatch(r"([tmc])0*(\d+)", text)
    return m[1] + m[2].rjust(3, "0") if m else None


def is_day(text: str) -> bool:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text, re.ASCII):
        return False
    try:
        date.fromisoformat(text)
    except ValueError:
        return False
    return True


def ledger_rows(text: str, columns: int) -> tuple[list[tuple[int, list[str], bool]], str]:
    """(rows, state): rows have their number, their fields and whether the grammar holds; state: ok, torn or headless.

    Fields are split at every TAB. A row without an id voids the whole ledger,
    and so does a last line without its end.
    """
    rows, state = [], "ok"
    if text and not text.endswith("\n"):
        state = "torn"
    for i, line in enumerate(text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")):
        line = line[:-1] if line.endswith("\r") else line
        if line.startswith("#") or line == "":
            continue
        fields = line.split("\t")
        if not fields[0].strip():
            state = "headless"
        rows.append((i + 1, fields, len(fields) == columns and not any(CONTROL.search(f) for f in fields)))
    return rows, state


def verify_row_ok(fields: list[str], fit: bool) -> bool:
    """id, digest, verdict, round, standard, date."""
    return fit and canon_id(fields[0]) is not None and (fields[1] == "-" or bool(HEX64.match(fields[1]))) and bool(re.fullmatch(r"\d+|-", fields[3])) and is_day(fields[5])


def intake_row_ok(fields: list[str], fit: bool) -> bool:
    """id, source digest, word, source count, copy digest, note, date; a binding word needs both digests and a count."""
    if not fit or canon_id(fields[0]) is None or fields[0][0] != "m" or not is_day(fields[6]):
        return False
    digests = [bool(HEX64.match(fields[1])), bool(HEX64.match(fields[4]))]
    if fields[2] in BINDING:
        return all(digests) and bool(re.fullmatch(r"[1-9]\d*", fields[3]))
    return all(ok or f == "-" for ok, f in zip(digests, (fields[1], fields[4])))


#: Versions that are judged.
SUPPORTED = (3,)


def negotiate(project: str, config: str) -> tuple[int | None, str, str]:
    """(version, code, reason) from what the project and the configuration say; no side wins where they differ."""
    for own in (project, config):
        if own == "":
            return None, "VERSION-MISMATCH", "missing"
        if not re.fullmatch(r"\d+", own, re.ASCII):
            return None, "VERSION-MISMATCH", "not-integer"
    if int(project) != int(config):
        return None, "VERSION-MISMATCH", "disagree"
    version = int(project)
    if version > max(SUPPORTED):
        return None, "VERSION-MISMATCH", "future"
    if version < min(SUPPORTED):  # each has its own way up
        return None, "VERSION-BELOW-FLOOR", "upgrade" if version == min(SUPPORTED) - 1 else "bridge"
    return version, "", ""


class Refused(ValueError):
    """A state file or a change to it that its contract does not allow; code names the rule."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code} {detail}".strip())
        self.code = code


def _object(text: str, code: str):
    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        return json.loads(text, object_pairs_hook=unique)
    except ValueError as e:
        raise Refused(code, str(e)) from None


CANDIDATE = {"claim": str, "source": str, "location": str, "quote": str, "tags": list, "note": str}


def check_entry(entry, with_id: bool = True) -> dict:
    """A conflict entry that fits the contract."""
    if not isinstance(entry, dict):
        raise Refused("CONF-SHAPE", "an entry is no object")
    if unknown := set(entry) - {"id", "targets", "candidates", "created", "note"}:
        raise Refused("CONF-KEY-UNKNOWN", sorted(unknown)[0])
    if with_id and (not isinstance(entry.get("id"), str) or canon_id(entry["id"]) != entry["id"] or entry["id"][0] != "c"):
        raise Refused("CONF-ID", str(entry.get("id")))
    targets = entry.get("targets")
    if not isinstance(targets, list) or any(not isinstance(t, str) or canon_id(t) != t or t[0] != "t" for t in targets) or len(targets) != len(set(targets)):
        raise Refused("CONF-TARGET", str(targets))
    if not isinstance(entry.get("created"), str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", entry["created"]):
        raise Refused("CONF-CREATED", str(entry.get("created")))
    if "note" in entry and (not isinstance(entry["note"], str) or not entry["note"]):
        raise Refused("CONF-NOTE")
    candidates = entry.get("candidates")
    if not isinstance(candidates, list) or not candidates:
        raise Refused("CONF-CANDIDATE", "none")
    for c in candidates:
        if not isinstance(c, dict) or not {"claim", "source"} <= set(c):
            raise Refused("CONF-CANDIDATE", "claim and source are required")
        if unknown := set(c) - set(CANDIDATE):
            raise Refused("CONF-KEY-UNKNOWN", sorted(unknown)[0])
        if any(not isinstance(c[k], kind) or not c[k] for k, kind in CANDIDATE.items() if k in c) or any(not isinstance(t, str) for t in c.get("tags", [])):
            raise Refused("CONF-CANDIDATE", "a member has the wrong type")
        if canon_id(c["source"]) != c["source"] or c["source"][0] != "m":
            raise Refused("CONF-CANDIDATE", c["source"])
    return entry


def read_conflicts(text: str) -> list[dict]:
    """The open entries of a conflict store."""
    store = _object(text, "CONF-JSON")
    if not isinstance(store, dict) or store.get("version") != 1 or not isinstance(store.get("open"), list):
        raise Refused("CONF-SHAPE")
    if unknown := set(store) - {"version", "open"}:
        raise Refused("CONF-KEY-UNKNOWN", sorted(unknown)[0])
    found = [check_entry(e) for e in store["open"]]
    if len({e["id"] for e in found}) != len(found):
        raise Refused("CONF-DUP")
    return found


def write_conflicts(entries: list[dict]) -> str:
    """The canonical spelling: fixed key order, absent members left out, entries by number, a final line feed."""
    order = lambda c: {k: c[k] for k in CANDIDATE if k in c}
    listed = [
        {"id": e["id"], "targets": e["targets"], "candidates": [order(c) for c in e["candidates"]], "created": e["created"], **({"note": e["note"]} if "note" in e else {})}
        for e in sorted(entries, key=lambda e: (len(e["id"]), e["id"]))
    ]
    return json.dumps({"version": 1, "open": listed}, ensure_ascii=False, indent=2) + "\n"


def read_sequences(text: str) -> dict[str, int]:
    """The next number of each namespace."""
    store = _object(text, "IDSEQ-JSON")
    if not isinstance(store, dict) or store.get("version") != 1 or set(store) != {"version", "next"} or not isinstance(store["next"], dict):
        raise Refused("IDSEQ-SHAPE")
    if set(store["next"]) != set(NAMESPACES):
        raise Refused("IDSEQ-NAMESPACE", ", ".join(sorted(store["next"])))
    for name, n in store["next"].items():
        if not isinstance(n, int) or isinstance(n, bool) or n < 1 or len(str(n)) > COUNTER_DIGITS:
            raise Refused("IDSEQ-COUNTER", name)
    return store["next"]


def write_sequences(counters: dict[str, int]) -> str:
    return json.dumps({"version": 1, "next": {n: counters[n] for n in NAMESPACES}}, indent=2) + "\n"


def grant(counters: dict[str, int], namespace: str) -> tuple[str, dict[str, int]]:
    """(the granted id, the counters after); ids are never granted again."""
    if namespace not in counters:
        raise Refused("IDSEQ-NAMESPACE", namespace)
    n = counters[namespace]
    return namespace[0] + str(n).rjust(3, "0"), counters | {namespace: n + 1}


def contract(text: str) -> dict[str, list[str]]:
    """A schema file's lists: one trailing delimiter adds no member; a list with an empty or repeated member is none."""
    out: dict[str, list[str]] = {}
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.strip() and not line.startswith("#") and ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            members = [m.strip() for m in value.split("|")]
            if len(members) > 1 and members[-1] == "":
                members.pop()
            out[key] = members if all(members) and len(set(members)) == len(members) else []
    return out


#: The lists of a schema file that are read, as they are where a mine brings no file. Fixed values of the format.
CONTRACT = {
    "verify.sections": ["Verified units", "Adjudications", "Human queue"],
    "gaps.sections": ["Open", "Accepted"],
    "gaps.enum.kind": ["declared", "reference", "enumeration", "symmetry"],
}


def read_contract(text: str | None, read: str) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """(lists, findings as code and key). A list that doesn't hold is empty, so nothing is judged by a shifted role.

    Roles are positions: verify.sections has three, gaps.sections two members, all different.
    """
    if text is None and read == "absent":
        return dict(CONTRACT), []
    lists = contract(text or "")
    out, findings = {}, []
    for key, usual in CONTRACT.items():
        own = lists.get(key, [])
        fit = bool(own) if key == "gaps.enum.kind" else len(own) == len(usual)
        out[key] = own if fit else []
        if not fit:
            findings.append(("SCHEMA-VERIFY-SECTIONS" if key == "verify.sections" and text is not None else "SCHEMA-UNREADABLE", key))
    if not out["gaps.sections"] or not out["gaps.enum.kind"]:
        out["gaps.sections"] = []
    return out, findings
