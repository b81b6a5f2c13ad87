"""The human registers: queue, questions, gaps, and the fidelity gate of a review."""

from __future__ import annotations

import re

from .markdown import BULLET, Scan, entries, is_noise, scan, section, slot

OWNERSHIP = ("user-only", "recommended", "machine")
QUEUE_STATES = ("open", "ruled")
QUESTION_STATES = ("open", "proposed", "answered")
GAP_KINDS = ("declared", "reference", "enumeration", "symmetry")
VIOLATIONS = ("contradiction", "unsupported", "missing-required")
GATE, ADJUDICATIONS, QUEUE = "Fidelity violations", "Adjudications", "Human queue"
REVIEW_SECTIONS = (GATE, "Findings", ADJUDICATIONS, QUEUE)
OPEN_GAPS, ACCEPTED_GAPS = "Open", "Accepted"
INVISIBLE = re.compile("[​‌‍⁠﻿]")
UNENDED = {"unterminated-frontmatter": "FRONTMATTER", "unterminated-fence": "FENCE", "unterminated-comment": "COMMENT"}


def queue_items(scanned: Scan, title: str = QUEUE) -> list[tuple[int, str, str, str]]:
    """(line, state, ownership, text) of every entry of every Human queue section; ownership is empty without a valid tag."""
    out = []
    for own in section(scanned, title):
        for e in entries(own, [QUEUE_STATES, OWNERSHIP])[0]:
            if e.words[0][0] == "known":
                tag = e.words[1][1] if len(e.words) > 1 and e.words[1][0] == "known" else ""
                out.append((e.number, e.words[0][1], tag, e.text or " ".join(e.folded)))
    return out


def questions(scanned: Scan) -> list[tuple[int, str, str]]:
    """(line, state, text) of all questions; state is 'unrecognised' for entries without a known one."""
    out = []
    for line in scanned.lines:
        m = BULLET.match(line.live) if line.context == "text" else None
        if not m or m[2].strip() == "(none)" or is_noise(m[2]):
            continue
        if m[1]:
            if m[2].startswith("["):
                out.append((line.number, "unrecognised", m[2]))
            continue
        state, word, rest = slot(m[2], QUESTION_STATES)
        out.append((line.number, word if state == "known" else "unrecognised", rest.strip()))
    return out


def gap_register(scanned: Scan, kinds: tuple[str, ...] = GAP_KINDS, names: tuple[str, str] = (OPEN_GAPS, ACCEPTED_GAPS)) -> list[tuple[int, str, str, str]]:
    """(line, section, kind, text): kind is 'malformed' for an entry without exactly one, section is 'outside' beyond both."""
    out, inside = [], set()
    if scanned.problems:
        out.append((scanned.problems[0][0], "outside", "malformed", scanned.problems[0][1]))
    for name in names:
        found = section(scanned, name, siblings=names)
        if len(found) != 1:
            out.append((0, name, "malformed", "section missing" if not found else "section repeated"))
        for own in found:
            inside.update(x.number for x in own)
            listed, stray = entries(own, [kinds], blank_ends=True)
            for e in listed:
                state, word = e.words[0]
                second = slot(e.text, kinds)[0] == "known"
                out.append((e.number, name, word if state == "known" and not second else "malformed", e.text))
            out += [(x.number, name, "malformed", x.live.strip()) for x in stray if not x.level]
    for line in scanned.lines:
        m = BULLET.match(line.live) if line.context == "text" else None
        if m and line.number not in inside and slot(m[2], kinds)[0] == "known":
            out.append((line.number, "outside", "malformed", m[2]))
    return out


def spelled(text: str) -> list[str]:
    """Violation kinds that stand in brackets, closed or not, however they are spelt."""
    plain = INVISIBLE.sub("", text).lower()
    found = []
    for m in re.finditer(r"\[([^\[\]]*)(\]?)", plain):
        inner = re.sub(r"[\s_-]+", "-", m[1].strip())
        found += [k for k in VIOLATIONS if (inner == k if m[2] else inner.startswith(k))]
    return found


#: An entry, heading or plain line that begins with a slot of which neither template text nor nothing is made.
WORDED = re.compile(r"^(?:[-*+>|#]|\d+[.)]|\s)*\[([^\[\]{}<>]*[^\s\[\]{}<>][^\[\]{}<>]*)\]")


def _ends_of_gates(scanned: Scan) -> dict[int, str]:
    """Line and code of headings that end a gate section and hold a slot: they were met while the gate was open."""
    out, level = {}, 0
    for line in scanned.lines:
        if not line.level:
            continue
        if line.title == GATE:
            level = line.level
        elif level and (line.level <= level or line.title in REVIEW_SECTIONS):
            if line.title not in REVIEW_SECTIONS:
                if WORDED.match(line.title) and not spelled(line.title):
                    out[line.number] = "REVIEW-KIND-UNKNOWN"
                elif spelled(line.title) or re.match(r"^\[[^\[\]]*\]", line.title):
                    out[line.number] = "GATE-OPEN"
            level = 0
    return out


def gate_findings(text: str) -> list[tuple[int, str]]:
    """(line, code) of all that keeps a review's gate from passing.

    In the gate section any entry blocks, whatever its shape, and so does a
    bracketed slot that is not template text; one with a word that is no kind is
    named as such. The heading that ends the section is still judged by it.
    Outside, a bracketed violation kind blocks. Comments archive entries if their
    end is the end of the line.
    """
    scanned = scan(text)
    out = [(n, f"REVIEW-UNTERMINATED-{UNENDED[p]}" if p in UNENDED else "GATE-COMMENT") for n, p in scanned.problems]
    gates = section(scanned, GATE, siblings=REVIEW_SECTIONS)
    if len(gates) != 1:
        out.append((0, "GATE-MISSING" if not gates else "GATE-DUPLICATE"))
    inside = {x.number for own in gates for x in own}
    ends = _ends_of_gates(scanned)
    for line in scanned.lines:
        live = line.raw if line.context in ("fence", "frontmatter") else line.live
        bare = live.strip()
        if not bare or line.context == "comment":
            continue
        if line.number in ends:
            out.append((line.number, ends[line.number]))
            continue
        if line.number in inside and line.context in ("text", "fence"):
            shape = re.match(r"^(?:[-*+>|]|\d+[.)]|\*\*|__|\[)", bare)
            if line.level:
                if spelled(line.title):
                    out.append((line.number, "GATE-OPEN"))
                elif WORDED.match(line.title):
                    out.append((line.number, "REVIEW-KIND-UNKNOWN"))
            elif spelled(bare) or (shape and not is_noise(re.sub(r"^(?:[-*+>|]|\d+[.)])+\s*", "", bare)) and not re.fullmatch(r"[|:\-\s]+|```.*|~~~.*", bare) and bare not in ("(none)", "- (none)")):
                out.append((line.number, "REVIEW-KIND-UNKNOWN" if WORDED.match(bare) and not spelled(bare) else "GATE-OPEN"))
        elif spelled(live):
            out.append((line.number, "GATE-ZONE"))
    return out


COVERAGE_HEAD = re.compile(r"^(m\d+|legacy)$")
COVERAGE_ROW = re.compile(r"^[-*] (.+?)[ \t]*:[ \t]*(.*)$")


def coverage_rows(scanned: Scan) -> list[tuple[int, str, str, list[str], bool]]:
    """(line, material, element, truth ids, well formed) of the coverage register; 'legacy' lists exempt materials."""
    out, material = [], ""
    for line in scanned.lines:
        if line.level:
            material = line.title if COVERAGE_HEAD.match(line.title) else ""
        elif line.context == "text" and line.live.strip() and material:
            m = COVERAGE_ROW.match(line.live)
            if material == "legacy":
                for ref in re.findall(r"\bm\d+\b", line.live):
                    out.append((line.number, "legacy", ref, [], True))
            elif m:
                out.append((line.number, material, m[1], re.findall(r"\bt\d+\b", m[2]), bool(m[2].strip())))
            elif BULLET.match(line.live):
                out.append((line.number, material, line.live.strip(), [], False))
    return out


def verified_units(scanned: Scan, title: str = "Verified units", siblings: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(ids whose entry ends in the marker, entries that cover nothing); ranges are written t003-t004. A sibling section ends this one at any depth."""
    ids: list[str] = []
    prose: list[str] = []
    for own in section(scanned, title, levels=range(1, 3), siblings=siblings):
        for line in own:
            if line.context != "text" or not line.live.strip() or line.level:
                continue
            bare = line.live.strip().strip("|").strip()
            tokens = re.split(r"[\s|]+", bare)
            if tokens[-1] == "verified" and re.match(r"^(?:[-*+]\s+)?[tm]\d+", bare):
                ids += re.findall(r"\b[tm]\d+(?:-[tm]\d+)?\b", bare)
            else:
                prose.append(bare)
    return ids, prose
