"""Quote markers: a comment that says where the quotation below it comes from, and the quotation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .markdown import scan

# Fixed values of the file format.
KEYWORD = "wd:quote"
ATTRIBUTES = ("source", "mode", "file", "location")
MODES = ("verbatim", "not-checkable")
STATES = ("sealed", "mismatch", "empty", "unmarked", "malformed-marker", "unsupported-structure", "source-unavailable", "unresolved", "binary-cold-debt")

COMMENT = re.compile(r"^\s*<!--\s*" + re.escape(KEYWORD) + r"(?=[\s-])(.*?)-->\s*$")
PAIR = re.compile(r'([a-z]+)=("[^"]*"|[^\s"]*)')
QUOTED = re.compile(r"^ {0,3}>")
NESTED = re.compile(r"^ {0,3}>[ \t]?\s*(?:>|[-*+] |\d+[.)] )|^\s*(?:[-*+]|\d+[.)])\s+>")
#: What ends a quotation besides a blank line: a heading, a list, a fence, a rule, a comment.
BOUNDARY = re.compile(r"^ {0,3}(?:#{1,6}(?:[ \t]|$)|[-*+](?:[ \t]|$)|\d+[.)](?:[ \t]|$)|`{3}|~{3}|(?:[-*_][ \t]*){3,}$|<!--)")
#: Structure that hides all that follows it.
UNENDED = {"unterminated-fence": "QUOTE-UNTERMINATED-FENCE", "unterminated-comment": "QUOTE-UNTERMINATED-COMMENT"}


@dataclass
class Marker:
    attrs: dict[str, str] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


@dataclass
class Span:
    """A quotation with its marker. state is set where the text alone decides it; start and end are characters of the file."""

    line: int
    start: int
    end: int
    text: str
    attrs: dict[str, str]
    state: str = ""
    codes: list[str] = field(default_factory=list)


def read_marker(text: str) -> Marker | None:
    """The marker that a line is, if it is one; whatever is not recognised is an error."""
    m = COMMENT.match(text)
    if not m:
        return None
    out, rest = Marker(), m[1].strip()
    at = 0
    while at < len(rest):
        p = PAIR.match(rest, at)
        if not p:
            out.errors.append("QUOTE-MARKER-SYNTAX")
            break
        key, value = p[1], p[2].strip('"')
        if key not in ATTRIBUTES:
            out.errors.append("QUOTE-ATTRIBUTE-UNKNOWN")
        elif key in out.attrs:
            out.errors.append("QUOTE-ATTRIBUTE-REPEATED")
        elif not value:
            out.errors.append("QUOTE-ATTRIBUTE-EMPTY")
        out.attrs[key] = value
        at = p.end()
        while at < len(rest) and rest[at].isspace():
            at += 1
    out.attrs.setdefault("mode", "verbatim")
    source = out.attrs.get("source", "")
    if re.fullmatch(r"t\d+", source):
        out.errors.append("QUOTE-SOURCE-TRUTH")
    elif source != "self" and not re.fullmatch(r"m\d+", source):
        out.errors.append("QUOTE-SOURCE")
    if out.attrs["mode"] not in MODES:
        out.errors.append("QUOTE-MODE")
    if out.attrs["mode"] == "not-checkable":
        out.errors += ["QUOTE-LOCATION-REQUIRED"] * ("location" not in out.attrs) + ["QUOTE-FILE-REQUIRED"] * ("file" not in out.attrs)
    return out


def spans(text: str) -> list[Span]:
    """All quotations of a text outside fences, marked or not, and markers without one.

    Quotations inside lists or other quotations are not supported, nor are those
    that the next line goes on without a mark of its own, and fences and comments
    that never end; nothing in a file that has one is judged.
    """
    scanned = scan(text)
    lines = scanned.lines
    offsets, at = [], 0
    for raw in text.split("\n"):
        offsets.append(at)
        at += len(raw) + 1
    out: list[Span] = []
    marker: Marker | None = None
    marked = 0
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.context in ("fence", "frontmatter"):
            i += 1
            continue
        found = read_marker(line.raw)
        if found:
            if marker:
                out.append(Span(marked, offsets[marked - 1], offsets[marked - 1] + len(lines[marked - 1].raw), "", marker.attrs, "empty", ["QUOTE-MARKER-ORPHAN"]))
            marker, marked = found, line.number
        elif NESTED.match(line.live):
            out.append(Span(line.number, offsets[i], offsets[i] + len(line.raw), line.raw, {}, "unsupported-structure", ["QUOTE-STRUCTURE-UNSUPPORTED"]))
            marker = None
        elif QUOTED.match(line.live):
            first, parts = i, []
            while i < len(lines) and lines[i].context == "text" and QUOTED.match(lines[i].live):
                parts.append(re.sub(r"^ {0,3}>[ \t]?", "", lines[i].raw))
                i += 1
            span = Span(lines[first].number, offsets[first], offsets[i - 1] + len(lines[i - 1].raw), "\n".join(parts), marker.attrs if marker else {})
            if not marker:
                span.state, span.codes = "unmarked", ["QUOTE-UNMARKED"]
            elif marker.errors:
                span.state, span.codes = "malformed-marker", sorted(set(marker.errors))
            elif not span.text.strip():
                span.state, span.codes = "empty", ["QUOTE-EMPTY"]
            lazy = i
            while i < len(lines) and lines[i].context == "text" and lines[i].live.strip() and not (BOUNDARY.match(lines[i].live) or read_marker(lines[i].raw)):
                i += 1
            if i > lazy:  # a reader sees these lines in the quotation
                span.state, span.codes = "unsupported-structure", ["QUOTE-LAZY-CONTINUATION"]
                span.end = offsets[i - 1] + len(lines[i - 1].raw)
            out.append(span)
            marker = None
            continue
        elif line.live.strip() and marker:
            out.append(Span(marked, offsets[marked - 1], offsets[marked - 1] + len(lines[marked - 1].raw), "", marker.attrs, "empty", ["QUOTE-MARKER-ORPHAN"]))
            marker = None
        i += 1
    if marker:
        out.append(Span(marked, offsets[marked - 1], offsets[marked - 1] + len(lines[marked - 1].raw), "", marker.attrs, "empty", ["QUOTE-MARKER-ORPHAN"]))
    for number, problem in scanned.problems:
        if problem in UNENDED and number <= len(lines):
            out.append(Span(number, offsets[number - 1], len(text), "", {}, "unsupported-structure", [UNENDED[problem]]))
    if any(s.state == "unsupported-structure" for s in out):
        for s in out:
            if not s.state:
                s.state, s.codes = "unsupported-structure", ["QUOTE-FILE-STRUCTURE-UNSUPPORTED"]
    return out
