"""One lexical pass over a Markdown file: frontmatter, fences, comments, headings, sections, entries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .cards import FENCE, lines_of

OPENER = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
SLOT = re.compile(r"^\[([^\]]*)\]")
BULLET = re.compile(r"^([ \t]*)(?:[-*+]|\d+[.)])[ \t]+(.*)$")


@dataclass
class Line:
    """live is the line with commented characters masked by spaces; context: frontmatter, fence, comment or text."""

    number: int
    raw: str
    live: str
    context: str
    level: int = 0
    title: str = ""


@dataclass
class Scan:
    lines: list[Line] = field(default_factory=list)
    #: unterminated-frontmatter, unterminated-fence, unterminated-comment, comment-suffix
    problems: list[tuple[int, str]] = field(default_factory=list)


def scan(text: str) -> Scan:
    """All lines with their contexts, which exclude each other; what is masked makes no heading, fence or bullet."""
    out = Scan()
    lines = lines_of(text)
    front = bool(lines) and bool(FENCE.match(lines[0]))
    fence, comment, since = "", False, 0
    for i, raw in enumerate(lines):
        number = i + 1
        if front:
            out.lines.append(Line(number, raw, "", "frontmatter"))
            if i and FENCE.match(raw):
                front = False
            continue
        if fence:
            out.lines.append(Line(number, raw, "", "fence"))
            m = OPENER.match(raw)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        was, live, at, swallowed = comment, "", 0, False
        while at < len(raw):
            if comment:
                end = raw.find("-->", at)
                stop = len(raw) if end < 0 else end + 3
                live += " " * (stop - at)
                swallowed = True
                if end >= 0:
                    comment = False
                    if raw[stop:].strip():
                        out.problems.append((number, "comment-suffix"))
                at = stop
            else:
                start = raw.find("<!--", at)
                stop = len(raw) if start < 0 else start
                if not swallowed and not was and at == 0 and OPENER.match(raw) and (start < 0 or start > OPENER.match(raw).start(1)):
                    live, start, stop = raw, -1, len(raw)
                else:
                    live += raw[at:stop]
                if start >= 0:
                    comment, since = True, number
                at = stop
        m = OPENER.match(live) if not was and not swallowed else None
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, since = m[1], number
            out.lines.append(Line(number, raw, "", "fence"))
            continue
        line = Line(number, raw, live, "comment" if (was or swallowed) and not live.strip() else "text")
        h = HEADING.match(live) if not was else None
        if h and not live.startswith(" " * 4):
            line.level, line.title = len(h[1]), (h[2] or "").strip()
        out.lines.append(line)
    for open_, what in ((front, "unterminated-frontmatter"), (fence, "unterminated-fence"), (comment, "unterminated-comment")):
        if open_:
            out.problems.append((since or 1, what))
    return out


def section(scanned: Scan, title: str, levels: range = range(1, 7), siblings: tuple[str, ...] = ()) -> list[list[Line]]:
    """The lines of each section with exactly that title, up to a heading of its level or above, or a known sibling at any depth."""
    out: list[list[Line]] = []
    level = 0
    for line in scanned.lines:
        if line.level:
            if line.title == title and line.level in levels:
                out.append([])
                level = line.level
                continue
            if level and (line.level <= level or line.title in siblings):
                level = 0
        if level:
            out[-1].append(line)
    return out


def slot(text: str, known: tuple[str, ...]) -> tuple[str, str, str]:
    """(state, word, rest) of the bracketed slot that a text begins with."""
    if not text.startswith("["):
        return "missing", "", text
    m = SLOT.match(text)
    if not m:
        return "unclosed", "", text
    word, rest = m[1], text[m.end() :].lstrip(" \t\v\f\r")
    if not word.strip():
        return "blank", "", rest
    if re.fullmatch(r"\{[^{}]*\}", word):
        return "placeholder", word, rest
    return ("known" if word in known else "unknown"), word, rest


def is_noise(text: str) -> bool:
    """Whether a line is template text: brace groups and empty slots throughout."""
    return bool(text.strip()) and not re.sub(r"\[\{[^{}]*\}\]|\{[^{}]*\}|\[\]|[-*+:,;—|\s]", "", text)


@dataclass
class Entry:
    number: int
    words: list[tuple[str, str]]  # (slot state, word)
    text: str
    folded: list[str] = field(default_factory=list)


def entries(lines: list[Line], vocabularies: list[tuple[str, ...]], nested: bool = True, blank_ends: bool = False) -> tuple[list[Entry], list[Line]]:
    """Bulleted entries with the lines they own, and the lines that belong to none.

    With ``nested``, only a strictly deeper bullet is detail of an entry. With
    ``blank_ends``, a blank line closes an entry and entries start at column 0.
    """
    out: list[Entry] = []
    stray: list[Line] = []
    lead: int | None = None
    for line in lines:
        live = line.live
        if line.context != "text" or not live.strip():
            if blank_ends and line.context == "text":
                lead = None
            continue
        m = BULLET.match(live)
        if m and not (lead is not None and nested and len(m[1].expandtabs(4)) > lead) and not (blank_ends and m[1]):
            if is_noise(m[2]):
                lead = None
                continue
            words, rest = [], m[2]
            for known in vocabularies:
                state, word, rest = slot(rest, known)
                words.append((state, word))
                if state in ("missing", "unclosed"):
                    break
            lead = len(m[1].expandtabs(4))
            out.append(Entry(line.number, words, rest.strip()))
        elif lead is not None and live[:1] in " \t":
            out[-1].folded.append(live.strip())
        elif line.level:
            lead = None
        else:
            stray.append(line)
    return out, stray
