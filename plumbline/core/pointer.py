"""A marked region of a file that should equal a template, line ends aside. A warning at most."""

from __future__ import annotations

#: The file that points into a mine, the block that it should hold, and the markers of the block.
POINTER = "CLAUDE.md"
TEMPLATE = "templates/claude-block.md"
BEGIN, END = "<!-- mine:begin -->", "<!-- mine:end -->"


def block_state(text: str | None, template: str | None, begin: str, end: str) -> str:
    """none, ok, stale, many, broken (a marker without its partner), or no-template."""
    if text is None:
        return "none"
    text = text.replace("\r\n", "\n")
    starts, ends = text.count(begin), text.count(end)
    if not starts and not ends:
        return "none"
    if starts != ends or text.find(end) < text.find(begin):
        return "broken"
    if starts > 1:
        return "many"
    if template is None:
        return "no-template"
    own = text[text.find(begin) : text.find(end) + len(end)]
    return "ok" if own.strip() == template.replace("\r\n", "\n").strip() else "stale"
