"""Files with frontmatter: cards, converted texts, plans, reviews."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FENCE = re.compile(r"^---[ \t]*$")
KEY = re.compile(r"^([A-Za-z_][A-Za-z0-9_-]*)[ \t]*:(?:[ \t]*(.*))?$")
PLACEHOLDER = re.compile(r"^\{[^{}]*\}$")


@dataclass
class Card:
    """state: ok, missing (no frontmatter) or unclosed. Values are as written, unquoted; lists are parsed apart."""

    state: str = "missing"
    fields: dict[str, str] = field(default_factory=dict)
    lists: dict[str, list[str]] = field(default_factory=dict)
    duplicates: list[str] = field(default_factory=list)
    unclosed_lists: list[str] = field(default_factory=list)
    body: str = ""


def lines_of(text: str) -> list[str]:
    """Lines without their ends; one CR before a line feed is part of the end."""
    return [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]


def without_comment(value: str) -> str:
    """A value without the comment that a # after white space begins outside quotes."""
    quote = ""
    for i, c in enumerate(value):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or value[i - 1] in " \t"):
            return value[:i].rstrip()
    return value.rstrip()


def unquoted(value: str) -> str:
    value = value.strip(" \t")
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def flow_list(value: str) -> list[str] | None:
    """The members of a flow list, or nothing if it is not closed."""
    if not value.endswith("]"):
        return None
    out, part, quote = [], "", ""
    for c in value[1:-1]:
        if quote:
            quote = "" if c == quote else quote
            part += c
        elif c in "\"'":
            quote = c
            part += c
        elif c == ",":
            out.append(unquoted(part))
            part = ""
        else:
            part += c
    out.append(unquoted(part))
    return [x for x in out if x]


def read_card(text: str) -> Card:
    """The card that a file holds."""
    lines = lines_of(text)
    if not lines or not FENCE.match(lines[0]):
        return Card(body=text)
    end = next((i for i in range(1, len(lines)) if FENCE.match(lines[i])), None)
    card = Card("ok" if end else "unclosed")
    for line in lines[1 : end or len(lines)]:
        m = KEY.match(line)
        if not m:
            continue
        key, value = m[1], without_comment(m[2] or "")
        if key in card.fields:
            card.duplicates.append(key)
            continue
        card.fields[key] = unquoted(value)
        if value.startswith("["):
            members = flow_list(value)
            if members is None:
                card.unclosed_lists.append(key)
            else:
                card.lists[key] = members
    card.body = "\n".join(lines[end + 1 :]) if end else ""
    return card


def set_list(text: str, key: str, change) -> str:
    """The text with change() applied to a closed list field of its frontmatter; every other byte stays."""
    lines = text.split("\n")
    if not lines or not FENCE.match(lines[0].rstrip("\r")):
        return text
    for i in range(1, len(lines)):
        bare = lines[i].rstrip("\r")
        if FENCE.match(bare):
            break
        m = re.match(rf"^({re.escape(key)}[ \t]*:[ \t]*)(\[.*)$", bare)
        if m:
            value = without_comment(m[2])
            members = flow_list(value)
            if members is not None and (new := change(members)) != members:
                lines[i] = m[1] + "[" + ", ".join(new) + "]" + m[2][len(value) :] + lines[i][len(bare) :]
    return "\n".join(lines)


def set_fields(text: str, values: dict[str, str | None]) -> str:
    """The text with frontmatter fields set, or removed where the value is None; refuses a text without closed frontmatter."""
    lines = text.split("\n")
    end = next((i for i in range(1, len(lines)) if FENCE.match(lines[i].rstrip("\r"))), None) if lines and FENCE.match(lines[0].rstrip("\r")) else None
    if end is None:
        raise ValueError("the frontmatter is missing or not closed")
    eol = "\r" if lines[0].endswith("\r") else ""
    head = [x for x in lines[1:end] if not ((m := KEY.match(x.rstrip("\r"))) and m[1] in values)]
    head += [f"{k}: {v}{eol}" for k, v in values.items() if v is not None]
    return "\n".join([lines[0], *head, *lines[end:]])
