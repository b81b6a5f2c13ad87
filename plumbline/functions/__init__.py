"""Column expressions: one judge for each rule, imported wherever the rule is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX64 = r"^[0-9a-f]{64}\z"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def canon_id(text: Column) -> Column:
    """The one spelling of a lenient id: its letter, its digits without leading zeros, padded to three. Null unless an id.

    Digits are handled as text, so ids of any length stay exact.
    """
    letter, digits = F.regexp_extract(text, r"^([tmc])[0-9]+\z", 1), F.regexp_extract(text, r"^[tmc]0*([0-9]+)\z", 1)
    return F.when(letter != "", F.concat(letter, F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0"))))


def date_valid(text: Column) -> Column:
    """A zero-padded YYYY-MM-DD that is a day of the calendar."""
    return F.coalesce(F.regexp_like(text, F.lit(ISO_DATE)) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def ws_normalize(text: Column) -> Column:
    """Runs of space, tab, CR and LF as one space, none at the ends; other white space is content."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def eol_lines(text: Column) -> Column:
    """Lines of a text; one CR before a line feed belongs to the line's end, a second one to the line."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))


def is_binary(text: Column) -> Column:
    """Whether a text (bytes as Latin-1) holds control characters other than tab, CR and LF."""
    return F.regexp_like(text, F.lit(CONTROL))


def is_digest(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(HEX64)), F.lit(False))


def is_placeholder(value: Column) -> Column:
    """A value that is one brace group and nothing else."""
    return F.coalesce(F.regexp_like(value, F.lit(r"^\{[^{}]*\}\z")), F.lit(False))


def field_problem(value: Column) -> Column:
    """What is wrong with a required field: missing, empty or placeholder; null if nothing is."""
    return F.when(value.isNull(), "missing").when(F.trim(value) == "", "empty").when(is_placeholder(value), "placeholder")


def has_field(fields: Column, names: list[str]) -> Column:
    """Whether a map of fields has one of these names."""
    return F.coalesce(F.arrays_overlap(F.map_keys(fields), F.array(*map(F.lit, names))), F.lit(False))


def diagnostic_json(code: Column, message: Column) -> Column:
    """A diagnostic as one JSON object."""
    return F.to_json(F.struct(code.alias("code"), message.alias("message")))


def slot_state(text: Column, known: list[str]) -> Column:
    """State of the bracketed slot that opens a text: missing, unclosed, blank, placeholder, known or unknown."""
    inner = F.regexp_extract(text, r"^\[([^\]]*)\]", 1)
    return (
        F.when(~F.startswith(text, F.lit("[")), "missing")
        .when(~F.contains(text, F.lit("]")), "unclosed")
        .when(F.trim(inner) == "", "blank")
        .when(is_placeholder(inner), "placeholder")
        .when(inner.isin(known), "known")
        .otherwise("unknown")
    )


def content_digest(content: Column) -> Column:
    """SHA-256 of bytes, as lower-case hex."""
    return F.sha2(content, 256)


def material_body(text: Column) -> Column:
    """A converted text with LF line ends and without the status line of its frontmatter; the body is not touched."""
    unix = F.regexp_replace(text, "\r\n", "\n")
    return F.regexp_replace(unix, r"(?s)\A(---[ \t]*\n(?:(?!---[ \t]*\n)[^\n]*\n)*?)status[ \t]*:[^\n]*\n", "$1")


def label_text(stage: Column, as_of: Column, provenance: Column, assumptions: Column, retracted: Column) -> Column:
    """The labels that go with a card, joined by semicolons; empty without any."""
    return F.concat_ws(
        "; ",
        F.when(stage == "plan", "PLAN-STAGE"),
        F.when(as_of.isNotNull() & (as_of != ""), F.concat(F.lit("as of "), as_of)),
        F.when(provenance == "derived", F.concat(F.lit("derived"), F.when(F.coalesce(F.size(assumptions), F.lit(0)) > 0, F.concat(F.lit(": "), F.array_join(assumptions, ", "))).otherwise(""))),
        F.when(provenance == "adopted", "adopted"),
        F.when(retracted, "retracted source"),
    )


def id_tokens(text: Column, letter: str = "t") -> Column:
    """All ids with that letter in a text, in order, as canonical ids."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\b{letter}([0-9]+)\b"), 1), lambda d: canon_id(F.concat(F.lit(letter), d)))


def row_state(id_: Column, digest: Column, word: Column, date: Column, words: list[str]) -> Column:
    """Why a ledger row is no evidence: headless, bad digest, bad date, unknown word; or ok."""
    return (
        F.when(F.coalesce(id_, F.lit("")) == "", "headless")
        .when(~(is_digest(digest) | (digest == "-")), "bad-digest")
        .when(~date_valid(date), "bad-date")
        .when(~word.isin(words), "unknown-word")
        .otherwise("ok")
    )
