"""Registers, cards and stores as tables: texts of files in rows, judged by the rules of the core where they are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cards as C
from ..core import registers as G
from ..core import state as S
from ..core.markdown import scan


def _judged(rows: DataFrame, key: str, text: str, judge, schema: str, kinds: list) -> DataFrame:
    """key and the columns of schema for each tuple that judge(text) gives; a null text is empty. One pass, nothing is shuffled."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for batch in batches:
            out = [(own, *found) for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in judge(value or "")]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [batch.schema.types[0], *kinds])], names=names)

    return rows.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {schema}")


def queue_entries(rows: DataFrame, key: str, text: str, title: str = G.QUEUE) -> DataFrame:
    """key, line, state, ownership, entry: the human queue of each text; ownership is empty without a valid tag."""
    return _judged(rows, key, text, lambda t: G.queue_items(scan(t), title), "line long, state string, ownership string, entry string", [pa.int64(), pa.string(), pa.string(), pa.string()])


def untagged(entries: DataFrame) -> DataFrame:
    """Open entries that no one owns."""
    return entries.where("state = 'open' AND ownership = ''")


def queue_split(entries: DataFrame) -> DataFrame:
    """ownership, n: open entries of each ownership, and of all in the row without one."""
    return entries.where("state = 'open'").rollup("ownership").agg(F.count("*").alias("n"))


def verified_ids(rows: DataFrame, key: str, text: str, title: str = S.CONTRACT["verify.sections"][0], siblings: tuple[str, ...] = tuple(S.CONTRACT["verify.sections"][1:])) -> DataFrame:
    """key, unit: the ids and ranges that each text's verified units cover."""
    return _judged(rows, key, text, lambda t: [(x,) for x in G.verified_units(scan(t), title, siblings)[0]], "unit string", [pa.string()])


def gate(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, code: all that keeps each review's gate from passing."""
    return _judged(rows, key, text, G.gate_findings, "line long, code string", [pa.int64(), pa.string()])


def questions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, state, entry: the questions of each text."""
    return _judged(rows, key, text, lambda t: G.questions(scan(t)), "line long, state string, entry string", [pa.int64(), pa.string(), pa.string()])


def gap_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, section, kind, entry: the gap register of each text."""
    return _judged(rows, key, text, lambda t: G.gap_register(scan(t)), "line long, section string, kind string, entry string", [pa.int64(), pa.string(), pa.string(), pa.string()])


def card_states(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, state, fields, lists, duplicates, open_lists: the frontmatter of each text."""

    def judge(value: str):
        card = C.read_card(value)
        yield card.state, list(card.fields.items()), list(card.lists.items()), card.duplicates, card.unclosed_lists

    strings = pa.list_(pa.string())
    schema = "state string, fields map<string,string>, lists map<string,array<string>>, duplicates array<string>, open_lists array<string>"
    return _judged(rows, key, text, judge, schema, [pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), strings), strings, strings])


def conflict_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, refused, id, targets, claims: the open entries of each conflict store, or the code of the rule that it breaks."""

    def judge(value: str):
        try:
            return [("", e["id"], e["targets"], [c["claim"] for c in e["candidates"]]) for e in S.read_conflicts(value)]
        except S.Refused as e:
            return [(e.code, None, None, None)]

    return _judged(rows, key, text, judge, "refused string, id string, targets array<string>, claims array<string>", [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())])


def canonical_stores(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, store: each conflict store in its one spelling; null if it is refused."""

    def judge(value: str):
        try:
            return [(S.write_conflicts(S.read_conflicts(value)),)]
        except S.Refused:
            return [(None,)]

    return _judged(rows, key, text, judge, "store string", [pa.string()])
