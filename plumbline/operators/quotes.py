"""Quotations against the raw sources that their markers name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.quotes import spans
from ..functions import is_binary, ws_normalize
from .counts import tree_digest

SPAN_SCHEMA = "unit string, line long, start long, end long, text string, source string, mode string, file string, state string, codes array<string>"


def raw_sources(files: DataFrame, materials: str) -> DataFrame:
    """unit, name, valid, size, digest, content: the files named source.<extension> in a material's folder, and those that only look like it."""
    home = materials.replace("\\", "\\\\")
    name = F.regexp_extract("path", rf"^\Q{home}\E/(m[0-9]+)/([^/]+)$", 2)
    own = files.select(F.regexp_extract("path", rf"^\Q{home}\E/(m[0-9]+)/([^/]+)$", 1).alias("unit"), name.alias("name"), "content", "length").where("unit <> ''")
    alike = own.where(F.lower("name").rlike(r"^\.?sources?(\.|$)"))
    return alike.select("unit", "name", F.col("name").rlike(r"^source\..+$").alias("valid"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), "content")


def raw_states(raw: DataFrame, units: DataFrame) -> DataFrame:
    """unit, state, n, tree_digest: complete, empty (no source) or invalid (a file that only looks like one)."""
    valid = raw.where("valid")
    tree = tree_digest(valid, "unit", "name", "digest")
    counted = raw.groupBy("unit").agg(F.count_if(F.col("valid")).alias("n"), F.count_if(~F.col("valid")).alias("odd"))
    joined = units.select(F.col("id").alias("unit")).join(counted, "unit", "left").join(tree, "unit", "left")
    state = F.when(F.col("odd") > 0, "invalid").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("complete")
    return joined.select("unit", state.alias("state"), F.coalesce("n", F.lit(0)).alias("n"), "tree_digest")


def quote_spans(materials: DataFrame) -> DataFrame:
    """The quotations of converted texts (id, body); state is empty where a source has to decide."""

    def run(batches):
        for batch in batches:
            rows = [(unit, s.line, s.start, s.end, s.text, s.attrs.get("source"), s.attrs.get("mode"), s.attrs.get("file"), s.state, s.codes) for unit, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in spans(body or "")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.string())]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SPAN_SCHEMA.split(", ")])

    return materials.select("id", "body").mapInArrow(run, SPAN_SCHEMA)


def judged(spans_: DataFrame, raw: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Spans with their final state, one of nine, and where they stand: at and size, bytes of the source file.

    A quotation is sealed if its bytes, white space aside, stand in the source as
    one block; its first place there is given, before white space is normalised.
    A source file may be left out only where the material has one. A material
    whose set of sources is not whole, which ``states`` (unit, state) tells of,
    proves nothing. Binary sources
    can't seal; with mode not-checkable they leave a debt. entry_digest is that of
    the file that decided.
    """
    numbered = spans_.withColumn("owner", F.when(F.col("source") == "self", F.col("unit")).otherwise(F.col("source")))
    latin = F.decode("content", "ISO-8859-1")  # a character for each byte
    valid = raw.where("valid").select(F.col("unit").alias("o"), F.col("name"), F.col("digest").alias("entry_digest"), latin.alias("body"), is_binary(latin).alias("binary"))
    count = raw.groupBy(F.col("unit").alias("o")).agg(F.count_if("valid").alias("files"), F.min(F.when(F.col("valid"), F.col("name"))).alias("only"))
    if states is not None:
        unsound = states.where("state NOT IN ('complete', 'empty')").select(F.col("unit").alias("o"), F.lit(True).alias("odd"))
        count = count.join(unsound, "o", "full_outer")
    else:
        count = count.withColumn("odd", F.lit(False))
    placed = numbered.join(count, F.col("owner") == F.col("o"), "left").drop("o").withColumn("wanted", F.coalesce("file", F.when(F.col("files") == 1, F.col("only"))))
    joined = placed.join(valid, (F.col("owner") == F.col("o")) & (F.col("wanted") == F.col("name")), "left")
    quote = ws_normalize(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    found = F.regexp_instr("body", in_any_space(quote))
    decided = (
        F.when(F.col("state") != "", F.struct(F.col("state").alias("state"), F.col("codes").alias("codes")))
        .when(F.coalesce("odd", F.lit(False)), _result("source-unavailable", "QUOTE-SOURCE-INVALID-SET"))
        .when(F.coalesce("files", F.lit(0)) == 0, _result("source-unavailable", "QUOTE-SOURCE-ABSENT"))
        .when(F.col("wanted").isNull(), _result("unresolved", "QUOTE-SOURCE-AMBIGUOUS"))
        .when(F.col("name").isNull(), _result("unresolved", "QUOTE-FILE-UNRESOLVED"))
        .when(F.col("binary") & (F.col("mode") == "not-checkable"), _result("binary-cold-debt"))
        .when(F.col("binary"), _result("mismatch", "QUOTE-BINARY-NOT-VERBATIM"))
        .when(F.col("mode") == "not-checkable", _result("mismatch", "QUOTE-NOT-CHECKABLE-ON-TEXT"))
        .when(F.col("found") > 0, _result("sealed"))
        .otherwise(_result("mismatch", "QUOTE-MISMATCH"))
    )
    kept = joined.withColumn("found", F.when((F.col("state") == "") & ~F.col("binary") & (F.col("mode") != "not-checkable"), found))
    sealed = F.col("d.state") == "sealed"
    out = kept.select("unit", "line", "start", "end", "text", "owner", F.col("wanted").alias("file"), decided.alias("d"), "found", "entry_digest", F.when(F.col("found") > 0, F.length(F.regexp_substr("body", in_any_space(quote)))).alias("long"))
    return out.select("unit", "line", "start", "end", "text", "owner", "file", F.col("d.state").alias("state"), F.col("d.codes").alias("codes"), F.when(sealed, F.col("found") - 1).cast("long").alias("at"), F.when(sealed, F.col("long")).cast("long").alias("size"), "entry_digest")


def in_any_space(quote: Column) -> Column:
    """A pattern that finds a normalised text wherever its words stand with any white space between them."""
    whole = F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), F.replace(whole, F.lit(" "), F.lit("\\E[ \\t\\r\\n]+\\Q")), F.lit("\\E"))


def _result(state: str, *codes: str):
    return F.struct(F.lit(state).alias("state"), F.array(*map(F.lit, codes)).cast("array<string>").alias("codes"))
