"""Text files as numbered lines, and ledgers of tab-separated rows as tables with a read state.

Spark splits the files by bytes, so one file may span many tasks. A line's number
is its number in its split and the lines in the splits before; only the counts of
splits, one row each, are added up in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as R
from . import fresh_stored, shared_dir

#: Characters that a field can't hold; tabs and line feeds part fields and lines.
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"
BLANK = r"^[\s\p{Z}\x85]*\z"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), line: the lines of a file, or of a folder's files in the order of their names.

    Lines end at a line feed, which is no part of them; a carriage return is. A
    last line without its end counts; an empty file has no lines. Bytes that are
    no UTF-8 stay as they are in the rows; a byte order mark at the start goes.
    """
    found = _split_lines(spark, path)
    counts = found.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    order = Window.orderBy("file", "split")  # a row for each split of a file
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "split", (before - F.col("least") + 1).alias("shift"))
    return found.join(F.broadcast(starts), ["file", "split"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at, line: ``at`` rises within a split; splits of a file are told apart by their first byte."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def unended(spark: SparkSession, path: str) -> DataFrame:
    """file: the files whose last line has no end. Bytes are counted; no text leaves its task."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n"))
    sums = raw.groupBy("file").agg(F.sum(F.col("n") + 1).alias("read"), F.max("size").alias("size"))
    return sums.where((F.col("read") == F.col("size") + 1) | (F.col("read") == F.col("size") - 2)).select("file")  # a byte order mark of three bytes isn't read


@dataclass(frozen=True)
class Grammar:
    """A ledger's columns, the words that its rows may say, and what a row must be besides."""

    names: tuple[str, ...]
    word: str
    words: tuple[str, ...]
    holds: Callable[[], Column]


def _verdict_holds() -> Column:
    digest = R.is_digest(F.col("digest")) | (F.col("digest") == "-")
    return R.canon_id(F.col("id")).isNotNull() & digest & F.rlike("round", F.lit(r"^(?:[0-9]+|-)\z")) & R.date_valid(F.col("day"))


def _declaration_holds() -> Column:
    """A binding word needs both digests and a count of sources; the others have a digest or none."""
    source, copy = R.is_digest(F.col("source_digest")), R.is_digest(F.col("copy_digest"))
    binding = source & copy & F.rlike("sources", F.lit(r"^[1-9][0-9]*\z"))
    other = (source | (F.col("source_digest") == "-")) & (copy | (F.col("copy_digest") == "-"))
    named = R.canon_id(F.col("id")).isNotNull() & F.startswith("id", F.lit("m")) & R.date_valid(F.col("day"))
    return named & F.when(F.col("word").isin("declared", "anchored"), binding).otherwise(other)


VERDICTS = Grammar(("id", "digest", "word", "round", "standard", "day"), "word", ("verified", "failed", "legacy-unbound"), _verdict_holds)
DECLARATIONS = Grammar(("id", "source_digest", "word", "sources", "copy_digest", "note", "day"), "word", ("declared", "anchored", "no-source", "legacy-unbound"), _declaration_holds)


def ledger_rows(lines: DataFrame, grammar: Grammar) -> DataFrame:
    """row_ord, the grammar's columns, headless, fit, known: the rows of a ledger's numbered lines.

    Every tab parts two fields; one carriage return before the line feed belongs
    to the line's end. Comments and empty lines are no rows. A row is headless if
    its first field is blank, fit if it has all fields and no more, no control
    characters in them and holds to its grammar, and known if its word is one of
    the ledger's besides. Fields that a row lacks are null, and its id takes the
    one spelling of ids.
    """
    line = F.regexp_replace("line", r"\r\z", "")
    fields = lines.select(F.col("line_no").alias("row_ord"), line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).select("row_ord", F.split("line", "\t", -1).alias("fields"))
    size = len(grammar.names)
    rows = fields.select("row_ord", *(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(grammar.names)), F.rlike(F.get("fields", F.lit(0)), F.lit(BLANK)).alias("headless"), ((F.size("fields") == size) & ~F.exists("fields", lambda f: F.rlike(f, F.lit(CONTROL)))).alias("whole"))
    judged = rows.withColumn("fit", F.col("whole") & F.coalesce(grammar.holds(), F.lit(False)))
    judged = judged.withColumn("known", F.col("fit") & F.coalesce(F.col(grammar.word).isin(*grammar.words), F.lit(False)))
    return judged.withColumn("id", F.coalesce(R.canon_id(F.col("id")), F.col("id"))).drop("whole")


def read_ledger(spark: SparkSession, path: str, grammar: Grammar) -> tuple[DataFrame, str]:
    """(row_ord, the grammar's columns, fit, known; state) of a ledger file, or of a folder of its parts in the order of their names.

    ``state`` is ok; torn if a last line has no end, be it a comment; headless if
    a row has no id. Either voids the ledger: it then has no rows, as any of them
    could have been the last of its id. A word that is no evidence is null.
    """
    rows = fresh_stored(ledger_rows(numbered_lines(spark, path), grammar), shared_dir(spark), "ledger-rows")
    headless, torn = not rows.where("headless").isEmpty(), not unended(spark, path).isEmpty()
    state = "headless" if headless else "torn" if torn else "ok"
    word = F.when(F.col("known"), F.col(grammar.word)).alias(grammar.word)
    given = rows.select("row_ord", *(word if n == grammar.word else n for n in grammar.names), "fit", "known")
    return (given if state == "ok" else given.where("false")), state
