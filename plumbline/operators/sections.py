"""Line-wise structure: entries with the lines that they own, tallies of lines by which two sides differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line: one row for each line of each text."""
    return rows.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("__at", "line")).select(key, (F.col("__at") + 1).cast("long").alias("line_no"), "line")


def runs(rows: DataFrame, key: str, text: str, starts: Callable[[Column], Column]) -> DataFrame:
    """key, entry, first, last, head: the entries of each text, from a line that starts one to the line before the next.

    Lines count from 1. Entry 0 holds the lines before the first start, if there
    are any, and has no head. Folded within each row: no line is shuffled.
    """
    lines, at = F.col("__lines"), F.col("__at")
    split = rows.where(F.col(text).isNotNull()).select(F.col(key), F.split(text, "\n", -1).alias("__lines"))
    marked = split.withColumn("__at", F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.coalesce(starts(F.get(lines, i)), F.lit(False))))
    bounds = marked.withColumn("__lead", F.when(F.coalesce(F.get(at, F.lit(0)) > 0, F.lit(True)), 1).otherwise(0))
    bounds = bounds.withColumn("__at", F.when(F.col("__lead") == 1, F.concat(F.array(F.lit(0)), at)).otherwise(at))
    stops = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(lines)))
    each = bounds.select(key, "__lines", "__lead", F.posexplode(F.arrays_zip(at.alias("lo"), stops.alias("hi"))).alias("__k", "__run"))
    entry = F.col("__k") + 1 - F.col("__lead")
    lo, hi = F.col("__run")["lo"], F.col("__run")["hi"]
    return each.select(key, entry.cast("long").alias("entry"), (lo + 1).cast("long").alias("first"), hi.cast("long").alias("last"), F.when(entry > 0, F.get(lines, lo)).alias("head"))


def line_diff(old: DataFrame, new: DataFrame, line: str) -> DataFrame:
    """line, change, n: lines that one side has more often than the other ('removed' or 'added'), for the verdict of a comparison."""
    a, b = old.groupBy(line).agg(F.count("*").alias("a")), new.groupBy(line).agg(F.count("*").alias("b"))
    both = a.join(b, line, "full_outer").select(line, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.where("a <> b").select(line, F.when(F.col("a") > F.col("b"), "removed").otherwise("added").alias("change"), F.abs(F.col("a") - F.col("b")).alias("n"))
