"""Ledgers as folders of parts, on any file system that Hadoop knows: an append adds a part and touches no other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dropped
from . import Refusal

#: What reads a ledger's parts in the order of their appends; see sources.lines.
PARTS = "part-*"


def part_numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the parts that a ledger has, in order."""
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = home.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(home)] if store.exists(home) else []
    return sorted(int(n[5:]) for n in names if n.startswith("part-") and n[5:].isdigit())


def append_rows(rows: DataFrame, folder: str, columns: list[str], order: list[str], expected: int | None = None) -> int | None:
    """Appends rows, their columns joined by tabs, in their order; gives the number of the new part, or nothing without rows.

    Tasks write to a folder that readers pass over; when all are done, one rename
    makes it a part. A task or a driver that is lost before leaves the ledger as
    it was, and what it wrote is of no effect. Of two writers that would add the
    same part, the second is refused; so is one that names the last part it knows
    (``expected``, 0 for none) when there is a later one. A field with a tab, a
    line feed or another control character is refused before anything counts.
    """
    spark = rows.sparkSession
    last = max(part_numbers(spark, folder), default=0)
    if expected is not None and expected != last:
        raise Refusal(f"{folder} has part {last}, not {expected}")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    whole = F.forall(F.array(*fields), lambda f: ~F.rlike(f, F.lit(r"[\x00-\x1F\x7F]")))
    line = F.when(whole, F.concat_ws("\t", *fields)).otherwise(F.raise_error(F.lit("a field holds a control character")))
    staged, part = f"{folder}/.staged-{uuid.uuid4().hex}", f"{folder}/part-{last + 1:09d}"
    try:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.text(staged)
        if spark.read.text(staged).isEmpty():
            return None
        _renamed(spark, staged, part)
    except Exception as e:
        if "control character" in str(e):
            raise Refusal("a field holds a control character") from None
        raise
    finally:
        dropped(spark, staged)
    return last + 1


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder in one step; a target that is there already is refused and not touched."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(new)
    plain = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.Path(old), target, plain)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Refusal(f"{new} is there already") from None
        raise
