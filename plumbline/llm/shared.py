"""What the operators share: input tables, tables in the shared folder, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_dir, table

__all__ = ["LOWER", "Rows", "ascii_lower", "deleted_at_exit", "dropped", "finished_folders", "fresh_path", "pieces", "placed", "rows_where", "shared_dir", "stored", "table", "trimmed", "words_of"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table to the shared folder and read back.

    Cuts the lineage: a lost executor costs the running stage only. The files go
    with dropped(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    store, target = _place(spark, path)
    store.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def deleted_at_exit(spark: SparkSession, path: str) -> str:
    """The path itself; its files go when the session's JVM ends."""
    store, target = _place(spark, path)
    store.deleteOnExit(target)
    return path


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder whose writers finished."""
    store, target = _place(spark, path)
    if not store.exists(target):
        return []
    found = [f.getPath() for f in store.listStatus(target) if f.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [f.getName() for f in found if store.exists(done(f, "_SUCCESS"))]


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "_plumbline_path", None)
        if path:
            store, target = _place(spark, path)
            store.delete(target, True)


def placed(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their place (long, from 0) in the order of all, without a task that sees them all.

    Rows are dealt to ranges of the order and sorted there, so a row's number in
    its task is its place in the range; the rows of each range, one number for
    each task, give where it begins. Rows alike in the order may come in any, and
    are dealt to several ranges if there are very many of them.
    """
    number, tie = f"__{name}_number", f"__{name}_tie"
    ranged = rows.withColumn(tie, F.spark_partition_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order).drop(tie)
    own = stored(ranged.withColumn(number, F.monotonically_increasing_id()), name)
    task = F.shiftright(number, 33)
    counts = sorted(own.groupBy(task.alias("task")).agg(F.count("*")).collect())  # a row for each task
    starts, before = [], 0
    for at, n in counts:
        starts.append((at, before))
        before += n
    begins = F.broadcast(rows.sparkSession.createDataFrame(starts, "__task int, __start long"))
    in_range = F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    return own.join(begins, task == F.col("__task"), "left").select(*rows.columns, (F.col("__start") + in_range).alias(name))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: str.translate table that lower-cases A-Z and nothing else.
LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and \\t \\n \\v \\f \\r."""
    for gap in "\n\t\r\x0b\x0c":
        if gap in text:
            text = text.replace(gap, " ")
    words = text.split(" ")
    return [w for w in words if w] if "" in words else words


def rows_where(docs: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows of docs for whose text decide()(texts) is true; null texts are judged as empty. Nothing is shuffled."""

    def run(batches):
        keep = decide()
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def trimmed(run):
    """run(batches) that gives unused memory back when a task ends; workers outlive their tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def pieces(batches, rows: int = 1_000):
    """The batches in slices of so many rows, so that few rows at a time are Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


class Rows:
    """Collects output columns and gives Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_rows: int = 20_000, most_bytes: int = 16 << 20):
        self.schema, self.most_rows, self.most_bytes = schema, most_rows, most_bytes
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.bytes = 0

    def add(self, *values, size: int = 0) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.bytes += size

    @property
    def full(self) -> bool:
        return len(self.columns[0]) >= self.most_rows or self.bytes >= self.most_bytes

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(self.columns, self.schema)], schema=self.schema)
        self.clear()
        return out
