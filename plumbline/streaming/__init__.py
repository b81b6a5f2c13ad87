"""Ledgers as streams. The last row of an id wins, however late the rows of others come."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from ..operators.ledgers import last_row_wins
from ..sources import dropped, shared_dir


def latest_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, kept up as rows of a stream come in (update or complete mode)."""
    return last_row_wins(rows, key, *order)


def fold_into_table(rows: DataFrame, key: str, order: list[str], table: str, checkpoint: str | None = None, **trigger):
    """Starts a stream that keeps ``table`` (a path) at the last row of each key.

    Each batch is folded with the newest version of the table and written as the
    next one; a batch that is tried again writes the same version, so nothing is
    counted twice. Read it with ``current``.
    """
    spark = rows.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        before = current(spark, table, number - 1)
        every = batch if before is None else batch.unionByName(before)
        last_row_wins(every, key, *order).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/version={number}")
        for old in versions(spark, table):
            if old < number - 1:  # the one before is what a batch that is tried again reads
                dropped(spark, f"{table}/version={old}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/stream-{hashlib.sha256(table.encode()).hexdigest()[:16]}").trigger(**(trigger or {"availableNow": True})).start()


def current(spark, table: str, newest: int | None = None) -> DataFrame | None:
    """The newest version of a table of fold_into_table, or that of a given number and below."""
    found = [v for v in versions(spark, table) if newest is None or v <= newest]
    return spark.read.parquet(f"{table}/version={max(found)}") if found else None


def versions(spark, table: str) -> list[int]:
    """The versions of a table that were written whole."""
    jvm = spark._jvm
    home = jvm.org.apache.hadoop.fs.Path(table)
    store = home.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in store.listStatus(home)] if store.exists(home) else []
    return [int(n.split("=")[1]) for n in names if n.startswith("version=") and store.exists(jvm.org.apache.hadoop.fs.Path(home, f"{n}/_SUCCESS"))]


__all__ = ["current", "fold_into_table", "latest_rows"]
