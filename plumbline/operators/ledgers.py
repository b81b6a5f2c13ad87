"""Append-only ledgers: the last row of an id is its verdict, and what is not evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_row_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the order of the columns; earlier ones are history.

    An aggregate, so a key with very many rows is folded before the shuffle.
    """
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last")).select(key, *(F.col("__last")[c].alias(c) for c in columns))


def quarantine(rows: DataFrame, key: str, order: list[str], word: str, known: list[str]) -> DataFrame:
    """Every key with its last word and whether that is evidence.

    Rows are ranked before they are judged: a key whose last row is damaged or
    holds an unknown word has no evidence and does not fall back to an earlier one.
    """
    last = last_row_wins(rows, key, *order)
    return last.select(key, F.col(word).alias("last_word"), F.coalesce(F.col(word).isin(known), F.lit(False)).alias("evidence"))


def superseded_odd(rows: DataFrame, key: str, order: list[str], word: str, known: list[str]) -> DataFrame:
    """Rows with an unknown word that a later row of their key has superseded; they are named all the same."""
    last = rows.groupBy(key).agg(F.max(F.struct(*order)).alias("__last"))
    odd = rows.where(~F.coalesce(F.col(word).isin(known), F.lit(False)))
    return odd.join(last, key).where(F.struct(*order) != F.col("__last")).drop("__last")


def voided(rows: DataFrame, file: str, key: str) -> DataFrame:
    """file, headless, void: a row without an id voids its whole ledger."""
    return rows.groupBy(file).agg(F.count_if(F.coalesce(F.col(key), F.lit("")) == "").alias("headless")).withColumn("void", F.col("headless") > 0)


def scope(units: DataFrame, unit: str, digest: str, ledger: DataFrame, key: str, order: list[str], word: str, bound: str, used: str | None = None) -> DataFrame:
    """Every unit with its evidence class.

    verified: the last row says so and binds the current digest; stale: it binds
    another; legacy-unbound: it binds none; failed; unverified: no row, or a last
    row that is no evidence.
    """
    last = last_row_wins(ledger.select(F.col(key).alias("__id"), *order, F.col(word).alias("__word"), F.col(bound).alias("__bound")), "__id", *order)
    joined = units.join(last, F.col(unit) == F.col("__id"), "left")
    kind = (
        F.when(F.col("__word") == "failed", "failed")
        .when(F.col("__word") == "legacy-unbound", "legacy-unbound")
        .when((F.col("__word") == "verified") & (F.col("__bound") == F.col(digest)), "verified")
        .when(F.col("__word") == "verified", "stale")
        .otherwise("unverified")
    )
    return joined.select(*units.columns, kind.alias("evidence"))


def ghosts(ledger: DataFrame, key: str, units: DataFrame, unit: str) -> DataFrame:
    """Ids in the ledger that no unit has; shown, never blocking."""
    return ledger.select(key).distinct().join(units.select(F.col(unit).alias("__unit")), F.col(key) == F.col("__unit"), "left_anti")

