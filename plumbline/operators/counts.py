"""Counts whose buckets are always all there, duplicates, digests of sets of files."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def buckets(rows: DataFrame, bucket: str, names: list[str], other: str | None = None) -> DataFrame:
    """bucket, n: rows of each named bucket, zeros included; rows of no bucket count as ``other`` if given."""
    spark: SparkSession = rows.sparkSession
    own = F.when(F.col(bucket).isin(names), F.col(bucket)).otherwise(F.lit(other))
    counted = rows.groupBy(own.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(n,) for n in names + ([other] if other else [])], "bucket string")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tallies(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows for each condition; none is lost when it ran zero times."""
    return rows.agg(F.count("*").alias("population"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(population: DataFrame, key: str, covered: DataFrame, covered_key: str, exempt: Column) -> DataFrame:
    """covered, denominator, exempt: numerator and denominator from the one population."""
    marked = population.join(covered.select(F.col(covered_key).alias("__covered")).distinct(), F.col(key) == F.col("__covered"), "left")
    return marked.agg(
        F.count_if(~exempt & F.col("__covered").isNotNull()).alias("covered"),
        F.count_if(~exempt).alias("denominator"),
        F.count_if(exempt).alias("exempt"),
    )


def tree_digest(rows: DataFrame, tree: str, name: str, digest: str) -> DataFrame:
    """tree, tree_digest: SHA-256 over the lines name NUL digest LF in the byte order of the names.

    A tree's rows come to one task in that order and are hashed as they come, so
    a tree of any number of files takes the memory of one batch. Names that a
    tree has twice follow each other by digest; a row without a name or a digest
    adds nothing.
    """
    listed = rows.select(F.col(tree), F.col(name).cast("string").alias("__name"), F.col(digest).cast("string").alias("__digest"))

    def hashed(batches):
        now, state, kind = None, None, None
        for batch in batches:
            kind, done = batch.column(0).type, []
            for key, own, value in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                if own is not None and value is not None:
                    state.update(f"{own}\0{value}\n".encode())
            yield _digests(done, kind)
        if state is not None:
            yield _digests([(now, state.hexdigest())], kind)

    def _digests(done, kind):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=[tree, "tree_digest"])

    schema = StructType([listed.schema[tree], StructField("tree_digest", StringType())])
    return listed.repartition(tree).sortWithinPartitions(tree, "__name", "__digest").mapInArrow(hashed, schema)


def conservation(rows: DataFrame, disposition: str, known: list[str]) -> DataFrame:
    """before, the rows of each disposition, and whether these add up to all."""
    counted = rows.agg(F.count("*").alias("before"), *(F.count_if(F.col(disposition) == k).alias(k) for k in known))
    return counted.withColumn("conserved", F.col("before") == sum((F.col(k) for k in known), F.lit(0)))
