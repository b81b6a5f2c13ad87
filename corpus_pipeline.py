"""From raw documents to training sequences.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps,
with the columns of documents; the last gives packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from plumbline.llm.shared import dropped, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this run's labels, does not reject; all, without labels of both classes."""
    model = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that came before; n_chars follows the text.

    A document all of whose text came before goes: it is a copy. Those that had
    no text from the start stay, as they lost nothing.
    """
    kept = line_dedup.without_emptied(line_dedup.dedup_lines(docs))
    if "n_chars" in docs.columns:
        count = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more), judged row by row."""
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids that do not cross documents."""
    return packing.pack(docs, remember=100_000, run_bytes=2 << 20)  # workers still hold memory of the stages before


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: SQL can't express the first and the last stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)  # of no effect on the input
    return STAGES[-1][1](spark, docs, sf_dir)
