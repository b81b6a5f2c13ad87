"""Target-distribution importance resampling over hashed word runs, without exploding documents to score them.

Higher-order functions turn each text into the array of its features' buckets.
Bucket counts of the corpus and of the target give each bucket a gain, the log
ratio of its shares; a document is scored by folding the look-ups in one literal
array of gains over its bucket array. Rows of documents aren't shuffled for
that: counts are combined before the shuffle, so only totals of buckets move.
A seeded Gumbel number added to the score turns "the highest" into a draw
without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, dropped, placed, stored

#: A run of ASCII letters and digits and of all characters beyond ASCII; for texts whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST_RUN = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: The parts of a gain and of the random number are thousandths.
UNIT = 1_000


def words(text: Column) -> Column:
    """array<string>: the words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text.cast("string")), F.lit("")), F.lit(WORD), F.lit(0))


def runs_of(words: Column, longest: int = LONGEST_RUN) -> Column:
    """array<string>: all runs of 1 to ``longest`` consecutive words, joined by a space, with repeats."""
    one = every = words
    for k in range(2, longest + 1):
        n = F.greatest(F.size(words) - (k - 1), F.lit(0))
        one = F.zip_with(F.slice(one, F.lit(1), n), F.slice(words, F.lit(k), n), lambda a, b: F.concat(a, F.lit(" "), b))
        every = F.concat(every, one)
    return every


def buckets_of(features: Column, n_buckets: int = BUCKETS) -> Column:
    """array<int>: the bucket of each feature, its unsigned crc32 modulo ``n_buckets``."""
    return F.transform(features, lambda f: (F.crc32(f) % n_buckets).cast("int"))


def bucket_counts(rows: DataFrame, buckets: str = "buckets") -> DataFrame:
    """bucket, n: how often each bucket stands in the arrays; each task combines its counts before they move."""
    return rows.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, from the counts of both sides; ``n_buckets`` numbers, whatever the size of the input.

    floor(1000 * ln((t + 1) * (S + n) / ((s + 1) * (T + n)))) in doubles: one is added to
    each of the n buckets, so a bucket that a side lacks has a gain as well.
    """
    every = corpus.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    all_s, all_t = rows.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(all_s + n_buckets) / ((F.col("s") + 1) * F.lit(all_t + n_buckets))
    gains = dict(rows.select("bucket", F.floor(UNIT * F.log(ratio)).cast("long")).collect())
    return [gains[b] for b in range(n_buckets)]


def weight_of(buckets: Column, gains: list[int]) -> Column:
    """The mean gain of a document's features, rounded down; 0 without features.

    The array of gains is one literal: the optimizer folds its text before any row is read.
    """
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda had, b: had + F.element_at(table, b + 1))
    n = F.size(buckets)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(((total - F.pmod(total, n)) / n).cast("long"))


def luck_of(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, rounded down, that seed and id decide alone; a null id is written as nothing."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n_buckets: int = BUCKETS, longest: int = LONGEST_RUN, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", whole: bool = False) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank (all but doc_id long); with ``whole`` also row, the struct of its own columns.

    Of the documents with ``least_words`` words or more, ``percent`` in a
    hundred (rounded down) are drawn: those of the highest score, which is
    weight plus luck. rank counts the drawn from 1; it is null for the rest.

    Ties go to the smaller id (null before all), then the higher weight, then
    fewer features; of rows alike in these any comes first. Repeated rows and
    ids are documents of their own, and count each time. Null and empty texts
    have no features and weight 0, and are drawn only if ``least_words`` is 0.
    An empty target is one without counts: gains then only tell rare buckets
    from frequent ones. No rows give no rows. Columns of the input may have any
    names. Texts of any length are folded within their row.
    """
    own = [F.struct("*").alias("row")] if whole else []
    found = words(F.col(text_col))
    cut = docs.select(F.col(id_col).alias("doc_id"), found.alias("words"), *own)
    cut = cut.select("doc_id", (F.size("words") >= least_words).alias("fit"), buckets_of(runs_of(F.col("words"), longest), n_buckets).alias("buckets"), *["row"] * whole)
    arrays = stored(cut, "buckets")
    wanted = target.select(buckets_of(runs_of(words(F.col(target_col)), longest), n_buckets).alias("buckets"))
    gains = gains_of(bucket_counts(arrays), bucket_counts(wanted), n_buckets)
    n_drawn = arrays.where("fit").count() * percent // 100

    scored = arrays.select("doc_id", "fit", F.size("buckets").cast("long").alias("n_features"), weight_of(F.col("buckets"), gains).alias("weight"), *["row"] * whole)
    scored = scored.withColumn("score", F.col("weight") + luck_of(F.col("doc_id"), seed))
    ranked = placed(scored, "place", F.desc("fit"), F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.asc("n_features"))
    dropped(arrays)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < n_drawn, F.col("place") + 1).alias("rank"), *["row"] * whole)


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that resample() draws, with their own columns; order is not kept."""
    return resample(docs, target, **parameters, whole=True).where("rank IS NOT NULL").select("row.*")
