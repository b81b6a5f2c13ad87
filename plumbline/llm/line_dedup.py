"""Line dedup by overlapping chunks of lines; DataFrame functions only.

A chunk is two neighbouring lines with text and the blank lines between them,
wherever they stand. Every passage of two lines or more consists of such chunks,
so a passage is found whole wherever it is repeated: no boundary can be missed,
and none depends on lines outside it. A line of many words is a chunk as well.

Chunks that occur more than once in all documents are removed except where they
come first, by document id, then place; the first place of a line's text always
stays. Chunks are equal if their lines' hashes are, and their bytes: a line hash
that stands for different bytes anywhere makes its chunks stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored

#: A character that isn't white space: ASCII's, Unicode's separators and the next-line character.
INK = r"[^\s\p{Z}\x85]"
GAP = r"[\s\p{Z}\x85]"
LONG_WORDS = 50
#: Bytes of hashes sent to every task at most; more are joined.
MOST_SENT = 8 << 20


def gaps_of(lines: Column, hashes: Column | None = None, long_words: int = LONG_WORDS) -> Column:
    """array<long>: for each line 0 if it is blank, else 1; bit 62 marks a long line. Hashes aren't looked at.

    Words are runs of characters that aren't white space.
    """
    words = f"^{GAP}*+(?:{INK}++{GAP}++){{{long_words - 1}}}{INK}"
    long = lambda x: (F.octet_length(x) >= 2 * long_words - 1) & F.rlike(x, F.lit(words))
    return F.transform(lines, lambda x: F.when(F.rlike(x, F.lit(INK)), 1).otherwise(0) + F.when(long(x), 1 << 62).otherwise(0))


def chunks_of(gaps: Column, hashes: Column) -> Column:
    """array<struct<start, stop, own>>: the repeatable chunks, own being their lines' hashes."""
    every = F.sequence(F.lit(0), F.size(gaps) - 1)
    inked = F.filter(every, lambda i: F.get(gaps, i).bitwiseAND(F.lit(1).cast("long")) != 0)
    n = F.greatest(F.size(inked) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(inked, F.lit(1), n), F.slice(inked, F.lit(2), n), lambda a, b: span(a, b + 1))
    long = F.transform(F.filter(every, lambda i: F.get(gaps, i) >= 1 << 62), lambda i: span(i, i + 1))
    return F.transform(F.concat(pairs, long), lambda c: F.struct(start_of(c).alias("start"), stop_of(c).alias("stop"), F.slice(hashes, start_of(c) + 1, stop_of(c) - start_of(c)).alias("own")))


def span(start: Column, stop: Column) -> Column:
    """Start and stop in one long."""
    return F.shiftleft(start.cast("long"), 32) + stop


def start_of(c: Column) -> Column:
    return F.shiftright(c, 32).cast("int")


def stop_of(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT, long_words: int = LONG_WORDS, hash_of=F.xxhash64) -> DataFrame:
    """All documents with their columns; text without the lines of chunks that came before, and __n_removed.

    Input columns may have any names but __n_removed; ``hash_of`` hashes a line.

    Where a chunk comes first is kept: the smallest id (null before all), then
    the place. Rows with equal id and text count as one document, so they don't
    remove each other. Null and empty texts stay as they are; a text that loses
    all lines becomes empty. No rows give no rows. Lines end at a line feed.
    """
    if "__n_removed" in docs.columns:
        raise ValueError("__n_removed is a column of the result")
    free = lambda name: name if name not in docs.columns else free(name + "_")
    mark, of, other, ranges_, lines_, left = map(free, ("__mark", "__of", "__id", "__ranges", "__lines", "__left"))
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.split(text, "\n", -1).alias("lines")).where(F.size("lines") > 0)
    hashed = own.withColumn("hashes", F.transform("lines", lambda x: hash_of(x).cast("long")))
    gapped = hashed.select("id", "mark", "hashes", gaps_of(F.col("lines"), long_words=long_words).alias("gaps"))
    cut = gapped.select("id", "mark", F.explode(chunks_of(F.col("gaps"), F.col("hashes"))).alias("c"))
    chunks = stored(cut.select("id", "mark", F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), F.col("c.own").alias("own"), F.xxhash64("c.own").alias("key")), "chunks")

    place = F.struct("id", "mark", "start")
    repeated = stored(chunks.groupBy("key", "own").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"), "repeated")

    # byte comparison: each line hash in a repeated chunk must stand for one sequence of bytes
    marks = repeated.select(F.explode("own").alias("h")).distinct()
    marks = stored(marks, "marks")
    sent = F.broadcast(marks) if 16 * marks.count() <= most_sent else marks
    lines = hashed.select(F.explode(F.arrays_zip("hashes", "lines")).alias("l")).select(F.col("l.hashes").alias("h"), F.col("l.lines").alias("line"))
    unequal = lines.join(sent, "h", "left_semi").groupBy("h", "line").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    unequal = stored(unequal, "unequal")
    if not unequal.isEmpty():
        bad = repeated.select("key", "own", F.explode("own").alias("h")).join(unequal, "h", "left_semi").select("key", "own").distinct()
        repeated = repeated.join(bad, ["key", "own"], "left_anti")

    later = chunks.join(repeated, ["key", "own"]).where(~F.struct("id", "mark", "start").eqNullSafe(F.col("first"))).select("id", "mark", "start", "stop")
    ranges = stored(later.groupBy("id", "mark").agg(F.collect_set(span(F.col("start"), F.col("stop"))).alias("__ranges")), "ranges")
    dropped(chunks, repeated, marks, unequal)
    places = ranges.select(F.col("id").alias(other), F.col("mark").alias(of), F.col("__ranges").alias(ranges_))
    joined = docs.withColumn(mark, F.xxhash64(text)).join(places.hint("merge"), F.col(id_col).eqNullSafe(F.col(other)) & (F.col(mark) == F.col(of)), "left")
    joined = joined.withColumn(lines_, F.when(F.col(ranges_).isNotNull(), F.split(text, "\n", -1)))
    gone = F.flatten(F.transform(ranges_, lambda r: F.sequence(start_of(r), stop_of(r) - 1)))
    joined = joined.withColumn(left, F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), gone))
    out = joined.withColumn("__n_removed", F.when(F.col(ranges_).isNull(), 0).otherwise(F.size(lines_) - F.size(left)))
    out = out.withColumn(text_col, F.when(F.col(ranges_).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines_, i)), "\n")))
    return out.select(*docs.columns, "__n_removed")


def without_emptied(deduped: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of dedup_lines() without documents that lost lines and have no other text left: all of it stands elsewhere."""
    return deduped.where((F.col("__n_removed") == 0) | F.rlike(F.col(text_col), F.lit(INK)))
