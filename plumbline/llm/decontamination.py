"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some positions of a short window and ignores the rest. Words of
benchmark items and of documents are hashed through the same masks and joined on
the hashes; around each hit the two texts are laid side by side and compared
word by word, so substituted words between the looked-at positions do no harm.

An overlap is a stretch of WINDOW aligned words (of a whole item, if that is
shorter) of which at least SHARE are equal. The masks are chosen so that each
such stretch of WINDOW words contains a hit; shorter ones are covered down to
items of MIN_WORDS words, see ``masks_for``.

A benchmark of bounded size is sent to every task, which joins within its own
memory while it reads the documents. A larger one is joined by shuffle: its seeds
are a table, a filter of fixed size keeps most document seeds from travelling,
and what meets is verified text by text. Both give the same rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import LOWER, Rows, pieces, rows_where, stored, trimmed, words_of

#: Aligned words that are compared, and how many in a hundred must be equal.
WINDOW = 13
SHARE = 80
#: Positions that a mask looks at. Every 13 words with 2 substitutions have a hit of one of them.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Items of fewer words overlap with nothing: such word sequences are found in any text.
MIN_WORDS = 8
#: Bytes of benchmark text that are sent to every task at most; a larger benchmark is joined by shuffle.
MOST_SENT = 8 << 20
#: Bits, as a power of two, of the filter that document seeds pass before a shuffle.
FILTER_BITS = 26
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Bits of the table that tells most positions without a hit apart.
TABLE_BITS = 22


def tokens(text: str | None) -> list[str]:
    """Words, lower-cased in A-Z, without ASCII punctuation at either end; those of nothing else are left out."""
    return [w for w in (w.strip(PUNCTUATION) for w in words_of((text or "").translate(LOWER))) if w]


def lossless(masks, window: int, substitutions: int) -> bool:
    """Whether every window with so many substituted words has a place where a mask sees none of them."""
    places = [frozenset(at + m for m in mask) for mask in masks for at in range(window - mask[-1])]
    return all(any(not p.intersection(bad) for p in places) for bad in itertools.combinations(range(window), substitutions))


def allowed(n: int, share: int = SHARE) -> int:
    """Words that may differ in a stretch of n."""
    return n - -(-share * n // 100)


def masks_for(n: int, share: int = SHARE):
    """Masks that find every overlap with an item of n words, n below WINDOW.

    A run of n // (allowed + 1) equal words is always there; the mask is such a run, of 4 words at most.
    """
    return (tuple(range(max(1, min(4, n // (allowed(n, share) + 1))))),)


def mixed(v: np.ndarray, mask: tuple) -> np.ndarray:
    """The mask's hash at each place of a sequence of word values."""
    n = max(0, len(v) - mask[-1])
    out = np.full(n, sum(1 << m for m in mask), np.uint64)
    for m in mask if n else ():
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ v[m : m + n]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def masks_of(n: int, window: int, share: int):
    return MASKS if n >= window else masks_for(n, share)


def beside(own: np.ndarray, theirs: np.ndarray, shift: int, window: int, share: int) -> tuple[int, int, int, int] | None:
    """(start in own, start in theirs, words, equal words): from the first window that is alike enough to the last, with the item laid ``shift`` words into own."""
    first, last = max(0, -shift), min(len(theirs), len(own) - shift)
    w = min(window, len(theirs))
    if last - first < w:
        return None
    same = (own[first + shift : last + shift] == theirs[first:last]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(100 * (sums[w:] - sums[:-w]) >= share * w)
    if not len(good):
        return None
    lo, hi = int(good[0]), int(good[-1]) + w
    return first + shift + lo, first + lo, hi - lo, int(sums[hi] - sums[lo])


class Index:
    """The seeds of some benchmark items, for search in one document after the other."""

    def __init__(self, items: list[tuple], window: int, share: int):
        self.window, self.share = window, share
        self.names = [name for name, _ in items]
        self.words: dict[str, int] = {}
        for _, own in items:
            for w in own:
                self.words.setdefault(w, len(self.words) + 1)
        self.items = [np.array([self.words[w] for w in own], np.int64) for _, own in items]
        # words unknown here have the value 0 and find nothing but themselves
        self.value = np.concatenate([[0], np.random.default_rng(20).integers(1, 2**64, len(self.words), np.uint64)]).astype(np.uint64)
        seeds: dict[tuple, list] = {}
        for i, own in enumerate(self.items):
            for mask in masks_of(len(own), window, share):
                if len(own) > mask[-1]:
                    seeds.setdefault(mask, []).append((i, mixed(self.value[own], mask)))
        self.seeds = {}
        for mask, lists in seeds.items():
            h = np.concatenate([x for _, x in lists])
            where = np.concatenate([np.stack([np.full(len(x), i), np.arange(len(x))], 1) for i, x in lists])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.seeds[mask] = h[order], where[order], table

    def search(self, own: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, start in own, start in item, words, equal words) of the overlaps, one for each item and diagonal."""
        pairs = set()
        for mask, (h, where, table) in self.seeds.items():
            got = mixed(self.value[own], mask)  # empty for a text shorter than the mask
            at = np.flatnonzero(table[(got >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(h, got[at]), np.searchsorted(h, got[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for item, q in where[a:b].tolist():
                    pairs.add((item, p - q))
        found = ((item, beside(own, self.items[item], shift, self.window, self.share)) for item, shift in pairs)
        return [(item, *got) for item, got in found if got]


class Search:
    """Searches whole texts; remembers the words that it has seen."""

    def __init__(self, index: Index):
        self.index, self.raw = index, {}

    def __call__(self, text: str) -> list[tuple[int, int, int, int, int]]:
        words = words_of(text)
        if len(self.raw) > 300_000:
            self.raw.clear()
        for w in set(words).difference(self.raw):
            bare = w.translate(LOWER).strip(PUNCTUATION)
            self.raw[w] = self.index.words.get(bare, 0) if bare else -1
        ids = np.fromiter(map(self.raw.__getitem__, words), np.int64, len(words))
        ids = ids[ids >= 0]  # words of punctuation alone don't count
        return self.index.search(ids) if ids.any() else []


class Values:
    """64-bit hashes of a text's words; remembers some."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        own = tokens(text)
        if len(self.known) > 300_000:
            self.known.clear()
        for w in set(own).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(self.known.__getitem__, own), np.uint64, len(own))


def _given(benchmark: DataFrame, item_col: str, text_col: str, most_sent: int, min_words: int) -> list[tuple] | None:
    """Items as (id, words) if all have at most ``most_sent`` bytes, else nothing."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    if (rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > most_sent:
        return None
    items = ((name, tokens(text)) for name, text in rows.collect())
    return [(name, own) for name, own in items if len(own) >= min_words]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = SHARE, most_sent: int = MOST_SENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Overlaps of documents with benchmark items: doc_id, item_id, doc_start, item_start, n_words, n_equal.

    One row for each document, item and diagonal (place of the item relative to
    the document) with an overlap; it reaches from the first window that is alike
    enough to the last one, and what lies between two of them is included. Starts
    count words. Clean documents have no row. Items of fewer than ``min_words``
    words overlap with nothing, as such sequences are found in any text.

    Null and empty texts and items overlap with nothing; rows with null or
    repeated ids are compared like others; other columns are not carried. Where
    the benchmark is joined by shuffle, words and texts are told apart by 64-bit
    hashes.
    """
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, doc_start long, item_start long, n_words long, n_equal long"
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _given(benchmark, item_col, item_text_col, most_sent, min_words)
    if items is None:
        found = _joined(own.select("text"), benchmark, item_col, item_text_col, window, share, min_words)
        return own.select("doc_id", F.xxhash64("text").alias("mark")).join(found, "mark").select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal")
    sent, item_type = docs.sparkSession.sparkContext.broadcast(items), to_arrow_type(kinds[1])

    def run(batches):
        find = Search(Index(sent.value, window, share))
        for batch in pieces(batches):
            rows = Rows(pa.schema([("doc_id", batch.schema.types[0]), ("item_id", item_type), *((c, pa.int64()) for c in ("doc_start", "item_start", "n_words", "n_equal"))]))
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item, doc_start, item_start, n, equal in find(text or ""):
                    rows.add(doc_id, find.index.names[item], doc_start, item_start, n, equal)
            yield rows.batch()

    return own.mapInArrow(trimmed(run), schema)


def _joined(texts: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, share: int, min_words: int) -> DataFrame:
    """mark (hash of a text), item_id, doc_start, item_start, n_words, n_equal: the overlaps of different texts, by a shuffle join of seeds."""
    spark = texts.sparkSession
    items = stored(benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.monotonically_increasing_id()), "items")

    def sow(batches):
        values = Values()
        for batch in pieces(batches):
            out = Rows(pa.schema([("key", pa.int64()), ("seed", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = values(text)
                for mask in masks_of(len(own), window, share) if len(own) >= min_words else ():
                    for at, h in enumerate(mixed(own, mask).view(np.int64).tolist()):
                        out.add(key, h, at, min(len(own), window))
                    if out.full:
                        yield out.batch()
            yield out.batch()

    seeds = stored(items.select("key", "text").mapInArrow(trimmed(sow), "key long, seed long, at long, n long"), "seeds")
    masks = sorted({mask for r in seeds.select("n").distinct().collect() for mask in masks_of(r[0], window, share)})  # a row for each length up to the window
    cells = seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("cell"))
    words = cells.groupBy(F.expr("shiftright(cell, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 31 as int)))").alias("bits")).toArrow()  # of a fixed size at most
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast((table, masks))

    def reap(batches):
        values, (table, masks) = Values(), sent.value
        for batch in pieces(batches):
            out = Rows(pa.schema([("mark", pa.int64()), ("seed", pa.int64()), ("place", pa.int64())]))
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = values(text)
                for mask in masks:
                    got = mixed(own, mask)
                    cell = (got >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    for at in np.flatnonzero(table[cell >> 5] >> (cell & 31).astype(np.uint32) & 1).tolist():
                        out.add(mark, int(got[at].view(np.int64)), at)
                    if out.full:
                        yield out.batch()
            yield out.batch()

    marked = texts.where("text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
    hits = marked.select("mark", "text").mapInArrow(trimmed(reap), "mark long, seed long, place long").join(seeds.select("seed", "key", "at"), "seed")
    near = stored(hits.select("mark", "key", (F.col("place") - F.col("at")).alias("shift")).distinct(), "near")
    pairs = near.join(items.select("key", F.col("text").alias("item")), "key").select("mark", F.lit(1).alias("side"), "key", "shift", F.col("item").alias("text"))
    once = marked.join(near.select("mark").distinct(), "mark", "left_semi").dropDuplicates(["mark"])
    both = pairs.unionByName(once.select("mark", F.lit(0).alias("side"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("shift"), "text"))

    def verify(batches):
        values, mark, own, key, theirs = Values(), None, None, None, None
        for batch in pieces(batches, 200):
            out = Rows(pa.schema([("mark", pa.int64()), ("key", pa.int64()), *((c, pa.int64()) for c in ("doc_start", "item_start", "n_words", "n_equal"))]))
            for now, side, item, shift, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if side == 0:
                    mark, own, key = now, values(text), None
                    continue
                if item != key:
                    key, theirs = item, values(text)
                if mark == now and (got := beside(own, theirs, shift, window, share)):
                    out.add(mark, key, *got)
            yield out.batch()

    # a text stands before its candidates
    ordered = both.repartition("mark").sortWithinPartitions("mark", "side", "key")
    found = ordered.mapInArrow(trimmed(verify), "mark long, key long, doc_start long, item_start long, n_words long, n_equal long")
    return found.join(items.select("key", "item_id"), "key").select("mark", "item_id", "doc_start", "item_start", "n_words", "n_equal")


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = SHARE, most_sent: int = MOST_SENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, all columns, that overlap with no benchmark item; see overlaps(). Rows are judged one by one, whatever their ids."""
    items = _given(benchmark, item_col, item_text_col, most_sent, min_words)
    if items is None:
        text = F.col(text_col).cast("string")
        found = stored(_joined(docs.select(text.alias("text")), benchmark, item_col, item_text_col, window, share, min_words).select(F.col("mark").alias("__found")).distinct(), "found")
        return docs.join(found, F.xxhash64(text) == F.col("__found"), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def decide():
        find = Search(Index(sent.value, window, share))
        return lambda texts: [not find(t) for t in texts]

    return rows_where(docs, text_col, decide) if items else docs
