"""Spelling variants by forward and backward minimal acyclic automata with word numbers.

Two words that differ by one character agree in one half of either: the error
lies in the other. The forward automaton follows a word's first half exactly and
completes it with one error; the backward automaton does the same from the end.
Walking an automaton adds up a word's number, which leads to its count.

The vocabulary is dealt to blocks of bounded size, ranges of the words and of the
reversed words; each has an automaton of its own. A word goes to the blocks that
can hold words with its half; what it finds there is folded at once, so pairs
are never rows.
"""

from __future__ import annotations

import bisect
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Rows, ascii_lower, dropped, stored, trimmed

#: A word of a text whose A-Z are lower-cased.
LETTERS = r"[a-zÀ-ÿ]+"
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One run of so many loses a character, as noise that repeats from run to run.
NOISE = 97
#: A form must be so many times as frequent.
TIMES = 2
#: Code points in a block, about; an automaton takes some 100 bytes for each.
BLOCK_LETTERS = 300_000
FOUND = "word string, n long, n_near long, form string, form_n long"


class Automaton:
    """The minimal acyclic automaton of distinct words given in order; a word's number is its place among them."""

    def __init__(self, words):
        self.edges: list[dict[str, tuple[int, int]]] = []  # of each state: character -> (state, words before)
        self.ends: list[bool] = []
        self.sizes: list[int] = []  # words from a state on
        self.known: dict[tuple, int] = {}
        open_ends, open_edges, last = [False], [[]], ""
        for word in words:
            same = len(os.path.commonprefix((last, word)))
            self._close(open_ends, open_edges, last, same)
            open_ends += [False] * (len(word) - same)
            open_edges += [[] for _ in range(len(word) - same)]
            open_ends[-1] = True
            last = word
        self._close(open_ends, open_edges, last, 0)
        self.start = self._state(open_ends[0], open_edges[0])
        self.known = {}

    def _close(self, ends: list, edges: list, last: str, depth: int) -> None:
        """Settles the states of the last word below a depth."""
        for i in range(len(last), depth, -1):
            edges[i - 1].append((last[i - 1], self._state(ends.pop(), edges.pop())))

    def _state(self, end: bool, edges: list) -> int:
        key = end, *edges
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.edges)
            table, before = {}, int(end)
            for c, child in edges:
                table[c] = child, before
                before += self.sizes[child]
            self.edges.append(table)
            self.ends.append(end)
            self.sizes.append(before)
        return state

    def _rest(self, state: int, number: int, word: str, i: int) -> int:
        """The number of the word that goes on from a state as word[i:], or -1."""
        for c in word[i:]:
            step = self.edges[state].get(c)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.ends[state] else -1

    def number(self, word: str) -> int:
        """The number of a word, or -1."""
        return self._rest(self.start, 0, word, 0)

    def completed(self, word: str, exact: int) -> list[int]:
        """The numbers of all words that begin as the first ``exact`` characters and then differ from word by one, each once."""
        state, number, edges, rest, out = self.start, 0, self.edges, self._rest, []
        for c in word[:exact]:
            step = edges[state].get(c)
            if step is None:
                return out
            state, number = step[0], number + step[1]
        size = len(word)
        for i in range(exact, size + 1):
            own = word[i] if i < size else None
            for c, (child, before) in edges[state].items():
                if c != own:  # of equal neighbours, one is put in behind the last
                    if own is not None:
                        out.append(rest(child, number + before, word, i + 1))
                    out.append(rest(child, number + before, word, i))
            if own is None:
                break
            if i + 1 == size or word[i + 1] != own:  # of equal neighbours, the last is left out
                out.append(rest(state, number, word, i + 1))
            step = edges[state].get(own)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return [x for x in out if x >= 0]


def may_meet(word: str, exact: int, common: str) -> bool:
    """Whether a word that begins as ``common`` can begin as word[:exact] and then differ from word by one."""
    same = len(os.path.commonprefix((word, common)))
    if same < min(exact, len(common)):
        return False
    if same == len(common):
        return True
    if same == len(word):
        return len(common) == len(word) + 1
    behind = common[same + 1 :]
    return word.startswith(behind, same + 1) or word.startswith(common[same:], same + 1) or word.startswith(behind, same)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: the words of all texts with their counts, combined in each task before they move.

    Where ``noise`` divides h, the crc32 of `<id>:<run>`, the character h % length
    of the run is left out. A null id is written as nothing.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(LETTERS), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.where(F.length("run") >= least_letters).select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    return counted(each.select(without_one(F.col("run"), F.col("h"), noise).alias("word")), least_letters, least_count)


def without_one(run: Column, h: Column, noise: int) -> Column:
    """The run, without its character h % length where ``noise`` divides h."""
    at = (h % F.length(run)).cast("int")
    return F.when(h % noise != 0, run).otherwise(F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run))))


def counted(words: DataFrame, least_letters: int, least_count: int) -> DataFrame:
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _blocks(words: DataFrame, n_blocks: int, first: int) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """key, n, block of words in ranges of their keys, and (least key, greatest key, block) of each block."""
    ranged = words.repartitionByRange(n_blocks, "key").withColumn("block", F.spark_partition_id() + first)
    rows = stored(ranged, "vocabulary")
    return rows, sorted(tuple(r) for r in rows.groupBy("block").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).select("lo", "hi", "block").collect())


def near_words(words: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Every word of (word, n; distinct, not null): n_near, and form and form_n, the near word of the largest n (ties: the smallest).

    Near words differ by exactly one character that is put in, left out or
    replaced. A word without near words has n_near 0 and null form. No rows give
    no rows. Words of any length are searched without recursion.
    """
    given = words.select("word", "n")
    letters = given.agg(F.sum(F.length("word"))).first()[0] or 0
    n_blocks = max(1, -(-letters // block_letters))
    ahead, ahead_ends = _blocks(given.select(F.col("word").alias("key"), "n"), n_blocks, 0)
    back, back_ends = _blocks(given.select(F.reverse("word").alias("key"), "n"), n_blocks, 1 << 20)

    def routed(batches):
        """Each word, read ahead and back, for each block that can hold words near it."""
        plans = [([e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends], [os.path.commonprefix(e[:2]) for e in ends]) for ends in (ahead_ends, back_ends)]
        for batch in batches:
            at, keys, blocks = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                half = len(word) // 2
                for key, exact, (lows, highs, names, commons) in ((word, half, plans[0]), (word[::-1], len(word) - half, plans[1])):
                    head = key[:exact]
                    b = bisect.bisect_left(highs, head)
                    while b < len(lows) and (lows[b] <= head or lows[b].startswith(head)):
                        if may_meet(key, exact, commons[b]):
                            at.append(i)
                            keys.append(key)
                            blocks.append(names[b])
                        b += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(1).take(pa.array(at, pa.int64())), pa.array(blocks, pa.int32())], names=["key", "n", "block"])

    def searched(batches):
        now, automaton = None, None
        keys: list[str] = []
        counts: list[int] = []
        rows = Rows(pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())]))
        for batch in batches:
            for key, n, block, asks in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != now:
                    now, keys, counts, automaton = block, [], [], None
                if not asks:
                    keys.append(key)
                    counts.append(n)
                    continue
                if automaton is None:
                    automaton = Automaton(keys)
                size, backward = len(key), block >= 1 << 20
                half = size // 2
                found = automaton.completed(key, size - half if backward else half)
                word = key[::-1] if backward else key
                if backward:  # what has the first half as well was found ahead
                    head = key[size - half :]
                    found = [x for x in found if keys[x][len(keys[x]) - half :] != head]
                best = min(((-counts[x], keys[x][::-1] if backward else keys[x]) for x in found), default=None)
                rows.add(word, n, len(found), best and best[1], best and -best[0], size=2 * size + 40)
                if rows.full:
                    yield rows.batch()
        if rows.columns[0]:
            yield rows.batch()

    asked = given.mapInArrow(trimmed(routed), "key string, n long, block int").withColumn("asks", F.lit(True))
    held = ahead.unionByName(back).withColumn("asks", F.lit(False))
    dealt = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks", "key")
    parts = dealt.mapInArrow(trimmed(searched), FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    merged = stored(parts.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best")), "near-words")
    dropped(ahead, back)
    return merged.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, most_rounds: int = 60) -> DataFrame:
    """word, root of (word, form; words distinct, forms without a circle): the last word on the way along forms.

    Each round doubles the way that a row has gone, so rounds grow with the
    logarithm of the longest way.
    """
    now = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "roots")
        dropped(now)
        if new.where("went").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")
        now._plumbline_path = new._plumbline_path
    raise RuntimeError(f"forms did not settle in {most_rounds} rounds; is there a circle?")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int = NOISE, times: int = TIMES, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Every word of the texts: word, form, root, n, n_near, form_n.

    form is a word's most frequent near word (ties: the smallest in code-point
    order) if it is ``times`` as frequent at least, else null, and form_n its n.
    root is where forms lead in the end; a word without a form is its own root.

    Null and empty texts have no words; repeated rows count each time; a null id
    is written as nothing where noise is drawn. No rows give no rows. Columns of
    the input may have any names. Texts of any length are read whole.
    """
    words = stored(word_counts(docs, id_col, text_col, least_letters, least_count, noise), "words")
    near = near_words(words, block_letters)
    fit = F.col("form_n") >= times * F.col("n")
    rows = near.select("word", "n", "n_near", F.when(fit, F.col("form")).alias("form"), F.when(fit, F.col("form_n")).alias("form_n"))
    out = rows.join(roots(rows), "word", "left")
    dropped(words)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
