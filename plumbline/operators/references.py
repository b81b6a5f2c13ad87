"""Joins that check references: anti joins, two-way orphans, reference lists, containment of quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ws_normalize

#: Bytes of quotes sent to every task at most; beyond it, quotes are joined by their seeds in a shuffle.
MOST_SENT = 16 << 20
SEED_WORDS = 3
#: Characters at either side of a space that quotes of two words are looked up by.
START = 4
#: Characters of the words before and after a run of fewer inner words than SEED_WORDS that are in its seed.
EDGE = 2
#: Longs in one block of a table of bits; see _marked().
BLOCK = 1024


def unresolved(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of left whose key is no key of right; a null key resolves to nothing."""
    return left.join(right.select(F.col(right_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def resolved(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of left whose key is a key of right."""
    return left.join(right.select(F.col(right_key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def orphans(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """id, side: keys that are on one side only ('left' or 'right')."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(right_key).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.where("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias("id"), F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


def list_refs(rows: DataFrame, key: str, refs: str) -> DataFrame:
    """key, ref: one row for each member of a list column."""
    return rows.select(F.col(key), F.explode(refs).alias("ref"))


def self_refs(rows: DataFrame, key: str, refs: str) -> DataFrame:
    """Rows that name themselves in their list."""
    return rows.where(F.array_contains(F.col(refs), F.col(key)))


def uncovered(required: DataFrame, word: str, rows: DataFrame, words: str) -> DataFrame:
    """Required words that no row's list holds."""
    return unresolved(required, word, rows.select(F.explode(words).alias("__word")).distinct(), "__word")


def contained(texts: DataFrame, text_id: str, text: str, quotes: DataFrame, quote_id: str, quote: str, most_sent: int = MOST_SENT) -> DataFrame:
    """text_id, quote_id: pairs where the white-space normalised quote occurs in the normalised text as one block.

    A quote's inner words are whole words wherever it occurs, so a run of them,
    with the last characters of the word before and the first of the word after
    it where it is short, is its seed: texts are joined to seeds by equality, and what meets is
    compared, first within these words if they are the whole quote. A quote of
    two words has no inner ones; its first word ends a word of the text and its
    second begins the next, so START characters of either are its seed. One word
    may stand within a word, and is looked up by its first START characters;
    whether such a fragment counts is the caller's rule. An empty quote is in
    every text, and null ones match nothing.

    Every row of texts and of quotes counts by itself, whatever its id. Texts
    meet their candidates again by their hash, so no row that is multiplied holds
    a text. Quotes are sent to every task if they have at most ``most_sent`` bytes,
    and joined by shuffle otherwise, for which a table of bits of the seeds'
    hashes is sent; the rows are the same.
    """
    q = quotes.where(F.col(quote).isNotNull()).select(F.col(quote_id), ws_normalize(F.col(quote)).alias("__quote"))
    keyed = texts.where(F.col(text).isNotNull()).select(F.col(text_id), ws_normalize(F.col(text)).alias("__text")).withColumn("__key", F.xxhash64("__text"))
    hits, few = candidates(keyed, "__key", "__text", q, "__quote", most_sent)
    found = hits.join(keyed, "__key").where(F.contains("__text", F.col("__quote"))).select(text_id, "__quote")
    return found.join(F.broadcast(q) if few else q, "__quote").select(text_id, quote_id)


def holding(texts: DataFrame, text_id: str, text: str, quotes: DataFrame, quote: str, most_sent: int = MOST_SENT) -> DataFrame:
    """text_id, quote: what contained() finds for distinct quotes that are normalised and not empty; pairs may come more than once, and a quote may be none.

    Quotes of three words to SEED_WORDS + 2 are compared where the text's words
    are read, so their pairs do not meet the texts again. What is no quote is in
    the pairs only if a few of its hash's bits are a quote's: for a caller that
    joins the pairs with the quotes.
    """
    whole = F.size(F.split(quote, " ")).between(3, SEED_WORDS + 2)
    flat = texts.where(F.col(text).isNotNull()).select(F.col(text_id), ws_normalize(F.col(text)).alias("__text"))
    found, _ = _met(flat, text_id, "__text", quotes.where(whole), quote, most_sent)
    others = quotes.where(~whole).select(F.col(quote).alias("__id"), quote)
    if others.isEmpty():
        return found
    return found.unionByName(contained(texts, text_id, text, others, "__id", quote, most_sent).select(text_id, F.col("__id").alias(quote)))


def candidates(texts: DataFrame, key: str, text: str, quotes: DataFrame, quote: str, most_sent: int = MOST_SENT) -> tuple[DataFrame, bool]:
    """key, quote: the texts that may hold a quote, each pair once, and all that do; and whether the quotes were few enough to be sent.

    White space must be normalised. Quotes of three words to SEED_WORDS + 2 are
    compared whole here, so that their pairs are right already.
    """
    hits, few = _met(texts, key, text, quotes, quote, most_sent)
    return (hits if few else hits.join(quotes.select(quote), quote, "left_semi").select(key, quote)).distinct(), few


def _met(texts: DataFrame, key: str, text: str, quotes: DataFrame, quote: str, most_sent: int) -> tuple[DataFrame, bool]:
    """As candidates(), but pairs may come more than once, and if the quotes are not few, some of what is whole here is no quote.

    If the quotes are many, a table of bits tells which of the texts' seeds may be
    a quote's, so that the others are not shuffled. What can be a whole quote in
    the words around such a seed is spelled and looked up in two more tables: it is
    not compared with all the quotes that have this seed, of which there are
    the more the more quotes there are.
    """
    q = quotes.select(quote, F.split(quote, " ").alias("__words"))
    q = q.withColumn("__n", F.least(F.size("__words") - 2, F.lit(SEED_WORDS))).withColumn("__at", _run_at(F.col("__words"), F.col("__n")))
    form = F.col("__words"), F.col("__n"), F.col("__at")
    whole = (F.size("__words") - 2).between(1, SEED_WORDS)
    sizes = q.agg(F.sum(F.octet_length(quote) + 16).alias("bytes"), F.count("*").alias("n"), F.collect_set(F.struct("__n", *_edges_of(*form), whole.alias("__all"))).alias("kinds")).first()
    seeds = q.select(quote, _seed_of(*form).alias("__seed"), whole.alias("__all")).distinct()
    few = (sizes["bytes"] or 0) <= most_sent
    words = texts.select(key, F.split(text, " ").alias("__words"))  # a column: what a lambda is given is worked out again for each member
    kinds: dict[int, set[tuple[int, int]]] = {}
    forms: dict[int, set[bool]] = {}
    for run, before, after, all_ in map(tuple, sizes["kinds"]):
        kinds.setdefault(run, set()).add((before, after))
        forms.setdefault(run, set()).add(all_)
    if not kinds:
        kinds, forms = {1: {(1, 1)}}, {1: {True}}

    def met(run: int) -> list[DataFrame]:
        edges = sorted(kinds[run])
        shown = _text_seeds(words, key, run, edges)
        if few:
            both = shown.join(F.broadcast(seeds), "__seed")
            if run > 0:
                both = both.where(~F.col("__all") | F.contains(F.concat_ws(" ", "__run.*"), F.col(quote)))
            return [both.select(key, quote)]
        near = _marked(shown, "__seed", seeds.select("__seed"), sizes["n"], most_sent)
        found = []
        if True in forms[run]:
            found.append(_spelled(near, key, quote, edges, q.where(whole).select(quote, _edges_of(*form)[1].alias("__after")), sizes["n"], most_sent))
        if False in forms[run]:
            found.append(near.select(key, "__seed").join(seeds.where("NOT __all"), "__seed").select(key, quote))
        return found

    return reduce(DataFrame.unionByName, [df for run in sorted(kinds) for df in met(run)]), few


def _marked(rows: DataFrame, name: str, among: DataFrame, n: int, most_sent: int) -> DataFrame:
    """Rows whose hash is one of n others, and of the rest the few (1.4 % of all) that fall on their bits.

    Every hash sets two bits in one block of a table of 16 bits a hash, which is
    sent to every task. It has at most ``most_sent`` bytes, or one block; the more hashes
    there are beyond that, the more rows stay that need not.
    """
    blocks = max(1, min(most_sent // (8 * BLOCK), -(-16 * n // (64 * BLOCK))))
    block = lambda h: F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))
    bits = lambda h: [F.pmod(F.shiftrightunsigned(h, by), F.lit(64 * BLOCK)) for by in (0, 16)]
    own = among.select(block(F.col(name)).alias("__block"), F.explode(F.array(*bits(F.col(name)))).alias("__bit"))
    own = own.select("__block", F.expr("shiftright(__bit, 6)").alias("__long"), F.expr("shiftleft(1L, CAST(__bit % 64 AS INT))").alias("__bits"))
    none = rows.sparkSession.range(blocks * BLOCK).select(F.expr(f"id DIV {BLOCK}").alias("__block"), F.expr(f"id % {BLOCK}").alias("__long"), F.lit(0).cast("long").alias("__bits"))
    longs = own.unionByName(none).groupBy("__block", "__long").agg(F.bit_or("__bits").alias("__bits"))
    table = longs.groupBy("__block").agg(F.array_sort(F.collect_list(F.struct("__long", "__bits")))["__bits"].alias("__table"))
    is_set = lambda bit: F.getbit(F.get("__table", F.shiftright(bit, 6).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1
    met = rows.withColumn("__block", block(F.col(name))).join(F.broadcast(table), "__block")
    a, b = bits(F.col(name))
    return met.where(is_set(a) & is_set(b)).select(*rows.columns)


def _spelled(shown: DataFrame, key: str, quote: str, around: list[tuple[int, int]], whole: DataFrame, n: int, most_sent: int) -> DataFrame:
    """key, quote: what begins in the first and ends in the last of the words around a seed, has the seed's characters, and may be one of whole (quote, __after).

    What begins a quote, up to the seed's characters of its last word, is looked
    up first, so only few first words are combined with each length of the last one.
    """
    first, *inner, last = (F.col("__run")[name] for name in shown.schema["__run"].dataType.names)
    before, after = (F.get(F.array(*(F.lit(pair[side]) for pair in around)), F.col("__kind")) for side in (0, 1))
    lengths = lambda edge, word: F.explode(F.sequence(F.greatest(edge, F.lit(1)), F.when(edge.between(1, EDGE - 1), edge).otherwise(F.length(word))))
    rows = shown.select(key, "__run", after.alias("__after"), lengths(before, first).alias("__x"))
    rows = rows.select(key, last.alias("__last"), "__after", F.concat_ws(" ", F.right(first, F.col("__x")), *inner, F.left(last, F.col("__after"))).alias("__begin"))
    begins = whole.select(F.xxhash64(F.left(quote, F.length(quote) - F.length(F.substring_index(quote, " ", -1)) + F.col("__after"))).alias("__hash"))
    rows = _marked(rows.withColumn("__hash", F.xxhash64("__begin")), "__hash", begins, n, most_sent)
    rows = rows.select(key, "__begin", "__last", "__after", lengths(F.col("__after"), F.col("__last")).alias("__y"))
    rows = rows.select(key, F.concat("__begin", F.substr("__last", F.col("__after") + 1, F.col("__y") - F.col("__after"))).alias(quote))
    return _marked(rows.withColumn("__hash", F.xxhash64(quote)), "__hash", whole.select(F.xxhash64(quote).alias("__hash")), n, most_sent).select(key, quote)


def _run_at(words: Column, run: Column) -> Column:
    """Where the run of inner words begins that is a quote's seed: of all runs of this many that with the most characters, as long words are rare."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 1 - run, F.lit(1)))
    ranked = F.transform(starts, lambda i: F.struct(F.length(F.array_join(F.slice(words, i + 1, F.greatest(run, F.lit(1))), "")).alias("chars"), (-i).alias("at")))
    return -F.array_max(ranked)["at"]


def _edges_of(words: Column, run: Column, at: Column) -> tuple[Column, Column]:
    """How many characters of the words before and after a quote's run are in its seed."""
    edge = lambda i: F.when(run.between(1, SEED_WORDS - 1), F.least(F.length(F.get(words, i)), F.lit(EDGE))).otherwise(0)
    return edge(at - 1).alias("before"), edge(at + run).alias("after")


def _seed_of(words: Column, run: Column, at: Column) -> Column:
    """A quote's seed."""
    a, b = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    seed = F.when(run == -1, F.xxhash64(F.lit(-1), F.left(a, F.lit(START)))).when(run == 0, _edge(a, b, F.least(F.length(a), F.lit(START)), F.least(F.length(b), F.lit(START))))
    for n in range(1, SEED_WORDS + 1):
        seed = seed.when(run == n, _run_seed([F.get(words, at + k) for k in range(-1, n + 1)], *_edges_of(words, run, at)))
    return seed


def _run_seed(words: list[Column], before: Column, after: Column) -> Column:
    """The hash of a run of words, with the last characters of the word before it and the first of the word after."""
    return F.xxhash64(F.lit(len(words) - 2), *words[1:-1], _edge(words[0], words[-1], before, after))


def _edge(before: Column, after: Column, x: Column, y: Column) -> Column:
    """The hash of the last x characters of a word and the first y of the next."""
    return F.xxhash64(x, y, F.right(before, x), F.left(after, y))


def _text_seeds(texts: DataFrame, key: str, inner: int, around: list[tuple[int, int]]) -> DataFrame:
    """key, __seed: what texts (key, __words) hold for quotes with so many inner words; 0: of two words, -1: of one.

    For inner words with as many characters around them as each pair of
    ``around`` says, with the pair's place as __kind, and with __run, all the
    words that are seen.
    """
    words = F.col("__words")
    n = F.size(words)
    if inner > 0:  # neighbours side by side, so that no lambda is evaluated for each word
        zipped = F.arrays_zip(words, *(F.slice(words, k + 1, F.greatest(n, F.lit(1))) for k in range(1, inner + 2)))
        rows = texts.select(key, F.explode(zipped).alias("__run"))
        parts = [F.col("__run")[name] for name in rows.schema["__run"].dataType.names]
        long_enough = lambda x, y: (F.length(parts[0]) >= x) & (F.length(parts[-1]) >= y)
        seeds = [F.when(long_enough(x, y), _run_seed(parts, F.lit(x), F.lit(y))) for x, y in around]
        return rows.where(parts[-1].isNotNull()).select(key, "__run", F.posexplode(F.array(*seeds)).alias("__kind", "__seed"))

    def edges(i):
        a, b = F.get(words, i), F.get(words, i + 1)
        lengths = [(x, y) for x in range(1, START + 1) for y in range(1, START + 1)]
        return F.array(*(F.when((F.length(a) >= x) & (F.length(b) >= y), _edge(a, b, F.lit(x), F.lit(y))) for x, y in lengths))

    def starts(w):
        places = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
        return F.flatten(F.transform(places, lambda i: F.array(*(F.xxhash64(F.lit(-1), F.substring(w, i, F.lit(k))) for k in range(START + 1)))))

    if inner == 0:
        seeds = F.when(n > 1, F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), edges))))
    else:
        seeds = F.flatten(F.transform(F.array_distinct(words), starts))
    return texts.select(key, F.explode(F.array_distinct(seeds)).alias("__seed"))


def seal_states(cards: DataFrame, source: str, body: str, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Cards with seal: whether the body stands in the text of the card's source.

    sealed: as one block, white space aside; split-block: all its lines are there
    but not together; mismatch; fragment: one word at most; empty; unavailable:
    there is no such text, so nothing was checked. Joined on the source, so
    only one text is searched for each card.
    """
    own = texts.select(F.col(text_id).alias("__source"), ws_normalize(F.col(text)).alias("__text"), F.lit(True).alias("__there"))
    quote = ws_normalize(F.coalesce(F.col(body), F.lit("")))
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(body), F.lit("")), "\n"), ws_normalize), lambda x: x != "")
    state = (
        F.when(quote == "", "empty")
        .when(F.col("__there").isNull() | F.col("__text").isNull(), "unavailable")
        .when(~F.contains(quote, F.lit(" ")), "fragment")
        .when(F.contains("__text", quote), "sealed")
        .when(F.forall(lines, lambda x: F.contains("__text", x)), "split-block")
        .otherwise("mismatch")
    )
    return cards.join(own, F.col(source) == F.col("__source"), "left").select(*cards.columns, state.alias("seal"))
