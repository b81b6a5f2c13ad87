"""N-gram Jaccard join by prefix trees.

Sets of hashed word n-grams are stored in the global order of their hashes in
radix trees. A set traverses the tree: overlaps of shared paths are counted once
for all sets below, and a subtree is left when what remains of it, or of the
set, can't reach the overlap that its sizes need.

Which sets meet in a tree: documents with equal sets are one class. All hashes
are split into parts, more of them than two linking sets can differ in elements;
by the pigeonhole principle such sets agree in a part that is not empty. Classes
that agree in a part are compared by the parities of their elements' cells, of
which no two differ in more cells than in elements; those that may link form
groups. Every true link lies within a group. Parts and groups are read one by
one, and large ones in pairs of blocks, so no task holds an unbounded group and
no link is lost.
"""

from __future__ import annotations

import bisect
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import connected
from .shared import LOWER, Rows, dropped, pieces, stored, trimmed, words_of

#: Sets of a tree at most; a group with more is compared in pairs of blocks of half as many.
MOST_SETS = 1_000
#: Elements of a tree's sets at most (twice that in a pair of blocks).
MOST_ELEMENTS = 1_500_000
#: Cells, at least, whose parities tell classes that can't link apart.
CELLS = 1_024
#: Classes that agree in a part and are compared so in one task; more are compared in pairs of blocks of half as many.
MOST_NEAR = 2_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word; ``known`` remembers some."""
    import xxhash

    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > 200_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, n: int, known: dict[str, int] | None = None) -> np.ndarray:
    """The distinct hashes of a text's word n-grams, ascending; of all its words if they are fewer."""
    words = words_of((text or "").translate(LOWER) if text and not text.islower() else text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, {} if known is None else known)
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total = mix(total * _M1 + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def class_of(own: np.ndarray) -> int:
    """A hash of the whole set, as a signed long."""
    total = np.append(mix(own), np.uint64(len(own))).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total).view(np.int64)[0])


def needed(a: int, b: int, num: int, den: int) -> int:
    """The least intersection of sets of sizes a and b whose Jaccard similarity is num / den or more."""
    return -(-num * (a + b) // (num + den))


def band(size: int, num: int, den: int, edges: list[int]) -> int:
    """The number of the size band; sizes that can link lie in the same band or in neighbours."""
    while edges[-1] <= size:
        edges.append(edges[-1] * den // num + 1)
    return bisect.bisect_right(edges, size) - 1


def differing(a: int, b: int, num: int, den: int) -> int:
    """The most elements in which sets of sizes a and b that link can differ."""
    return a + b - 2 * needed(a, b, num, den)


def split_of(low: int, num: int, den: int, edges: list[int], known: dict) -> tuple[int, int]:
    """(parts, most): parts that the sets of band ``low`` and the next are split into, and the most elements that two differ in.

    So many parts that nearly all sets have elements in more than ``most`` of them.
    """
    if low not in known:
        while len(edges) <= low + 2:
            edges.append(edges[-1] * den // num + 1)
        most = int(Fraction(2 * (edges[low + 2] - 1) * (den - num), den + num))
        parts = most + 1
        while parts < 2 * most + 3 and most:
            empty = math.exp(-edges[low] / parts)
            if parts * (1 - empty) - 2 * math.sqrt(parts * empty) >= most + 1:
                break
            parts += 1
        known[low] = parts, most
    return known[low]


def signatures(own: np.ndarray, num: int, den: int, edges: list[int], known: dict) -> np.ndarray:
    """A hash for each part of the set, in the splits that its size band shares with either neighbour.

    Empty parts count only for a set with too few others to be sure of an agreement.
    """
    b = band(len(own), num, den, edges)
    out = []
    scrambled = mix(own * _M2 + _M3)
    for low in (b - 1, b):
        if low < 0:
            continue
        parts, most = split_of(low, num, den, edges, known)
        which = ((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1])  # own ascends, so parts are runs of it
        filled, sums = which[starts], np.add.reduceat(scrambled, starts)
        if len(filled) <= most:
            every = np.zeros(parts, np.uint64)
            every[filled] = sums
            filled, sums = np.arange(parts), every
        place = filled.astype(np.uint64) * _M1 + np.full(1, low, np.uint64) * _M2
        out.append(mix(sums ^ mix(place)))
    return np.concatenate(out)


def parities(own: np.ndarray) -> bytes:
    """The parity of the number of elements in each cell; so many cells that unlike sets of this size differ in enough of them."""
    cells = CELLS
    while cells < 0.75 * len(own):
        cells *= 2
    odd = np.bincount((mix(own ^ _M3) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities with fewer cells: of both halves together, again and again."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(names: list[int], sizes: list[int], cells: list[bytes], num: int, den: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that connect at least the classes that link; pairs that are connected already are not compared.

    With ``sides``, pairs within a side are compared elsewhere.
    """
    n = len(names)
    side = None if sides is None else np.array(sides)
    size, own, out = np.array(sizes), np.arange(n), []
    words = np.array([len(c) // 8 for c in cells])
    #: for each number of cells the members that have so many or more, at that number
    levels = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words >= w)
        table = np.zeros((n, w), np.uint64)
        for v in np.unique(words[at]).tolist():
            same = np.flatnonzero(words == v)
            table[same] = folded(np.frombuffer(b"".join(cells[i] for i in same), np.uint64).reshape(len(same), v), w)
        levels[w] = table
    for i in range(n - 1):
        apart = own[i + 1 :] != own[i]
        if side is not None:
            apart &= side[i + 1 :] != side[i]
        rest = i + 1 + np.flatnonzero(apart)
        if not len(rest):
            continue
        total = size[rest] + size[i]
        most = total - 2 * -(-num * total // (num + den))
        close = np.abs(size[rest] - size[i]) <= most
        rest, most = rest[close], most[close]
        for w, table in levels.items():
            some = np.minimum(words[rest], words[i]) == w
            if not some.any():
                continue
            near = rest[some][np.bitwise_count(table[rest[some]] ^ table[i]).sum(1) <= most[some]]
            for j in near.tolist():
                if own[j] != own[i]:
                    out.append((names[i], names[j]))
                    own[own == own[j]] = own[i]
    return out


class Node:
    """A path of hashes shared by the sets below, whose sizes are between low and high."""

    __slots__ = ("path", "next", "sets", "low", "high")

    def __init__(self, path, size):
        self.path, self.next, self.sets, self.low, self.high = path, {}, [], size, size


class Tree:
    """A radix tree of ascending tuples, searched and filled in turn."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.top = Node((), 0)
        self.top.low = 1 << 60

    def add(self, own: tuple, name: int) -> None:
        node, at, size = self.top, 0, len(own)
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == size:
                node.sets.append(name)
                return
            child = node.next.get(own[at])
            if child is None:
                new = Node(own[at:], size)
                new.sets.append(name)
                node.next[own[at]] = new
                return
            path, same = child.path, 1
            limit = min(len(path), size - at)
            while same < limit and path[same] == own[at + same]:
                same += 1
            if same < len(path):
                upper = Node(path[:same], child.low)
                upper.high = child.high
                child.path = path[same:]
                upper.next[child.path[0]] = child
                node.next[own[at]] = upper
                child = upper
            node, at = child, at + same

    def search(self, own: tuple, skip) -> list[int]:
        """Names of the sets that link with own; skip(name) leaves a set out."""
        num, den, a, every, found = self.num, self.den, len(own), frozenset(own), []
        stack = [(child, 0, 0, 0) for child in self.top.next.values()]  # with overlap, missed and depth above
        while stack:
            node, overlap, missed, depth = stack.pop()
            if not node.next and all(map(skip, node.sets)):
                continue
            got = len(every.intersection(node.path))
            overlap, missed, depth = overlap + got, missed + len(node.path) - got, depth + len(node.path)
            # of the tree's sets at most so many elements may be missing in own, and the other way round
            if missed > node.high - needed(a, node.high, num, den):
                continue
            passed = bisect.bisect_right(own, node.path[-1]) - overlap
            if passed > a - needed(a, node.low, num, den):
                continue
            if node.sets and overlap >= needed(a, depth, num, den):
                found += [s for s in node.sets if not skip(s)]
            for child in node.next.values():
                stack.append((child, overlap, missed, depth))
        return found


def links(names: list[int], sets: list[tuple], num: int, den: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that connect just the sets whose links (chains included) connect them.

    With ``sides``, links within a side are known elsewhere and need not be found.
    """
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    tree, out = Tree(num, den), []
    for i in sorted(range(len(names)), key=lambda i: len(sets[i])):
        for j in tree.search(sets[i], lambda j: root(j) == root(i) or (sides is not None and sides[j] == sides[i])):
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((names[i], names[j]))
        tree.add(sets[i], i)
    return out


def linked(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: tuple[int, int], most_sets: int = MOST_SETS, most_near: int = MOST_NEAR) -> DataFrame:
    """Every row: doc_id, mark (hash of the text), n_shingles, root; rows with one root are connected by links, null is an empty set."""
    num, den = similarity
    kind = docs.schema[id_col].dataType
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tagged = own.withColumn("mark", F.xxhash64("text"))

    def sign(batches):
        edges, seen, known, heard = [1], set(), {}, {}
        for batch in pieces(batches):
            rows = Rows(pa.schema([("doc_id", batch.schema.types[0]), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("parts", pa.list_(pa.int64())), ("cells", pa.binary())]))
            for doc_id, text, mark in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = shingles(text, n, heard)
                if not len(s):
                    rows.add(doc_id, mark, 0, None, None, None)
                    continue
                name = class_of(s)
                parts = cells = None
                if name not in seen:  # a class needs its parts from a task once
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    parts, cells = signatures(s, num, den, edges, known).view(np.int64), parities(s)
                rows.add(doc_id, mark, len(s), name, parts, cells, size=64 + 8 * (0 if parts is None else len(parts)))
                if rows.full:
                    yield rows.batch()
            yield rows.batch()

    signed = stored(tagged.mapInArrow(trimmed(sign), f"doc_id {kind.simpleString()}, mark long, n_shingles long, class long, parts array<long>, cells binary"), "signed")

    # classes that agree in a part with others
    by_part = signed.where("parts IS NOT NULL").select("class", F.explode("parts").alias("part"))
    alike = Window.partitionBy("part")
    before = F.lag("class").over(alike.orderBy("class"))
    met = by_part.select("part", "class", before.alias("before"), (F.min("class").over(alike) != F.max("class").over(alike)).alias("several"), F.count("*").over(alike).alias("many"))
    blocks = F.when(F.col("many") <= most_near, 1).otherwise(F.ceil(2 * F.col("many") / most_near)).cast("int")
    met = stored(met.where("several AND (before IS NULL OR before <> class)").select("part", "class", blocks.alias("blocks")), "met")
    about = signed.where("parts IS NOT NULL").select("class", "n_shingles", "cells")
    dealt = in_pairs(met.join(about, "class"), "part").select("part", "low", "high", "class", "block", "n_shingles", "cells")
    dealt = dealt.repartition("part", "low", "high").sortWithinPartitions("part", "low", "high", "class")

    def compare(batches):
        key, last = None, None
        names, sizes, cells, sides = [], [], [], []

        def edges():
            found = may_link(names, sizes, cells, num, den, sides if key[1] != key[2] else None) if len(names) > 1 else []
            return pa.RecordBatch.from_pydict({"src": pa.array([f[0] for f in found], pa.int64()), "dst": pa.array([f[1] for f in found], pa.int64())})

        for batch in batches:
            for part, low, high, name, side, size, own in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (part, low, high) != key:
                    if names:
                        yield edges()
                    key, last, names, sizes, cells, sides = (part, low, high), None, [], [], [], []
                if name != last:  # a class may come from several tasks
                    last = name
                    names.append(name)
                    sizes.append(size)
                    cells.append(own)
                    sides.append(side)
        if names:
            yield edges()

    near = dealt.mapInArrow(trimmed(compare), "src long, dst long")
    groups = connected(near)  # node, root

    # one document stands for each class of a group
    spokes = signed.select("doc_id", "mark", "n_shingles", "class").join(groups.select(F.col("node").alias("class"), F.col("root").alias("group")), "class")
    chosen = stored(spokes.groupBy("class").agg(F.min("group").alias("group"), F.max("n_shingles").alias("n"), F.min(F.struct("doc_id", "mark")).alias("k")).select("class", "group", "n", F.col("k.doc_id").alias("id"), F.col("k.mark").alias("of")), "chosen")
    sizes = stored(chosen.groupBy("group").agg(F.count("*").alias("size"), F.sum("n").alias("elements")), "sizes")
    small = (F.col("size") <= most_sets) & (F.col("elements") <= MOST_ELEMENTS)
    blocks = F.when(small, 1).otherwise(F.ceil(2 * F.greatest(F.col("size") / most_sets, F.col("elements") / MOST_ELEMENTS)))
    placed = stored(chosen.join(sizes, "group").withColumn("blocks", F.least(blocks, F.col("size")).cast("int")), "placed")

    def tuples(batches):
        heard: dict[str, int] = {}
        for batch in pieces(batches):
            cols = [batch.column(i).to_pylist() for i in range(4)]
            rows = Rows(pa.schema([("class", pa.int64()), ("group", pa.int64()), ("blocks", pa.int32()), ("set", pa.binary())]))
            for name, group, blocks, text in zip(*cols):
                data = shingles(text, n, heard).tobytes()
                rows.add(name, group, blocks, data, size=len(data) + 32)
                if rows.full:
                    yield rows.batch()
            yield rows.batch()

    texts = tagged.join(placed.hint("merge"), tagged["mark"].eqNullSafe(placed["of"]) & tagged["doc_id"].eqNullSafe(placed["id"])).select("class", "group", "blocks", "text")
    sets = texts.mapInArrow(trimmed(tuples), "class long, group long, blocks int, set binary")
    dealt = in_pairs(sets, "group").select("class", "set", "group", "block", "low", "high")
    dealt = dealt.repartition(F.col("group"), F.col("low"), F.col("high")).sortWithinPartitions("group", "low", "high")

    def walk(batches):
        key, names, members, sides = None, [], [], []

        def done():
            once = {name: i for i, name in enumerate(names)}  # repeated rows bring a set twice
            at = list(once.values())
            pick = [names[i] for i in at], [members[i] for i in at]
            found = links(*pick, num, den, [sides[i] for i in at] if key and key[1] != key[2] else None)
            if found:
                yield pa.RecordBatch.from_pydict({"src": pa.array([f[0] for f in found], pa.int64()), "dst": pa.array([f[1] for f in found], pa.int64())})

        for batch in batches:
            for name, data, group, side, low, high in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (group, low, high) != key:
                    yield from done()
                    key, names, members, sides = (group, low, high), [], [], []
                names.append(name)
                members.append(tuple(np.frombuffer(data, np.uint64).tolist()))
                sides.append(side)
        yield from done()

    found = connected(dealt.mapInArrow(trimmed(walk), "src long, dst long"))
    rooted = signed.select("doc_id", "mark", "n_shingles", "class").join(found.select(F.col("node").alias("class"), "root"), "class", "left")
    rooted = stored(rooted.select("doc_id", "mark", "n_shingles", F.coalesce("root", "class").alias("root")), "rooted")
    dropped(signed, met, chosen, sizes, placed, groups, found)
    return rooted


def in_pairs(rows: DataFrame, of: str) -> DataFrame:
    """Rows (class, blocks) with block, and once for each pair (low, high) of blocks of their group that theirs is in."""
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, similarity: tuple[int, int] = (90, 100), most_sets: int = MOST_SETS, most_near: int = MOST_NEAR) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id.

    A document's set has the distinct n-grams of its words, lower-cased in A-Z;
    with fewer words, all of them as one; without any, none. Documents link when
    their sets' Jaccard similarity is ``similarity`` or more; component_id is the
    smallest id reachable by links, the document's own included.

    Null texts count as empty; empty sets link with nothing. Rows with a null id
    take part and are no one's smallest id; a component of such alone has null.
    Rows with the same id are documents of their own. No rows give no rows;
    other columns are not carried. Sets are compared by 64-bit hashes of their
    n-grams and told apart by 64-bit hashes of sets.
    """
    rooted = linked(docs, id_col, text_col, n, similarity, most_sets, most_near)
    # the smallest id among all documents of a component
    firsts = stored(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")).where("members > 1").drop("members"), "firsts")
    return rooted.join(firsts, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Rows of docs, all columns: of each group of linked rows the one with the smallest id.

    Rows are documents, whatever their ids: of rows with one id and different
    texts each stays if it is its group's, and of repeated rows one stays. Among
    equal ids the smaller hash of the text comes first, null ids before others.
    Rows whose text has no words link with nothing, so all of them stay.
    """
    rooted = linked(docs, id_col, text_col, n, similarity).where("root IS NOT NULL")
    own = F.struct("doc_id", "mark")
    firsts = stored(rooted.groupBy("root").agg(F.min(own).alias("first"), F.count("*").alias("members")).where("members > 1").drop("members"), "firsts")
    known = rooted.join(firsts, "root").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.first(own.eqNullSafe(F.col("first"))).alias("stays"))
    known = stored(known.where("NOT stays OR rows > 1").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__hash"), "stays"), "known")
    mark = "__mark"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    same = marked[id_col].eqNullSafe(F.col("__gone")) & (marked[mark] == F.col("__hash"))
    out = marked.join(known.select("__gone", "__hash"), same, "left_anti")
    repeated = known.where("stays").select("__gone", "__hash")
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates([id_col, mark]))
    return out.select(*docs.columns)
