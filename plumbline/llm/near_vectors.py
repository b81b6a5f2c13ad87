"""Near-duplicate vectors by product quantisation.

Unit vectors are put into the inverted list of their nearest coarse centroid;
what remains is cut into subspaces, each coded by its nearest codeword. A query
looks up its distances to all codewords once and adds them up along a list's
codes. All bounds are exact, so nothing is lost: a list is probed when the plane
that lies midway between its centroid and the query's own is within the linking
distance of the query, as the list's vectors are all behind it; and a coded
vector is a candidate when its distance less its own coding error is within the
linking distance. Candidates are ranked by their exact cosine in double precision.

Vectors of unlike labels never link, so each label has lists of its own, as many
as its vectors fill. Centroids and codewords are fitted to one bounded sample, for
each power of two of lists that is in use; every vector is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected
from .shared import Rows, dropped, stored, trimmed

#: Vectors that centroids and codewords are fitted to, at most.
SAMPLE = 8_000
#: Inverted lists of a label: one for so many vectors, as a power of two up to the most (and an eighth of the sample).
LIST_SIZE = 1_000
MOST_LISTS = 1_024
SUBSPACES = 16
CODEWORDS = 64
#: Vectors of a list compared at once; longer lists are compared in pairs of blocks.
BLOCK = 2_048
#: Slack for rounding in the bounds.
SLACK = 1e-5


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids of x; deterministic."""
    rng = np.random.default_rng(11)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        has = counts > 0
        centres[has] = sums[has] / counts[has, None]
    return centres


class Quantiser:
    """Coarse centroids, and codewords for the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codewords: int):
        self.centres = kmeans(sample, max(1, min(lists, len(sample) // 8 + 1)))
        c2 = (self.centres**2).sum(1)
        #: Distances between centroids.
        self.apart = np.sqrt(np.maximum(1e-12, c2[:, None] + c2 - 2 * self.centres @ self.centres.T))
        near = self.lists_of(sample)[0]
        residual = sample - self.centres[near]
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.words = [kmeans(residual[:, a:b], codewords) for a, b in zip(self.cuts, self.cuts[1:])]

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, and the distances to all."""
        d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T))
        return d.argmin(1), d

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the coding error of each."""
        out, error = np.empty((len(residual), len(self.words)), np.uint8), np.zeros(len(residual))
        for s, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.words)):
            part = residual[:, a:b]
            out[:, s] = np.argmin((w**2).sum(1) - 2 * part @ w.T, 1)
            error += ((part - w[out[:, s]]) ** 2).sum(1)
        return out, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """For each subspace the squared distances of query residuals to all codewords."""
        return [((part := residual[:, a:b]) ** 2).sum(1)[:, None] + (w**2).sum(1) - 2 * part @ w.T for a, b, w in zip(self.cuts, self.cuts[1:], self.words)]


def compare(q: Quantiser, centre: int, x: np.ndarray, codes: np.ndarray, errors: np.ndarray, y: np.ndarray, reach: float, least: float):
    """(i, j) of query rows y[i] and listed rows x[j] with cosine ``least`` or more, in runs."""
    tables = q.tables(y - q.centres[centre])
    step = max(1, 4_000_000 // max(1, len(x)))
    for lo in range(0, len(y), step):
        hi = min(lo + step, len(y))
        near = np.zeros((hi - lo, len(x)), np.float32)
        for s, t in enumerate(tables):
            near += t[lo:hi].astype(np.float32)[:, codes[:, s]]
        i, j = np.nonzero(near <= ((reach + errors + 1e-3) ** 2).astype(np.float32)[None, :])
        for a in range(0, len(i), 500_000):
            ia, ja = i[a : a + 500_000] + lo, j[a : a + 500_000]
            keep = np.einsum("ij,ij->i", y[ia], x[ja]) >= least
            yield ia[keep], ja[keep]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.98, sample: int = SAMPLE, lists: int | None = None, list_size: int = LIST_SIZE, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, block: int = BLOCK) -> DataFrame:
    """Every vector: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null (any two, without
    a label column), their lengths are equal, and the cosine is ``cosine`` or
    more in double precision. n_links counts the other vectors linked directly;
    component_id is the smallest id reachable by links, the vector's own
    included; kept says whether that is its own.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Equal vectors of a label are one class and link with each
    other; links are found between classes and counted for their members, so
    copies are never expanded. Rows with a null id are counted as links and as
    no one's smallest id; their component is that of the others, or null. No
    rows give no rows; other columns are not carried.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    x = F.col(vector_col).cast("array<double>")
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    fit = F.col("x").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < math.inf), F.lit(False))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), x.alias("x"))
    plus = F.transform("x", lambda v: v + F.lit(0.0))  # -0.0 is 0.0
    tagged = stored(rows.withColumn("x", F.when(F.coalesce(fit, F.lit(False)), plus)).withColumn("class", F.when(F.col("x").isNotNull(), F.xxhash64("x", "label"))), "vectors")
    classes = stored(tagged.where("x IS NOT NULL").groupBy("class").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("copies")), "classes")

    picked = classes.select("class", "x").orderBy(F.xxhash64("class"), "class").limit(sample).collect()  # bounded
    by_size: dict[int, list] = {}
    for r in picked:
        by_size.setdefault(len(r.x), []).append(r.x)
    # the tier of a label: the power of two of lists that it has
    sized = classes.groupBy("label").agg(F.count("*").alias("vectors"))
    tier = F.lit(lists.bit_length() - 1) if lists else F.least(F.floor(F.log2(F.greatest(F.lit(1.0), F.col("vectors") / list_size))), F.lit(MOST_LISTS.bit_length() - 1))
    tiers = stored(sized.select("label", tier.cast("int").alias("tier")), "tiers")
    used = [r[0] for r in tiers.select("tier").distinct().collect()]  # eleven at most
    fitted = {(n, t): Quantiser(unit(np.array(own)), 1 << t, subspaces, codewords) for n, own in by_size.items() for t in used}
    sent = spark.sparkContext.broadcast(fitted)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    packed = np.dtype(np.float32 if single else np.float64)  # as given, so nothing is lost
    own_type = pa.schema([("class", pa.int64()), ("label", pa.string()), ("size", pa.int64()), ("tier", pa.int32()), ("list", pa.int64()), ("role", pa.int32()), ("x", pa.binary()), ("copies", pa.int64())])

    def probe(batches):
        """A row in the vector's own list, and one in each further list that it must probe."""
        for batch in batches:
            out = Rows(own_type)
            names, labels, xs, copies, tiers_ = (batch.column(i).to_pylist() for i in range(5))
            kinds: dict[tuple, list[int]] = {}
            for i, (v, t) in enumerate(zip(xs, tiers_)):
                kinds.setdefault((len(v), t), []).append(i)
            for (size, t), at in kinds.items():
                given = np.array([xs[i] for i in at])
                q = sent.value.get((size, t))
                if q is None:  # a length that the sample doesn't hold: one list
                    home, meets = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                else:
                    home, d = q.lists_of(unit(given))
                    plane = (d**2 - d[np.arange(len(at)), home, None] ** 2) / (2 * q.apart[home])
                    plane[np.arange(len(at)), home] = 0
                    meets = plane <= reach
                for k, i in enumerate(at):
                    data = given[k].astype(packed).tobytes()
                    for c in np.flatnonzero(meets[k]).tolist():
                        out.add(names[i], labels[i], size, t, c, int(c != home[k]), data, copies[i], size=len(data) + 48)
                    if out.full:
                        yield out.batch()
            yield out.batch()

    spread = stored(classes.join(tiers, "label").select("class", "label", "x", "copies", "tier").mapInArrow(trimmed(probe), "class long, label string, size long, tier int, list long, role int, x binary, copies long"), "spread")
    key = ["label", "size", "tier", "list"]
    counts = stored(spread.groupBy(*key).agg(F.count_if(F.col("role") == 0).alias("homes"), F.count("*").alias("all")), "counts")
    dealt = spread.join(counts, key)
    many, other = F.ceil(F.col("homes") / block).cast("int"), F.ceil(F.col("all") / block).cast("int")
    own = F.pmod(F.xxhash64("class"), many).cast("int")
    asked = F.pmod(F.xxhash64("class", F.lit(1)), other).cast("int")
    # each listed vector meets all query blocks of its list, each query all listed blocks
    listed = dealt.where((F.col("role") == 0)).select(*key, "class", "x", "copies", F.lit(0).alias("side"), own.alias("a"), F.explode(F.sequence(F.lit(0), other - 1)).alias("b"))
    queries = dealt.where("homes > 0").select(*key, "class", "x", "copies", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), many - 1)).alias("a"), asked.alias("b"))
    blocks = listed.unionByName(queries).repartition(*key, "a", "b").sortWithinPartitions(*key, "a", "b", "side")

    def search(batches):
        task, names, xs, copies, sides = None, [], [], [], []
        result = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("dst", pa.int64())])

        def done():
            side = np.array(sides)
            if task is None or not (side == 0).any() or not (side == 1).any():
                return
            data, name, n = unit(np.frombuffer(b"".join(xs), packed).reshape(len(xs), -1).astype(float)), np.array(names, np.int64), np.array(copies, np.int64)
            base, ask = side == 0, side == 1
            q, centre = sent.value.get((task[1], task[2])), task[3]
            if q is None:
                q = Quantiser(data[base][:SAMPLE], 1, subspaces, codewords)
                centre = 0
            codes, errors = q.codes(data[base] - q.centres[centre])
            links, first = np.zeros(ask.sum(), np.int64), np.full(ask.sum(), -1)
            up = Union()
            for i, j in compare(q, centre, data[base], codes, errors, data[ask], reach, cosine):
                differ = name[ask][i] != name[base][j]
                i, j = i[differ], j[differ]
                np.add.at(links, i, n[base][j])
                up.join(name[ask][i], name[base][j])
            got = Rows(result)
            for k in np.flatnonzero(links):
                got.add(int(name[ask][k]), int(links[k]), None)
            for a, b in up.edges():
                got.add(a, 0, b)
            yield got.batch()

        for batch in batches:
            for *where, name, data, count, side in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 8, 9, 4, 5, 6, 7))):
                if where != task:
                    yield from done()
                    task, names, xs, copies, sides = where, [], [], [], []
                names.append(name)
                xs.append(data)
                copies.append(count)
                sides.append(side)
        yield from done()

    found = stored(blocks.mapInArrow(trimmed(search), "class long, links long, dst long"), "found")
    linked = connected(found.where("dst IS NOT NULL").select(F.col("class").alias("src"), "dst"))
    counted = found.groupBy("class").agg(F.sum("links").alias("others"))
    about = stored(classes.select("class", "copies").join(counted, "class", "left").join(linked.select(F.col("node").alias("class"), "root"), "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")), "about")
    rooted = stored(tagged.select("vec_id", "class").join(about, "class", "left").select("vec_id", "n_links", "root"), "rooted")
    firsts = stored(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least")), "firsts")
    dropped(tagged, classes, tiers, spread, counts, found, about, linked)
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return rooted.join(firsts, "root", "left").select(F.col("vec_id").cast(kind), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; safe for very large and small components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Union:
    """Components of a block's links, with as few edges as connect them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        r = x
        while (n := self.up.get(r, r)) != r:
            r = n
        while (n := self.up.get(x, x)) != r:
            self.up[x] = r
            x = n
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def edges(self):
        return [(x, r) for x in self.up if (r := self.root(x)) != x]
