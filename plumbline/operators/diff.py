"""Patience diff of two ordered views, as joins.

Lines that stand once in each view are its anchors; the longest chain of them
that rises on both sides stays. Between two links of the chain the lines that
are left are paired again, the k-th of equal lines with the k-th, and the chain
of those pairs stays as well. What is in neither chain is removed or added.

Neighbouring pairs are one run, so a chain is chosen among the places where the
views part and not among their lines. A row's gap is the number of kept lines
before it, which is its place less its place among the rows that are left.
"""

from __future__ import annotations

import bisect
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import fresh_stored
from .ids import places

#: Lines in a run at most; longer ones are several.
CUT = 1 << 16
#: Lines in which the first difference is looked for first; only if there is none, whole views are compared.
HEAD = 1 << 16
#: Runs among which one task chooses; more are dealt to blocks of the old view.
MOST_RUNS = 1 << 20


def edit_script(old: DataFrame, new: DataFrame, place: str, line: str, shared: str, most_runs: int = MOST_RUNS) -> DataFrame:
    """change, place, kept_before, line: what turns the old view into the new one.

    The place of a removed line is that in the old view, of an added one that in
    the new view; kept_before counts the lines of both views that stay before it.
    Places count from 1 without gaps. A null line equals no line. Views without
    rows, and equal ones, are no special case. Of views with more than
    ``most_runs`` runs, each block of the old one is matched with its own stretch
    of the new one: the script still turns one into the other, but lines that
    moved further may be in it that a longer chain had kept.
    """
    old, new = (v.select(F.col(place).cast("long").alias("place"), F.col(line).alias("line")) for v in (old, new))
    part = _first_difference(old.where(F.col("place") <= HEAD), new.where(F.col("place") <= HEAD))
    if part is None:
        part = _first_difference(old, new)
    if part is None:  # equal views
        return _change(old.where("false").withColumn("gap", F.lit(0).cast("long")), "removed")
    old, new = (fresh_stored(v.where(F.col("place") >= part), shared, "view") for v in (old, new))  # what comes before the first difference stays
    once = _both(old, new, "line", a=F.count("i"), b=F.count("j"), i=F.min("i"), j=F.min("j")).where("a = 1 AND b = 1").select("i", "j")
    kept = rising(once, shared, most_runs)
    left_old, left_new = _left(old, kept, "i", shared), _left(new, kept, "j", shared)
    common = fresh_stored(_both(left_old, left_new, "gap", "line", a=F.count("i"), b=F.count("j")).where("a > 0 AND b > 0").select("gap", "line"), shared, "common")
    a, b = _counted(left_old, common, shared), _counted(left_new, common, shared)
    pairs = a.select("gap", "line", "k", F.col("place").alias("i")).join(b.select("gap", "line", "k", F.col("place").alias("j")), ["gap", "line", "k"]).select("i", "j")
    kept = rising(pairs, shared, most_runs)
    removed, added = _left(left_old, kept, "i", shared), _left(left_new, kept, "j", shared)
    return _change(removed, "removed").unionByName(_change(added, "added"))


def replayed(old: DataFrame, script: DataFrame, place: str, line: str, shared: str) -> DataFrame:
    """place, line: the view that a script makes of the old one."""
    removed = script.where("change = 'removed'").select("place")
    kept = old.select(F.col(place).cast("long").alias("place"), F.col(line).alias("line")).join(removed, "place", "left_anti")
    kept = places(kept, "nth", ["place"], shared).select((F.col("nth") - 1).alias("gap"), F.lit(1).alias("side"), "place", "line")
    added = script.where("change = 'added'").select(F.col("kept_before").alias("gap"), F.lit(0).alias("side"), "place", "line")
    return places(kept.unionByName(added), "at", ["gap", "side", "place"], shared).select(F.col("at").alias("place"), "line")


def _first_difference(old: DataFrame, new: DataFrame) -> int | None:
    return old.unionByName(new).groupBy("place", "line").agg(F.count("*").alias("n")).where("n < 2 OR line IS NULL").agg(F.min("place")).first()[0]


def _both(old: DataFrame, new: DataFrame, *keys: str, **of) -> DataFrame:
    """Aggregates of the rows of two views with the same keys, of which none is null; i is an old row's place and j a new one's."""
    none = F.lit(None).cast("long")
    rows = old.select(*keys, F.col("place").alias("i"), none.alias("j")).unionByName(new.select(*keys, none.alias("i"), F.col("place").alias("j")))
    return rows.where("line IS NOT NULL").groupBy(*keys).agg(*(c.alias(name) for name, c in of.items()))


def _left(view: DataFrame, kept: DataFrame, side: str, shared: str) -> DataFrame:
    """place, line, gap: the rows that are in no pair, with the number of rows before them that are in one or were before."""
    taken = kept.select(F.col(side).alias("place"))
    rest = view.select("place", "line").join(taken, "place", "left_anti")
    return places(rest, "nth", ["place"], shared).select("place", "line", (F.col("place") - F.col("nth")).alias("gap"))


def _counted(own: DataFrame, common: DataFrame, shared: str) -> DataFrame:
    """Rows whose line stands in the same gap of the other side, numbered among the equal lines of their gap."""
    shown = own.join(common, ["gap", "line"], "left_semi")
    ranked = places(shown, "at", ["gap", "line", "place"], shared)
    first = ranked.groupBy("gap", "line").agg(F.min("at").alias("first"))
    return ranked.join(first, ["gap", "line"]).select("gap", "line", "place", (F.col("at") - F.col("first")).alias("k"))


def _change(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.lit(name).alias("change"), "place", F.col("gap").alias("kept_before"), "line")


def rising(pairs: DataFrame, shared: str, most_runs: int = MOST_RUNS) -> DataFrame:
    """i, j: the pairs of a longest chain that rises in both; every i and every j is in one pair at most.

    Pairs (i, j), (i + 1, j + 1) and so on are one run of its length. Pairs meet
    by j - i and their stretch of CUT places, where those of one run have the same
    i less their number. The chain of the greatest length is chosen by piles: of
    the chains that end at or below a j, only the longest is kept.
    """
    pairs = pairs.select(F.col("i").cast("long"), (F.col("j") - F.col("i")).cast("long").alias("way"), F.floor((F.col("i") - 1) / CUT).alias("part"))
    numbered = pairs.withColumn("start", F.col("i") - F.row_number().over(Window.partitionBy("way", "part").orderBy("i")))
    runs = numbered.groupBy("way", "part", "start").agg(F.min("i").alias("i"), F.count("*").alias("n"))
    runs = fresh_stored(runs.select("i", (F.col("i") + F.col("way")).alias("j"), "n"), shared, "runs")
    n_blocks = max(1, -(-runs.count() // most_runs))
    dealt = fresh_stored(runs.repartitionByRange(n_blocks, "i").withColumn("block", F.spark_partition_id()), shared, "dealt")
    found = dealt.groupBy("block").agg(F.min("i").alias("i"), F.percentile_approx("j", 0.5).alias("middle")).collect()  # a row for each block
    stretches = _stretches([(r.block, r.middle) for r in sorted(found, key=lambda r: r.i)])

    def chosen(batches):
        now, parts = None, []
        for batch in batches:
            block, *runs = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if block[a] != now:
                    yield from _batches(parts)
                    now, parts = int(block[a]), []
                lo, hi = stretches[now]
                own = (runs[1][a:b] >= lo) & (runs[1][a:b] < hi)
                parts.append(np.stack([c[a:b][own] for c in runs]))
        yield from _batches(parts)

    chain = dealt.select("block", "i", "j", "n").repartition("block").sortWithinPartitions("block", "i").mapInArrow(chosen, "i long, j long, n long")
    each = fresh_stored(chain, shared, "kept").select("i", "j", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    return each.select((F.col("i") + F.col("k")).alias("i"), (F.col("j") + F.col("k")).alias("j"))


def _stretches(middles: list[tuple[int, int]]) -> dict[int, tuple[float, float]]:
    """For each block, in order, the stretch of j that is its own: from halfway to the block before to halfway to the next."""
    top, at = float("-inf"), []
    for _, middle in middles:
        top = max(top, middle)
        at.append(top)
    cuts = [float("-inf"), *((a + b) / 2 for a, b in zip(at, at[1:])), float("inf")]
    return {block: (cuts[k], cuts[k + 1]) for k, (block, _) in enumerate(middles)}


def longest_chain(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs (i, j, n; by i, with stretches of j that don't overlap) of a chain with rising j and the greatest sum of n."""
    return [runs[k] for k in _chain(np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64)).tolist()]


def _chain(j: np.ndarray, n: np.ndarray, rows: int = 10_000) -> np.ndarray:
    """Which runs are in the chain; eight bytes a run for each list, as a block may have a million."""
    if (j[1:] > j[:-1]).all():
        return np.arange(len(j))
    tops, sums, last = array("q"), array("q"), array("q")  # the j at which a pile ends, rising, as do their sums
    before = array("q", bytes(8 * len(j)))
    for lo in range(0, len(j), rows):
        for k, top, own in zip(range(lo, len(j)), j[lo : lo + rows].tolist(), n[lo : lo + rows].tolist()):
            at = bisect.bisect_left(tops, top)
            total = own + (sums[at - 1] if at else 0)
            before[k] = last[at - 1] if at else -1
            end = at
            while end < len(tops) and sums[end] <= total:
                end += 1
            if end == at + 1:
                tops[at], sums[at], last[at] = top, total, k
            else:
                tops[at:end], sums[at:end], last[at:end] = array("q", [top]), array("q", [total]), array("q", [k])
    out, k = array("q"), last[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out)[::-1]


def _batches(parts: list[np.ndarray], rows: int = 50_000):
    if not parts:
        return
    runs = np.concatenate(parts, axis=1)
    parts.clear()
    chain = _chain(runs[1], runs[2])
    for lo in range(0, len(chain), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in runs[:, chain[lo : lo + rows]]], names=["i", "j", "n"])


def normal_format(changes) -> list[str]:
    """The lines of a normal-format diff, from (change, place, kept_before, line) in the order of kept_before, removed first, place."""
    gaps: dict[int, dict[str, list]] = {}
    for change, place, before, line in changes:
        gaps.setdefault(before, {"removed": [], "added": []})[change].append((place, line))
    out, n_removed, n_added = [], 0, 0
    for before in sorted(gaps):
        gone, come = gaps[before]["removed"], gaps[before]["added"]
        span = lambda rows: str(rows[0][0]) if len(rows) == 1 else f"{rows[0][0]},{rows[-1][0]}"
        if gone and come:
            out.append(f"{span(gone)}c{span(come)}")
        elif gone:
            out.append(f"{span(gone)}d{before + n_added}")
        else:
            out.append(f"{before + n_removed}a{span(come)}")
        out += [f"< {x}" for _, x in gone] + ["---"] * bool(gone and come) + [f"> {x}" for _, x in come]
        n_removed, n_added = n_removed + len(gone), n_added + len(come)
    return out
