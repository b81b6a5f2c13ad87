"""Ids: ranges, counters, tags and the groups that references form."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import dropped, fresh_stored, stored

#: Ids that a range may cover; a larger one covers nothing and is named.
RANGE_CAP = 1_000


def expand_ranges(rows: DataFrame, lo: str, hi: str, cap: int = RANGE_CAP) -> DataFrame:
    """Rows with n, one for each number from lo to hi; the cap is checked before anything is expanded."""
    ok = (F.col(hi) >= F.col(lo)) & (F.col(hi) - F.col(lo) < cap)
    return rows.withColumn("n", F.explode(F.when(ok, F.sequence(F.col(lo), F.col(hi))).otherwise(F.array().cast("array<bigint>"))))


def bad_ranges(rows: DataFrame, lo: str, hi: str, cap: int = RANGE_CAP) -> DataFrame:
    """Rows whose range is reversed or over the cap, with the reason."""
    why = F.when(F.col(hi) < F.col(lo), "reversed").when(F.col(hi) - F.col(lo) >= cap, "over-cap")
    return rows.withColumn("why", why).where("why IS NOT NULL")


def in_ranges(points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, *keys: str, cap: int = RANGE_CAP) -> DataFrame:
    """The rows of points whose number lies in a range of their keys, each once; reversed ranges and those over the cap hold nothing.

    Numbers are parted into cells as wide as the cap, so a range lies in one cell
    or two. The ranges of a cell are merged to disjoint ones, of which a cell
    holds half the cap at most, whatever the number of ranges; a point meets the
    one row of its cell. No range is expanded. Null numbers and keys match nothing.
    """
    cell = lambda c: F.floor(c / cap).cast("long")
    fit = ranges.where((F.col(hi) >= F.col(lo)) & (F.col(hi) - F.col(lo) < cap))
    cells = fit.select(*keys, F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.explode(F.array_distinct(F.array(cell(F.col(lo)), cell(F.col(hi))))).alias("__cell"))
    cut = cells.select(*keys, "__cell", F.greatest("__lo", F.col("__cell") * cap).alias("__lo"), F.least("__hi", (F.col("__cell") + 1) * cap - 1).alias("__hi"))
    furthest = cut.groupBy(*keys, "__cell", "__lo").agg(F.max("__hi").alias("__hi"))  # a row for each number of a cell at most
    listed = furthest.groupBy(*keys, "__cell").agg(F.array_sort(F.collect_list(F.struct(F.col("__lo").alias("lo"), F.col("__hi").alias("hi")))).alias("__all"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def merge(had, x):
        last = F.element_at(had, -1)
        joined = F.concat(F.slice(had, F.lit(1), F.size(had) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(had) > 0) & (x["lo"] <= F.try_element_at(had, F.lit(-1))["hi"] + 1), joined).otherwise(F.concat(had, F.array(x)))

    merged = listed.select(*(F.col(k).alias(f"__key_{k}") for k in keys), "__cell", F.aggregate("__all", none, merge).alias("__all"))
    same = [F.col(k) == F.col(f"__key_{k}") for k in keys]
    placed = points.withColumn("__at", cell(F.col(point)))
    held = F.exists("__all", lambda r: (r["lo"] <= F.col(point)) & (F.col(point) <= r["hi"]))
    joined = placed.join(merged, functools.reduce(lambda a, b: a & b, same, F.col("__at") == F.col("__cell")))
    return joined.where(held).select(*points.columns)


def counters_behind(observed: DataFrame, namespace: str, number: str, counters: DataFrame, next_: str = "next") -> DataFrame:
    """Namespaces whose next number is not above all observed ones."""
    top = observed.groupBy(namespace).agg(F.max(number).alias("observed"))
    return counters.join(top, namespace).where(F.col("observed") >= F.col(next_)).select(namespace, "observed", next_)


def next_numbers(observed: DataFrame, namespace: str, number: str) -> DataFrame:
    """namespace, granted: the number that each namespace grants next, one above all that were ever seen."""
    return observed.groupBy(namespace).agg((F.max(number) + 1).alias("granted"))


def retag(rows: DataFrame, tags: str, old: str, new: str) -> DataFrame:
    """Rows with one tag renamed to another; where both were, they merge in the place of the first."""
    return rows.withColumn(tags, F.array_distinct(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t))))


def tag_tree(rows: DataFrame, key: str, tags: str) -> DataFrame:
    """tag, member: each key under each of its tags, once; rows and not lists, as one tag may have any number of members."""
    return rows.select(F.explode(tags).alias("tag"), F.col(key).alias("member")).distinct()


def groups(edges: DataFrame, a: str, b: str, shared: str, most_rounds: int = 50) -> DataFrame:
    """node, root: each node of the edges with the smallest node that it is connected to.

    Alternating stars: neighbours move to their least neighbour, first the larger
    ones, then the smaller. Each round is written to a new folder under
    ``shared``, which all executors see, so no round is computed twice; it ends
    when a round gives the edges that it was given.
    """
    spark, home = edges.sparkSession, f"{shared}/groups-{uuid.uuid4().hex}"
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), f"{home}/edges-0")
    nodes = stored(now.select(F.col("u").alias("node")).union(now.select("v")).distinct(), f"{home}/nodes")
    size = None
    for turn in range(1, most_rounds + 1):
        # joins read written tables on both sides, so that a node with very many edges can be split among tasks
        both = now.union(now.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{home}/least-{turn}")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{home}/large-{turn}")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lower = stored(down.groupBy("u").agg(F.min("v").alias("m")), f"{home}/lower-{turn}")
        now = stored(down.join(lower, "u").select("v", "m").union(lower.select("u", "m")).where("v <> m").toDF("u", "v").distinct(), f"{home}/edges-{turn}")
        after = now.count()
        settled = after == size and spark.read.parquet(f"{home}/edges-{turn - 1}").join(now, ["u", "v"], "left_anti").isEmpty()  # edges are distinct
        for name in (f"edges-{turn - 1}", f"least-{turn}", f"large-{turn}", f"lower-{turn}"):
            dropped(spark, f"{home}/{name}")
        if settled:
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        size = after
    raise RuntimeError(f"groups did not settle in {most_rounds} rounds")


def places(rows: DataFrame, name: str, order: list, shared: str) -> DataFrame:
    """Rows with their place (from 1) in the order of all, without a task that sees them all.

    Rows are dealt to ranges of the order and sorted there, so a row's number in
    its task is its place in the range; the ranges' sizes, one number for each
    task, give where each begins.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = fresh_stored(ranged.withColumn("__nth", F.monotonically_increasing_id()), shared, "places")
    task, nth = F.shiftright("__nth", 33), F.col("__nth").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = own.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    starts = sizes.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")).alias("__start"))  # a row for each task
    return own.join(F.broadcast(starts), task == F.col("__task")).select(*rows.columns, (F.col("__start") + nth + 1).cast("long").alias(name))
