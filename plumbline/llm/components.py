"""Connected components of an edge table, by contraction.

Each partition first turns its edges into a spanning forest. Then, in rounds,
every node moves to its least neighbour (by a hash that changes with the round,
so chains shrink as fast as stars), and edges between moved nodes go on. Tables
between rounds are written to the shared folder; joins read written tables on
both sides, so that a node with very many edges can be split among tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored, trimmed

#: Nodes that a task's forest holds before it is given out and started anew.
MOST_NODES = 2_000_000


def forest(edges: DataFrame) -> DataFrame:
    """src, dst: edges (node, root) that connect what the given ones connect within each partition."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            r = x
            while (n := up.get(r, r)) != r:
                r = n
            while (n := up.get(x, x)) != r:
                up[x] = r
                x = n
            return r

        def given():
            pairs = [(x, root(x)) for x in list(up)]
            pairs = [(x, r) for x, r in pairs if x != r]
            up.clear()
            for lo in range(0, len(pairs), 50_000):
                part = pairs[lo : lo + 50_000]
                yield pa.RecordBatch.from_pydict({"src": pa.array([p[0] for p in part], pa.int64()), "dst": pa.array([p[1] for p in part], pa.int64())})

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > MOST_NODES:
                yield from given()
        yield from given()

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").mapInArrow(trimmed(run), "src long, dst long")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: every node of the edges (src, dst; longs) with one node of its component.

    All nodes of a component have the same root, which is one of them. Loops,
    repeated edges and edges with a null are of no effect; no edges give no rows.
    """
    now = stored(forest(edges), "forest")
    labels: DataFrame | None = None
    for turn in range(most_rounds):
        if now.isEmpty():
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = (lambda c: F.struct(c.alias("h"), c.alias("n"))) if turn == 0 else (lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("n")))
        least = both.groupBy("src").agg(F.min(rank(F.col("dst"))).alias("m"))
        moves = stored(least.select(F.col("src").alias("node"), F.least(F.col("m"), rank(F.col("src"))).getField("n").alias("root")), "moves")
        if labels is None:
            new = moves
        else:
            new = stored(labels.join(moves.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        half = now.join(moves.select(F.col("node").alias("src"), F.col("root").alias("a")), "src").select("a", "dst")
        half = stored(half, "half")
        full = half.join(moves.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst").where("a <> b")
        following = stored(forest(full.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "forest")
        dropped(now, half, *([labels] if labels is not None else []), *([moves] if new is not moves else []))
        labels, now = new, following
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    dropped(now)
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, root long")
