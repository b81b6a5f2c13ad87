"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's hash gives one of thousands of slots, for ever. Bytes are summed for
each slot, and slots, not records, are given to shards, so the map has one row a
slot whatever the number of records. Rebalancing edits the map: few slots move,
all others stay, and a new version is written beside the old ones.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import deleted_at_exit, finished_folders, fresh_path, placed

SLOTS = 8_192
SHARDS = 24
#: Bytes that each record takes besides its text.
RECORD_BYTES = 8
#: A shard may be so much larger than the mean, of the mean, before slots move.
SLACK = 0.01
MAP = "slot int, shard int, n_rows long, bytes long"


def slot_of(record: Column, n_slots: int = SLOTS) -> Column:
    """The virtual slot of a record's key: the first 32 bits of its md5, modulo the number of slots."""
    return (F.conv(F.substring(F.md5(record), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def sized(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", record_bytes: int = RECORD_BYTES, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every document; with ``whole`` also row, the struct of its own columns.

    A record's key is its id and the crc32 of its text, so that neither copies
    of a text nor rows of one id fill one slot.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.struct("*").alias("row")] if whole else []
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + record_bytes).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *own)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"))
    return rows.withColumn("virtual_slot", slot_of(key, n_slots))


def totals(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, rows, bytes) of every slot that holds records, by slot: as many entries as slots at most."""
    sums = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return sorted(tuple(r) for r in sums.collect())


def planned(sums: list[tuple[int, int, int]], n_shards: int, n_slots: int) -> list[int]:
    """The shard of every slot: the largest first, each to the shard with the fewest bytes; empty slots to the one with the fewest slots."""
    shards, held = [-1] * n_slots, [0] * n_shards
    loads = [(0, k) for k in range(n_shards)]
    for slot, _, size in sorted(sums, key=lambda s: (-s[2], s[0])):
        load, k = heapq.heappop(loads)
        shards[slot] = k
        held[k] += 1
        heapq.heappush(loads, (load + size, k))
    counts = [(n, k) for k, n in enumerate(held)]
    heapq.heapify(counts)
    for slot in range(n_slots):
        if shards[slot] < 0:
            n, k = heapq.heappop(counts)
            shards[slot] = k
            heapq.heappush(counts, (n + 1, k))
    return shards


def rebalanced(shards: list[int], sums: list[tuple[int, int, int]], n_shards: int, slack: float = SLACK) -> list[int]:
    """A map edited for new totals or another number of shards: slots move from the fullest shards to the emptiest, all others stay.

    Slots of shards that are no more go first. Then, while the fullest shard is
    over the mean by more than ``slack``, the largest of its slots whose move
    makes the two more equal goes to the emptiest; a shard that one slot fills
    is left out of the mean. A shard that is added is the emptiest until it is
    full, so slots move into it alone. Empty slots follow
    in the end, by number, to shards with fewer than their share.
    """
    out, size = list(shards), [0] * len(shards)
    for slot, _, n in sums:
        size[slot] = n
    own: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]  # (-bytes, slot) of each shard
    load = [0] * n_shards
    for slot, k in enumerate(out):
        if k < n_shards and size[slot]:
            own[k].append((-size[slot], slot))
            load[k] += size[slot]
    for slot in sorted((s for s, k in enumerate(out) if k >= n_shards and size[s]), key=lambda s: (-size[s], s)):
        k = min(range(n_shards), key=lambda k: (load[k], k))
        out[slot] = k
        own[k].append((-size[slot], slot))
        load[k] += size[slot]
    active = set(range(n_shards))
    for _ in range(2 * len(shards)):
        full = max(active, key=lambda k: (load[k], -k))
        low = min(active, key=lambda k: (load[k], k))
        if load[full] <= sum(load[k] for k in active) / len(active) * (1 + slack):
            break
        gap = load[full] - load[low]
        fits = [e for e in own[full] if -e[0] < gap]
        if not fits:  # one slot fills it: the others are made equal without it
            active.remove(full)
            continue
        half = [e for e in fits if -2 * e[0] <= gap]
        move = min(half) if half else max(fits)
        own[full].remove(move)
        own[low].append(move)
        load[full] += move[0]
        load[low] -= move[0]
        out[move[1]] = low
    held = [0] * n_shards
    for k in (k for k in out if k < n_shards):
        held[k] += 1
    share = -(-len(out) // n_shards)
    for slot, k in enumerate(out):
        if not size[slot] and (k >= n_shards or held[k] > share):
            to = min(range(n_shards), key=lambda j: (held[j], j))
            held[to] += 1
            if k < n_shards:
                held[k] -= 1
            out[slot] = to
    return out


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of the map under a folder that were written whole, in order."""
    return sorted(int(name.split("=")[1]) for name in finished_folders(spark, folder) if name.startswith("version="))


def write_map(spark: SparkSession, folder: str, shards: list[int], sums: list[tuple[int, int, int]], version: int) -> None:
    """Writes a version of the map; one that is there already is never overwritten, the writer fails instead."""
    known = {slot: (n, size) for slot, n, size in sums}
    rows = [(slot, k, *known.get(slot, (0, 0))) for slot, k in enumerate(shards)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """slot, shard, n_rows, bytes of a version of the map; by default the newest."""
    return spark.read.schema(MAP).parquet(f"{folder}/version={versions(spark, folder)[-1] if version is None else version}")


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """slot, from, to, n_rows, bytes: what an edit of the map moves."""
    both = old.select("slot", F.col("shard").alias("from")).join(new.select("slot", F.col("shard").alias("to"), "n_rows", "bytes"), "slot")
    return both.where("from <> to").select("slot", "from", "to", "n_rows", "bytes")


def shard(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", record_bytes: int = RECORD_BYTES, slack: float = SLACK, whole: bool = False) -> DataFrame:
    """Every document: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version; with ``whole`` also row.

    The law is ``bytes``: shards are near equal in bytes, as near as the largest
    slots let them; copies of a text may lie in several shards. slot counts the
    documents of a shard from 0, by virtual slot, then id (null before all), the
    crc32 of the text and size. grown_shard is null. size is the text's bytes
    and ``record_bytes``.

    The map is read from the newest version under ``folder`` and edited where a
    shard is over the mean by more than ``slack``, or where the number of shards
    changed; an edit is written as the next version. Without a version there (or
    a folder) the map is planned anew. A folder whose map has another number of
    slots is refused.

    Null and empty texts have the size ``record_bytes``. Repeated rows are
    records of their own, but rows alike in id and text share a slot. No rows
    give no rows, and a map of empty slots. Columns of the input may have any names.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = deleted_at_exit(spark, fresh_path(spark, "shard-map"))
    rows = placed(sized(docs, n_slots, id_col, text_col, record_bytes, whole), "place", F.asc("virtual_slot"), F.asc("doc_id"), F.asc("text_crc32"), F.asc("size"))
    sums = totals(rows)
    there = versions(spark, folder)
    version = there[-1] if there else 0
    if there:
        had = [k for _, k in sorted(read_map(spark, folder, version).select("slot", "shard").collect())]
        if len(had) != n_slots:
            raise ValueError(f"the map has {len(had)} slots, not {n_slots}")
        shards = rebalanced(had, sums, n_shards, slack)
    else:
        had, shards = None, planned(sums, n_shards, n_slots)
    if shards != had:
        version += 1
        write_map(spark, folder, shards, sums, version)
    # where each slot's documents begin among all, and in their shard
    begins, before, inside = [], 0, [0] * n_shards
    for slot, n, _ in sums:
        k = shards[slot]
        begins.append((slot, k, inside[k] - before))
        before += n
        inside[k] += n
    places = F.broadcast(spark.createDataFrame(begins, "virtual_slot int, shard int, shift long"))  # a row for each slot at most
    out = rows.join(places, "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"), *["row"] * whole)


def write_shards(sharded: DataFrame, folder: str, files: int = 1) -> None:
    """Writes the rows of shard(whole=True) under ``folder``/shard_=K, each shard in about ``files`` files of whole virtual slots, by slot."""
    part = F.pmod(F.col("virtual_slot"), F.lit(files))
    rows = sharded.repartition(F.col("shard"), part).sortWithinPartitions("shard", "slot")
    rows.select("row.*", F.col("shard").alias("shard_"), F.col("slot").alias("slot_")).write.partitionBy("shard_").parquet(folder)
