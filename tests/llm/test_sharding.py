import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from plumbline.llm import sharding as H


def corpus():
    rnd = random.Random(9)
    docs = [(i, "wörd " * rnd.randint(0, 60)) for i in range(600)]
    docs += [(1000 + i, "copy") for i in range(300)]  # one text in a third of all rows
    return docs + [(None, None), (None, None), (7, ""), (7, "x" * 50_000), (1, docs[1][1])]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 3, "s") for d, t in docs], "doc_id long, text string, shard int, slot string").repartition(5)


def slot(doc_id, text, n):
    crc = zlib.crc32((text or "").encode())
    return int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{crc}".encode()).hexdigest()[:8], 16) % n


def brute(docs, n_shards, n_slots):
    rows = [(slot(d, t, n_slots), d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for d, t in docs]
    size = Counter()
    for s, _, _, n in rows:
        size[s] += n
    load, shard = [0] * n_shards, {}
    for s in sorted(size, key=lambda s: (-size[s], s)):
        shard[s] = load.index(min(load))
        load[shard[s]] += size[s]
    out, at = [], Counter()
    for s, d, crc, n in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, *r[2:])):
        out.append((d, n, crc, "bytes", shard[s], at[shard[s]], None, s))
        at[shard[s]] += 1
    return sorted(out, key=repr)


def taken(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


@pytest.mark.parametrize("n_shards, n_slots", [(24, 8192), (3, 50), (1, 4), (5, 1)])
def test_equals_brute_force(spark, n_shards, n_slots):
    assert taken(H.shard(frame(spark, corpus()), n_shards, n_slots)) == brute(corpus(), n_shards, n_slots)


def test_shards_are_near_equal_and_slots_have_no_gaps(spark):
    docs = [d for d in corpus() if len(d[1] or "") < 1000]
    bytes_, slots = Counter(), defaultdict(list)
    for r in H.shard(frame(spark, docs), 8).collect():
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(bytes_) == 8 and max(bytes_.values()) - min(bytes_.values()) <= 700
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_rows(spark):
    assert H.shard(frame(spark, corpus()).limit(0)).count() == 0


def test_maps_are_versions_and_edits_move_few_slots(spark, tmp_path):
    folder, docs = f"file://{tmp_path}/map", corpus()
    first = H.shard(frame(spark, docs), 6, 256, folder)
    assert {r.map_version for r in first.collect()} == {1} and H.versions(spark, folder) == [1]
    again = H.shard(frame(spark, docs), 6, 256, folder)
    assert taken(again) == taken(first) and H.versions(spark, folder) == [1]  # nothing to edit

    grown = H.shard(frame(spark, docs), 7, 256, folder)
    assert H.versions(spark, folder) == [1, 2]
    moves = H.moved(H.read_map(spark, folder, 1), H.read_map(spark, folder)).collect()
    assert moves and {m.to for m in moves} == {6}
    assert sum(r.shard == 6 for r in grown.collect()) == sum(m.n_rows for m in moves)

    H.shard(frame(spark, docs), 5, 256, folder)
    moves = H.moved(H.read_map(spark, folder, 2), H.read_map(spark, folder, 3)).collect()
    homeless = {r.slot for r in H.read_map(spark, folder, 2).where("shard >= 5").collect()}
    assert homeless <= {m.slot for m in moves} and {r.shard for r in H.read_map(spark, folder).collect()} == set(range(5))

    with pytest.raises(Exception, match="(?i)exist"):
        H.write_map(spark, folder, [0] * 256, [], 3)
    with pytest.raises(ValueError):
        H.shard(frame(spark, docs), 5, 128, folder)
    (tmp_path / "map" / "version=9").mkdir()  # a writer that was lost
    assert H.versions(spark, folder) == [1, 2, 3]


def test_rebalancing_mends_a_shard_that_grew():
    sums = [(s, 1, 100) for s in range(240)]
    shards = H.planned(sums, 8, 240)
    assert set(Counter(shards).values()) == {30}
    grown = [(s, n, 400 if shards[s] == 2 else b) for s, n, b in sums]
    edited = H.rebalanced(shards, grown, 8, slack=0.05)
    load = Counter()
    for s, _, b in grown:
        load[edited[s]] += b
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8
    assert {shards[s] for s in range(240) if edited[s] != shards[s]} == {2}
    empty = H.rebalanced([0] * 64, [], 4)
    assert set(Counter(empty).values()) == {16}


def test_files_hold_the_rows_of_their_shard(spark, tmp_path):
    df = frame(spark, corpus())
    sharded = H.shard(df, 4, 64, whole=True)
    H.write_shards(sharded, f"file://{tmp_path}/out", files=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r.shard_, r.slot_, r.doc_id, r.text) for r in back.collect()) == Counter((r.shard, r.slot, r.row.doc_id, r.row.text) for r in sharded.collect())
