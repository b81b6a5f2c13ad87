import hashlib
import math
import random
import re
import zlib
from collections import Counter

from plumbline.llm import resampling as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=2):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=25, least=20, seed=7, n=10000, longest=2):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + n) / ((s[b] + 1.0) * (all_t + n)))) for b in range(n)]
    rows = []
    for doc_id, text in docs:
        words, own = features(text, longest)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[2], r[1]))
    drawn = len(fit) * percent // 100
    return sorted([(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)] + [(*r[:4], None) for r in rows if not r[4]], key=repr)


def corpus():
    rnd = random.Random(6)
    words = ["Alpha", "beta", "été", "x1", "42", "日本", "don't", "a_b", "Ünder", "\x7f", "the"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80)))) for i in range(200)]
    return docs + [(200, None), (201, ""), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (5, docs[6][1]), (202, "the " * 30_000)]


TARGET = ["Alpha beta don't", None, "", "42 été 日本 " * 5]


def frames(spark, docs, target):
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, buckets int, rank string").repartition(5)
    return df, spark.createDataFrame([(t,) for t in target], "text string")


def taken(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    df, target = frames(spark, corpus(), TARGET)
    assert taken(R.resample(df, target)) == brute(corpus(), TARGET)
    assert taken(R.resample(df, target, percent=60, least_words=0, seed=1, n_buckets=16, longest=3)) == brute(corpus(), TARGET, 60, 0, 1, 16, 3)


def test_no_documents_and_no_target(spark):
    df, target = frames(spark, corpus(), TARGET)
    assert R.resample(df.limit(0), target).count() == 0
    assert taken(R.resample(df, target.limit(0))) == brute(corpus(), [])


def test_drawn_rows_keep_their_columns(spark):
    df, target = frames(spark, corpus(), TARGET)
    out = R.drawn(df, target)
    assert out.schema == df.schema
    want = Counter(r[0] for r in brute(corpus(), TARGET) if r[4])
    assert Counter(r.doc_id for r in out.collect()) == want


def test_the_gains_are_one_literal(spark):
    rows = spark.createDataFrame([([1, 2, 2],), ([],)], "buckets array<int>")
    out = rows.select(R.weight_of(rows.buckets, [5, -7, 1, 1]).alias("w"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "[5,-7,1,1]" in plan
    assert [r.w for r in out.collect()] == [-2, 0]  # -5 / 3, rounded down


def test_draws_favour_the_target(spark):
    rnd = random.Random(8)
    near, far = ["river", "boat", "water", "bank"], ["stock", "bond", "price", "trade"]
    docs = [(i, " ".join(rnd.choice(near if i % 4 == 0 else far) for _ in range(40))) for i in range(400)]
    df, target = frames(spark, docs, ["river boat water bank " * 20])
    drawn = [r.doc_id for r in R.resample(df, target).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) > 60
