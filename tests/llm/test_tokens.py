import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import packed_ids, packing, queries, token_counts
from plumbline.llm.encoding import UnitEncoder, runs, tokenizer_path

ODD = ["", " ", "a", " a", "a ", "a  b", "x\n\ny", "x \ny", "<|endoftext|> b", "a<|endoftext|> <|startoftext|>x", "don't I'll", "日本 語", "a\tb c", "é \u0301x", "A B c", None, "\x1c a", "Σ ΑΣ", "it 's", "12 34", " \n a", "a. b, c.\nD,\ne", "a.. b.,", ". , .\n,", "a\n\n.b", "x\r, y", "İ, i̇."]


def odd_texts(n=1500):
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("ab .,\n.,\r\t'éßİ1!😀<|>") for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_ids_of_whole_texts(name, spaced):
    enc = UnitEncoder(name, spaced, most=500)
    texts = odd_texts()
    whole = enc.whole([t or "" for t in texts])
    for lo, part in runs(pa.array(texts), most_bytes=2000):
        ids, offsets = enc.encode(part)
        for i in range(len(part)):
            assert ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() == whole[lo + i], repr(texts[lo + i])


def test_counts_equal_the_library():
    from tokenizers import Tokenizer, models, normalizers

    pieces = token_counts.pieces_of()
    own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    own.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    counter = token_counts.Counter(pieces, most=300)
    for text in [*odd_texts(400), "a▁b", "<s> <0x0A>", "the quick brown fox " * 50, "x" * 3000]:
        assert counter.count(text or "") == (len(own.encode(text, add_special_tokens=False).ids) if text else 0), repr(text)


def test_counts_of_any_vocabulary_equal_all_segmentations():
    pieces = [("a", -1.0), ("b", -2.0), ("ab", -3.0), ("aa", -2.0), ("▁", -1.0), ("▁a", -2.5), ("b▁a", -3.0), ("\n", -1.0)]
    counter = token_counts.Counter(pieces)
    scores, low = dict(pieces), -13.0

    def best(text):
        table = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(end):
                piece = text[start:end]
                if piece in scores:
                    options.append((table[start][0] + scores[piece], -start, table[start][1] + 1))
            if text[end - 1] not in scores:
                options.append((table[end - 1][0] + low, 1 - end, table[end - 1][1] + len(text[end - 1].encode())))
            total, _, count = max(options)
            table.append((total, count))
        return table[-1][1]

    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("aab é\n") for _ in range(rnd.randint(1, 12)))
        assert counter.count(text) == best("▁" + text.replace(" ", "▁")), repr(text)


def test_count_rows(spark):
    df = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (None, None, 4)], "doc_id long, text string, n_tokens long")
    assert sorted((tuple(r) for r in token_counts.count_tokens(df).collect()), key=str) == [(1, 2), (1, 2), (None, 0)]
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def library_ids(name, text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


ROWS = [(3, "third doc here", 1), (1, "first <|endoftext|>", 2), (2, None, 3), (5, "", 4), (None, "no id", 5), (3, "third again", 6), (9, "word " * 9000, 7)]


def test_packed_ids_round_trip(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, start long").repartition(3)
    files = packed_ids.write_ids(df)
    got = sorted(packed_ids.read_ids(spark, files, ids=True).collect(), key=lambda r: r.start)
    marks = dict(df.select("start", F.xxhash64("text")).collect())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[2]]))
    start = 0
    for r, (doc_id, text, _) in zip(got, order, strict=True):
        ids = library_ids("byte_bpe_50k.json", text, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert packed_ids.write_ids(df.limit(0)) == [] and packed_ids.read_ids(spark, []).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits_round_trip_and_random_access(tmp_path, bits):
    from pyarrow import fs

    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, np.uint64).astype("<u4") for n in (0, 1, 5, 700, 64, 3)]
    store = fs.LocalFileSystem()
    with store.open_output_stream(str(tmp_path / "x")) as sink:
        writer = packed_ids.IdWriter(sink, bits, block=64)
        for i, ids in enumerate(docs):
            writer.add(None if i == 1 else i, ids)
        writer.close()
    with store.open_input_file(str(tmp_path / "x")) as source:
        reader = packed_ids.IdReader(source)
        for i, ids in enumerate(docs):
            assert (reader.document(i) == ids).all()
        every = np.concatenate(docs)
        assert (np.concatenate(list(reader.blocks(60, 300))) == every[60:300]).all()
    assert (tmp_path / "x").stat().st_size < len(every) * bits / 8 + 64 * 8 + 400
    with pytest.raises(ValueError, match="bits"):
        packed_ids.pack_bits(np.array([2**bits if bits < 32 else 0], np.uint64), bits) if bits < 32 else packed_ids.pack_bits(np.array([2**32], np.uint64), bits)


def test_bits_for():
    assert [packed_ids.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def by_hand(rows):
    """(doc_id, start, length, ids, doc_tokens) of each piece, from the library's ids and the digits of their number."""
    out = Counter()
    for doc_id, text, _ in rows:
        data, start = library_ids("word_bpe_49k.json", text, 2).tobytes(), 0
        n = len(data) // 4
        digits = [1 << k for k in range(11, -1, -1) if n % 4096 >> k & 1]
        for length in [4096] * (n // 4096) + digits:
            out[doc_id, start, length, data[4 * start : 4 * (start + length)], n] += 1
            start += length
    return out


def test_packing_gives_just_these_pieces(spark):
    rows = [*ROWS, ROWS[0], ROWS[-1], *((20 + i, "word " * n, 0) for i, n in enumerate((1, 126, 127, 128, 4094, 4095, 4096)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    got = packing.pack(df).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids, r.doc_tokens) for r in got) == by_hand(rows)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.bucket == r.length for r in got)
    assert packing.pack(df.limit(0)).count() == 0


def test_batches_hold_one_bucket(spark):
    df = spark.createDataFrame([(i, "word " * (i % 50), 0) for i in range(300)], "doc_id long, text string, batch_id long").repartition(3)
    batches = {}
    for r in packing.pack(df, batch_tokens=64).collect():
        batches.setdefault(r.batch_id, []).append(r)
    assert all(len({r.bucket for r in own}) == 1 and sorted(r.batch_row for r in own) == list(range(len(own))) and len(own) <= 64 // own[0].bucket for own in batches.values())
    full = Counter(own[0].bucket for own in batches.values() if len(own) < 64 // own[0].bucket)
    assert max(full.values()) <= 3  # one short batch for each task


def test_the_packing_query_gives_the_digests(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in queries.op10_packing(spark, str(tmp_path)).collect())
    assert got == Counter({(d, s, n, zlib.crc32(ids), all_): c for (d, s, n, ids, all_), c in by_hand(ROWS).items()})


def test_piece_lengths():
    for n in range(1, 3000):
        own = list(packing.piece_lengths(n, 256))
        assert sum(own) == n and own == sorted(own, reverse=True) and all(x & (x - 1) == 0 and x <= 256 for x in own)
