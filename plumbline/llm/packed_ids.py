"""Token ids in files of fixed-width packed bits, with block offsets for random access.

File: a header, blocks of ids, the document table, the block offsets, a footer.
Each id takes the fewest bits that the vocabulary needs. A block holds BLOCK ids
(the last one fewer) and starts on a byte, so any range of ids is read by
seeking to its first block and unpacking whole blocks with numpy.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, runs
from .shared import Rows, deleted_at_exit, fresh_path, trimmed

TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = 50_257
END_ID = 0
BLOCK = 65_536
MAGIC = b"PLBITS01"
HEAD = struct.Struct("<8sBxxxI")  # magic, bits, ids in a block
FOOT = struct.Struct("<QQQQ8s")  # documents, ids, place of the document table, place of the block offsets, magic


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive groups of so many bits, low bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """Inverse of pack_bits for n ids."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class IdWriter:
    """Writes documents one after the other; holds a block and the tables in memory."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.at = self.sink.write(HEAD.pack(MAGIC, bits, block)) or HEAD.size
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.offsets: list[int] = []
        self.docs: list[tuple] = []  # (doc_id or None, ids)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self._put(ids)

    def _put(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.waiting)
            whole = len(every) // self.block * self.block
            for lo in range(0, whole, self.block):
                self._block(every[lo : lo + self.block])
            self.waiting, self.held = [every[whole:]], len(every) - whole

    def add_all(self, doc_ids: list, sizes: list[int], ids: np.ndarray) -> None:
        """As add(), for documents whose ids follow one another in one array."""
        self.docs += zip(doc_ids, sizes)
        self._put(ids)

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        table = np.array([(0 if d is None else d, d is None, n) for d, n in self.docs], [("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")]).tobytes()
        offsets = np.array(self.offsets, "<u8").tobytes()
        self.sink.write(table + offsets + FOOT.pack(len(self.docs), self.ids, self.at, self.at + len(table), MAGIC))


class IdReader:
    """Random access to the ids of a file that IdWriter wrote."""

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.block = HEAD.unpack(self._at(0, HEAD.size))
        size = source.size()
        n, self.ids, table, offsets, end = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a file of packed ids")
        self.docs = np.frombuffer(self._at(table, offsets - table), [("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])
        self.offsets = np.frombuffer(self._at(offsets, size - FOOT.size - offsets), "<u8")
        self.ends = np.append(self.offsets[1:], table) if len(self.offsets) else self.offsets
        self.starts = np.concatenate([[0], np.cumsum(self.docs["n"].astype(np.int64))])
        assert len(self.docs) == n

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(int(n))

    def blocks(self, lo: int, hi: int):
        """The ids lo to hi - 1, in runs of a block at most."""
        for b in range(lo // self.block, -(-hi // self.block) if hi > lo else 0):
            first = b * self.block
            ids = unpack_bits(self._at(self.offsets[b], self.ends[b] - self.offsets[b]), self.bits, min(self.block, self.ids - first))
            yield ids[max(lo - first, 0) : hi - first]

    def document(self, i: int) -> np.ndarray:
        """The ids of document i of this file."""
        return np.concatenate([np.zeros(0, "<u4"), *self.blocks(int(self.starts[i]), int(self.starts[i + 1]))])


def write_ids(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, vocabulary: int = VOCABULARY, end_id: int = END_ID) -> list[dict]:
    """Writes the ids of all documents in ascending id order; returns the files in that order.

    Documents are range-partitioned by id and each partition writes one file
    under ``folder`` (a URI that executors can write; by default a new one in
    the shared folder, which goes when the session's JVM ends). A file gets its name when it is complete, so attempts
    that were lost or ran twice leave nothing half written. Each entry has path,
    n_docs, n_tokens and first (ids in the files before); there is one for each
    partition, whatever the number of documents.

    Null ids come first, repeated ids in order of the hash of their text, so that
    one id with very many rows can span files; null text counts
    as empty and gives the end id alone. No rows give no files.
    """
    spark = docs.sparkSession
    folder = folder or deleted_at_exit(spark, fresh_path(spark, "ids"))
    bits = bits_for(vocabulary)

    def run(batches):
        writer = None
        for batch in batches:
            if writer is None:
                part = TaskContext.get().partitionId()
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                path, draft = f"{base}/part-{part:06d}.plbits", f"{base}/.draft-{part:06d}-{uuid.uuid4().hex}"
                sink = store.open_output_stream(draft)
                enc, writer = encoder(tokenizer, spaced=True), IdWriter(sink, bits)
            doc_ids = batch.column(0).to_pylist()
            for first, texts in runs(batch.column(1)):
                ids, offsets = enc.encode(texts)
                writer.add_all(doc_ids[first : first + len(texts)], (np.diff(offsets) + 1).tolist(), np.insert(ids, offsets[1:], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            sink.close()
            store.move(draft, path)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}.plbits"], "n_docs": [len(writer.docs)], "n_tokens": [writer.ids]})

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    files = [r.asDict() for r in ordered.mapInArrow(run, "part long, path string, n_docs long, n_tokens long").collect()]  # a row for each partition
    first = 0
    for f in sorted(files, key=lambda f: f["part"]):
        f["first"] = first
        first += f["n_tokens"]
    return sorted(files, key=lambda f: f["part"])


def read_ids(spark, files: list[dict], ids: bool = False) -> DataFrame:
    """Documents from the files of write_ids: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary).

    ``start`` counts the ids of all documents before; ids_crc32 is the unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def run(batches):
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids
        rows = Rows(pa.schema(fields))
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    reader, b, block, begin = IdReader(source), -1, None, 0
                    starts, size = reader.starts.tolist(), reader.block
                    for (doc_id, null, n), lo in zip(reader.docs.tolist(), starts):
                        at, hi, crc, parts = lo, lo + n, 0, []
                        while at < hi:  # each block is unpacked once
                            if at // size != b:
                                b = at // size
                                begin = b * size
                                block = next(reader.blocks(begin, min(begin + size, reader.ids)))
                            data = block[at - begin : hi - begin]
                            crc = zlib.crc32(data, crc)
                            at += len(data)
                            if ids:
                                parts.append(data.tobytes())
                        rows.add(None if null else doc_id, first + lo, n, crc, *[b"".join(parts)] * ids, size=32 + 4 * n * ids)
                        if rows.full:
                            yield rows.batch()
        if rows.columns[0]:
            yield rows.batch()

    listing = spark.createDataFrame([(f["path"], f["first"]) for f in files], "path string, first long")
    return listing.repartition(max(1, len(files))).mapInArrow(trimmed(run), schema)
