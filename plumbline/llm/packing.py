"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of
``max_tokens`` as fit, then the binary digits of the rest from high to low. Each
piece is a sequence of its own, so no sequence crosses documents and none needs
padding. Equal lengths form a bucket, and the sequences of a bucket are dealt to
batches of about the same number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import REMEMBER, RUN_BYTES, encoder, runs
from .shared import Rows, trimmed

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_TOKENS = 4096
#: Tokens of a full batch; a batch holds sequences of one bucket.
BATCH_TOKENS = 65_536


def piece_lengths(n: int, most: int) -> Iterator[int]:
    """Powers of two, high to low, that add up to n and are at most ``most``."""
    while n > 0:
        piece = min(most, 1 << (n.bit_length() - 1))
        yield piece
        n -= piece


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, batch_tokens: int = BATCH_TOKENS, remember: int = REMEMBER, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, batch_id, batch_row, bucket, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit ids, ``start`` counts the
    document's ids before the piece, ``doc_tokens`` its ids with the end id.
    ``bucket`` equals the length; ``offset`` is 0, as a sequence is one piece.
    ``sequence_id`` is unique and follows the input's partitions and row order.
    ``batch_id`` names a batch of sequences of one bucket, ``batch_tokens`` long
    or one sequence if that is longer, and ``batch_row`` the place in it (from
    0); each task fills batches of its own, so the last of a bucket may be short.

    ``remember`` bounds the units whose ids a worker keeps, ``run_bytes`` the text
    that it encodes at once; neither changes a result.

    A null or empty text is one piece that holds the end id. Rows are documents:
    null and repeated ids stay as they are. No rows give no rows. Other input
    columns are not carried, so their names can't clash. Nothing is shuffled.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    kind = docs.schema[id_col].dataType
    end = np.uint32(end_id)

    def run(batches):
        enc = encoder(tokenizer, spaced=False, most=remember)
        rows, task, filled = None, TaskContext.get().partitionId(), {}
        for batch in batches:
            if rows is None:
                rows = Rows(pa.schema([("doc_id", batch.schema.types[0]), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("batch_id", pa.int64()), ("batch_row", pa.int64())]))
            doc_ids = batch.column(0).to_pylist()
            for first, texts in runs(batch.column(1), run_bytes):
                ids, offsets = enc.encode(texts)
                for i in range(len(texts)):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], end).astype("<u4")
                    data, start = own.tobytes(), 0
                    for length in piece_lengths(len(own), max_tokens):
                        filled[length] = n = filled.get(length, -1) + 1
                        number, row = divmod(n, max(1, batch_tokens // length))
                        rows.add(doc_ids[first + i], start, length, data[4 * start : 4 * (start + length)], len(own), task << 40 | length.bit_length() << 34 | number, row, size=4 * length + 80)
                        start += length
                        if rows.full:
                            yield rows.batch()
        if rows is not None and rows.columns[0]:
            yield rows.batch()

    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run if remember >= REMEMBER else trimmed(run), f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, batch_id long, batch_row long")
    return pieces.select("*", F.col("length").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
