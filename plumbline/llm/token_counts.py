"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; the dynamic
program carries the best score and its number of pieces, and no pieces. Rules,
as in the tokenizers library's unigram model: scores add up in double precision;
at equal scores the earlier start, that is the longer last piece, stays; a
character that is no piece of its own costs the lowest score less 10 and counts
as its UTF-8 bytes. Text is prepared as the vocabulary's own model does: one
space before it, then every space as U+2581.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import tokenizer_path
from .shared import Rows, pieces, trimmed

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def pieces_of(name_or_path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name_or_path))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of texts; remembers up to ``most`` distinct units."""

    def __init__(self, pieces: list[tuple[str, float]], most: int = 600_000):
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        #: A unit may end before a space and at a line feed only if no piece runs across.
        self.cut_space = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.cut_line = not any("\n" in p for p, _ in pieces)
        self.most, self.known, self.heads = most, {}, {}

    def viterbi(self, text: str) -> int:
        """Pieces on the best path through the whole of text."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at = 0
        matches = self.automaton.iter(text)
        end, (length, gain) = next(matches, (n, (0, 0.0)))
        while at < n:
            best, pieces, single = None, 0, False
            while end == at:  # longest first, so earlier starts first
                start = at + 1 - length
                total = score[start] + gain
                if best is None or total > best:
                    best, pieces = total, count[start] + 1
                single |= length == 1
                end, (length, gain) = next(matches, (n, (0, 0.0)))
            if not single:
                total = score[at] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[at] + len(text[at].encode("utf-8", "surrogatepass"))
            at += 1
            score[at], count[at] = best, pieces
        return count[n]

    def _of(self, units: list[str], known: dict[str, int], before: str) -> int:
        try:
            return sum(map(known.__getitem__, units))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for unit in units:
                if unit not in known:
                    known[unit] = self.viterbi(before + unit)
            return sum(map(known.__getitem__, units))

    def count(self, text: str) -> int:
        """Pieces of a text; an empty one has none."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not (self.cut_space and self.cut_line):
            return self.viterbi(text)
        lines = text.split("\n")
        total = len(lines) - 1  # a line feed is unknown: one byte
        if SPACE * 2 in text:
            for line in lines:
                total += self._of(re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line), self.heads, "")
            return total
        for line in lines:
            head, *units = line.split(SPACE)
            total += self._of([head], self.heads, "") + self._of(units, self.known, SPACE)
        return total


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's number of tokens: doc_id, n_tokens.

    Null and empty texts have 0. Repeated and null ids stay rows of their own;
    no rows give no rows; other columns are not carried. Time is linear in a
    text's length, and nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(pieces_of(vocabulary))
        counter, rows = _COUNTERS[vocabulary], None
        for batch in pieces(batches):
            rows = rows or Rows(pa.schema([("doc_id", batch.schema.types[0]), ("n_tokens", pa.int64())]))
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.add(doc_id, counter.count(text or ""))
            yield rows.batch()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), f"doc_id {kind.simpleString()}, n_tokens long")
