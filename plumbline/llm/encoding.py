"""Token ids by the tokenizers library, remembered for each distinct unit of text.

A unit is a stretch that the tokenizer's pre-tokenizer can never join with its
neighbours, so the ids of a text are those of its units in order. Units repeat
often: Arrow finds the distinct ones of a batch, the library encodes those that
are not known yet, and numpy puts the ids of the texts together.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker remembers; about 200 bytes each.
REMEMBER = 1_000_000
#: Bytes of text that are encoded at once; a worker needs about 20 times as much meanwhile.
RUN_BYTES = 8 << 20
#: Where a cut before a single space would not be exact: white space beside a
#: space, and white space other than space and line feed.
UNSAFE = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]|  | \n|\n "


def tokenizer_path(name_or_path: str) -> str:
    """The path itself, or the place of a public tokenizer file of that name."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class UnitEncoder:
    """Encodes whole texts to unsigned 32-bit ids.

    ``spaced``: units keep the space before them (byte-level vocabularies);
    otherwise the tokenizer drops white space and units are words.
    ``most``: entries kept before the memory starts anew.
    """

    def __init__(self, name_or_path: str, spaced: bool, most: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name_or_path))
        special = max((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
        self.mark_id, self.mark = special  # never joins with what stands beside it
        self.spaced, self.most = spaced, most
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as little-endian bytes, without the memory."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of many short units: runs of them share a call, a special token between each two."""
        out: list[bytes] = []
        runs = [units[lo : lo + 64] for lo in range(0, len(units), 64)]
        joined = [None if any(self.mark in u for u in run) else self.mark.join(run) for run in runs]
        coded = iter(self.tokenizer.encode_batch_fast([j for j in joined if j is not None], add_special_tokens=False))
        for run, text in zip(runs, joined):
            if text is None:
                out += self.whole(run)
                continue
            ids = np.array(next(coded).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            data = ids.tobytes()
            lo = 0
            for hi in [*(4 * cuts).tolist(), len(data)]:
                out.append(data[lo:hi])
                lo = hi + 4
        return out

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, from the memory where it has them."""
        if len(self.known) > self.most:
            self.known.clear()
        out = list(map(self.known.get, units))
        missing = [i for i, ids in enumerate(out) if ids is None]
        prefix = " " if self.spaced else ""
        for lo in range(0, len(missing), 100_000):
            part = missing[lo : lo + 100_000]
            names = [units[i] for i in part]
            found = self._encode_units([prefix + u for u in names] if prefix else names)
            self.known.update(zip(names, found))
            for i, ids in zip(part, found):
                out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]. Null is empty."""
        texts = pc.fill_null(texts, "")
        plain = texts
        odd = np.zeros(len(texts), bool)
        if self.spaced:
            odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
            if odd.any():
                plain = pc.if_else(pa.array(odd), "", texts)
        else:
            plain = pc.replace_substring(texts, "\n", " ")
        units = pc.split_pattern(plain, " ")
        firsts = units.offsets.to_numpy()
        coded = units.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        parts = self._ids_of(coded.dictionary.to_pylist())
        if self.spaced:  # the first unit of a text has no space before it
            heads = [t.as_py() if bad else u for t, bad, u in zip(texts, odd, units.flatten().take(pa.array(firsts[:-1])).to_pylist())]
            index[firsts[:-1]] = np.arange(len(parts), len(parts) + len(heads))
            parts += self.whole(heads)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        places = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(parts), "<u4")
        own = sizes[index]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = pool[np.repeat(places[index] - ends[:-1], own) + np.arange(ends[-1])]
        return ids, ends[firsts]


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(name_or_path: str, spaced: bool, most: int = REMEMBER) -> UnitEncoder:
    """One encoder for each Python worker and tokenizer; one of its own for each task if it remembers less."""
    if most < REMEMBER:
        return UnitEncoder(name_or_path, spaced, most)
    key = (name_or_path, spaced, most)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(name_or_path, spaced, most)
    return _ENCODERS[key]


def runs(texts: pa.Array, most_bytes: int = RUN_BYTES):
    """(first, texts) slices of bounded size, one text at least."""
    texts = texts.cast(pa.large_string())
    lo = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > most_bytes:
            yield lo, texts.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, texts.slice(lo)
