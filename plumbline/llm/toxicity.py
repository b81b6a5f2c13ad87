"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are white-space separated; each has a weight from its lower-cased letters
and their prefixes and suffixes, and a 2 x 2 table of transitions links
neighbours. Forward-backward marginals give every token's probability of being
toxic; a logistic model turns a document's marginals into its score.

Labels are of documents, so token labels are derived: within toxic documents a
token counts as toxic when a form of it (word or prefix) is found in many of
them and in hardly any clean one. Training is deterministic and uses a bounded
sample of labelled documents, weighted to the classes' shares among all of them;
scoring covers every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Rows, pieces, rows_where, trimmed

THRESHOLD = 0.3
#: Bounds of the training sample: documents of each class, and characters of a document.
SAMPLE_DOCS = 1_500
SAMPLE_CHARS = 8_000
#: A form marks toxic tokens if chance alone gives it so many toxic documents less often than exp(-SURPRISE).
SURPRISE = 10.0
#: ... and if it is so many times as frequent in toxic documents as in clean ones.
RATIO = 6
#: Letters of the prefixes that are features of a word.
PREFIXES = (4, 5, 6, 7, 8)
SEGMENT = 64
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
TOKEN = re.compile(r"\S+")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def core(token: str) -> str:
    """A token's lower-cased text without outer punctuation and digits."""
    return EDGES.sub("", token.lower())


def forms(word: str) -> list[str]:
    """Feature names of a word: itself, its prefixes of 4 to 8 letters, its last 3 letters."""
    if not word:
        return []
    return ["=" + word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n), *(["-" + word[-3:]] if len(word) > 3 else [])]


def surprise(a: int, n: int, share: float) -> float:
    """Minus the log of (about) the chance that so many of n documents are toxic where each is with that share."""
    part = a / n
    return n * (part * math.log(part / share) + ((1 - part) * math.log((1 - part) / (1 - share)) if a < n else 0)) if part > share else 0.0


def marginals(weights: np.ndarray, first: np.ndarray, last: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact forward-backward over a stream of two-state chains.

    weights: log weight of state 1 against 0 for each token; first and last mark
    the ends of chains; moves: 2 x 2 log transitions. Returns the odds a and b of
    state 1 in the forward and backward messages (a includes the token, b does
    not), the token weights' exponentials and exp(moves). The recursions are
    Moebius maps; segments are composed side by side, so numpy does the work.
    """
    n = len(weights)
    e, t = np.exp(np.clip(weights, -30, 30)), np.exp(moves)
    if not n:
        return e, e, e, t
    pad = -n % SEGMENT

    def scan(out: np.ndarray, reset: np.ndarray, m: tuple) -> np.ndarray:
        """r[i] = out[i] * (m10 + m11 r) / (m00 + m01 r) with r = r[i - 1]; after a reset r[i] = out[i]."""
        keep = np.concatenate([np.where(reset, 0.0, 1.0), np.zeros(pad)]).reshape(-1, SEGMENT).T
        o = np.concatenate([out, np.ones(pad)]).reshape(-1, SEGMENT).T
        m00, m01, m10, m11 = m
        # (A r + B) / (C r + D) of each step
        A, B, C, D = o * keep * m11, o * np.where(keep > 0, m10, 1.0), keep * m01, np.where(keep > 0, m00, 1.0)
        pa_, pb, pc_, pd_ = A[0].copy(), B[0].copy(), C[0].copy(), D[0].copy()
        for i in range(1, SEGMENT):
            pa_, pb, pc_, pd_ = A[i] * pa_ + B[i] * pc_, A[i] * pb + B[i] * pd_, C[i] * pa_ + D[i] * pc_, C[i] * pb + D[i] * pd_
            if i % 4 == 3:
                s = 1 / np.maximum.reduce([pa_, pb, pc_, pd_])
                pa_, pb, pc_, pd_ = pa_ * s, pb * s, pc_ * s, pd_ * s
        start, r = np.empty(len(pa_)), 1.0
        for k, (qa, qb, qc, qd) in enumerate(zip(pa_.tolist(), pb.tolist(), pc_.tolist(), pd_.tolist())):
            start[k] = r
            r = (qa * r + qb) / (qc * r + qd)
        r, all_r = start, np.empty_like(o)
        for i in range(SEGMENT):
            r = (A[i] * r + B[i]) / (C[i] * r + D[i])
            all_r[i] = r
        return all_r.T.ravel()[:n]

    a = scan(e, first, (t[0, 0], t[1, 0], t[0, 1], t[1, 1]))
    # g[i] = e[i] * b[i]; b[i] = (t10 + t11 g[i + 1]) / (t00 + t01 g[i + 1])
    g = scan(e[::-1], last[::-1], (t[0, 0], t[0, 1], t[1, 0], t[1, 1]))[::-1]
    return a, g / e, e, t


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    #: Weights of doc_features; none: nothing was learnt.
    calibration: np.ndarray | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.calibration is None else 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))

    def weight(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in forms(core(token)))


def doc_features(odds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the score is made from: 1, clipped best log odds, log expected toxic tokens, their share."""
    n = np.diff(offsets)
    out = np.zeros((len(n), 4))
    out[:, 0], out[:, 1] = 1, -8
    has = n > 0
    if has.any():
        p = odds / (1 + odds)
        total = np.add.reduceat(p, offsets[:-1][has])
        out[has, 1] = np.clip(np.log(np.maximum.reduceat(odds, offsets[:-1][has])), -8, 8)
        out[has, 2] = np.log1p(total)
        out[has, 3] = np.sqrt(total / n[has])
    return out


def _offsets(split: list[list[str]]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)


def _ends(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(offsets[-1], bool), np.zeros(offsets[-1], bool)
    has = np.diff(offsets) > 0
    first[offsets[:-1][has]] = True
    last[offsets[1:][has] - 1] = True
    return first, last


def _unlike(texts: list[str]) -> list[str]:
    """One text for each two smallest hashes of its word triples: near copies would count as evidence many times."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.split()
        marks = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:2]
        if not seen.intersection(marks):
            out.append(text)
        seen.update(marks)
    return out


def train(toxic: list[str], clean: list[str], counts: tuple[int, int] | None = None, rounds: int = 60) -> Model:
    """A model from the texts of toxic and of clean documents; either list may be empty.

    counts: how many texts of each class they were sampled from, if not all;
    scores are probabilities at the shares that the classes have there. Without
    texts of both classes nothing can be told apart: every score is 0, so that
    nothing is predicted toxic and no document is rejected.
    """
    n_toxic, n_clean = counts or (len(toxic), len(clean))
    moves = np.zeros((2, 2))
    fit_toxic, fit_clean = _unlike(toxic), _unlike(clean)
    if not fit_toxic or not fit_clean:
        return Model({}, -4.0, moves, None)
    seen = [Counter(), Counter()]
    for y, texts in ((1, fit_toxic), (0, fit_clean)):
        for text in texts:
            seen[y].update({f for t in set(text.split()) for f in forms(core(t)) if f[0] != "-"})
    n1, n0 = len(fit_toxic), len(fit_clean)
    marks = {f for f, a in seen[1].items() if a / n1 > RATIO * seen[0][f] / n0 and surprise(a, a + seen[0][f], n1 / (n1 + n0)) > SURPRISE}
    split = [t.split() for t in fit_toxic + fit_clean]
    offsets = _offsets(split)
    first, last = _ends(offsets)
    kept: dict[str, int] = {}
    for f, a in seen[1].items():
        if a + seen[0][f] >= 4:
            kept[f] = len(kept)
    tails = Counter("-" + core(t)[-3:] for s in split for t in set(s) if len(core(t)) > 3)
    kept |= {f: len(kept) + i for i, f in enumerate(f for f, a in tails.items() if a >= 4)}
    known: dict[str, tuple[list[int], bool]] = {}
    for s in split:
        for t in s:
            if t not in known:
                own = forms(core(t))
                known[t] = [kept[f] for f in own if f in kept], any(f in marks for f in own)
    flat = [known[t] for s in split for t in s]
    y = np.array([hit for _, hit in flat], float)
    y[offsets[n1] :] = 0
    where = np.repeat(np.arange(len(flat)), [len(f) for f, _ in flat])
    which = np.array([i for f, _ in flat for i in f], np.int64)
    w, bias = np.zeros(len(kept) + 1), -3.0
    moves[:] = [[0, 0], [0, 0]]
    # Adam on the conditional log-likelihood with an L2 penalty
    theta = np.concatenate([w[:-1], [bias], moves.ravel()])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    inside = ~first
    prev = np.flatnonzero(inside) - 1
    pair = np.bincount((2 * y[prev] + y[prev + 1]).astype(int), minlength=4)
    for step in range(1, rounds + 1):
        em = theta[len(kept)] + np.bincount(where, theta[: len(kept)][which], len(flat))
        a, b, e, t = marginals(em, first, last, theta[-4:].reshape(2, 2))
        p = a * b / (1 + a * b)
        joint = np.empty((4, len(prev)))
        g = e[prev + 1] * b[prev + 1]
        joint[0], joint[1], joint[2], joint[3] = t[0, 0], t[0, 1] * g, a[prev] * t[1, 0], a[prev] * t[1, 1] * g
        joint /= joint.sum(axis=0)
        gap = y - p
        grad = np.concatenate([np.bincount(which, gap[where], len(kept)), [gap.sum()], pair - joint.sum(axis=1)]) - 0.05 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta + 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weights = {f: round(float(theta[i]), 4) for f, i in kept.items() if abs(theta[i]) > 0.02}
    model = Model(weights, float(theta[len(kept)]), theta[-4:].reshape(2, 2), None)
    # the score's weights, from all sampled documents, weighted to the shares that the classes have in all documents
    every = [t.split() for t in toxic + clean]
    x = doc_features(_odds(model, every, {}), _offsets(every))
    target = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    n = len(every)
    each = np.where(target == 1, n_toxic / len(toxic), n_clean / len(clean)) * n / (n_toxic + n_clean)
    c = np.zeros(4)
    for _ in range(30):  # Newton steps, with a ridge
        q = 1 / (1 + np.exp(-x @ c))
        c += np.linalg.solve((x * (each * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 0.3, 0.3, 0.3]), x.T @ (each * (target - q)) - np.array([1e-3, 0.3, 0.3, 0.3]) * c)
    model.calibration = c
    return model


def _odds(model: Model, split: list[list[str]], known: dict[str, float]) -> np.ndarray:
    """Every token's odds of being toxic, document after document."""
    weights = []
    for tokens in split:
        for t in set(tokens).difference(known):
            known[t] = model.weight(t)
        weights.append(np.fromiter(map(known.__getitem__, tokens), float, len(tokens)))
    first, last = _ends(_offsets(split))
    a, b, _, _ = marginals(np.concatenate([np.zeros(0), *weights]), first, last, model.moves)
    return a * b


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str], tuple[int, int]]:
    """Texts of labelled toxic and clean documents that may be learnt from, and how many there are of each class in all.

    At most ``most_docs`` ids of each class, the smallest by a hash of the id;
    of their documents those of at most ``most_chars`` characters, and at most
    ``most_docs`` different texts of each class. A document with several labels has the largest. Null ids and labels are left out. Equal
    texts of a class count once, told apart by 64-bit hashes where all are counted.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    once = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    chosen = None
    for y in (1, 0):
        part = once.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") <= most_chars)
    rows = texts.join(F.broadcast(chosen), "__id").select("__y", "__text").distinct()
    got: dict[int, set] = defaultdict(set)
    for y in (1, 0):  # an id may have many texts
        got[y].update(r[0] for r in rows.where(F.col("__y") == y).select("__text").orderBy(F.xxhash64("__text"), "__text").limit(most_docs).collect())
    marks = texts.select("__id", F.xxhash64("__text").alias("__mark")).join(once, "__id").select("__y", "__mark").distinct()
    counts = {r["__y"]: r["count"] for r in marks.groupBy("__y").count().collect()}
    return *(sorted(got[y], key=lambda s: (zlib.crc32(s.encode()), s)) for y in (1, 0)), (counts.get(1, 0), counts.get(0, 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every document: doc_id, score, predicted, n_toxic (expected toxic tokens), spans.

    ``spans`` lists the offending tokens, those with a probability of at least
    a half, as start and end (code points) and probability. Null and empty texts
    have no tokens and the score of such. Repeated and null ids stay rows of
    their own; no rows give no rows; other columns are not carried.
    """
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        known: dict[str, float] = {}
        for batch in pieces(batches):
            rows = Rows(pa.schema([("doc_id", batch.schema.types[0]), ("score", pa.float64()), ("predicted", pa.int32()), ("n_toxic", pa.float64()), ("spans", span)]))
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, scores, x, odds, offsets in _scored(sent.value, texts, known):
                marked = np.concatenate([[0], np.cumsum(odds >= 1)])
                for i in range(len(scores)):
                    spans = []
                    if marked[offsets[i + 1]] > marked[offsets[i]]:
                        own = odds[offsets[i] : offsets[i + 1]].tolist()
                        places = TOKEN.finditer(texts[lo + i])
                        spans = [{"start": m.start(), "end": m.end(), "probability": o / (1 + o)} for m, o in zip(places, own) if o >= 1]
                    rows.add(ids[lo + i], float(scores[i]), int(scores[i] >= threshold), float(np.expm1(x[i, 2])), spans)
            yield rows.batch()

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(trimmed(run), f"doc_id {kind.simpleString()}, score double, predicted int, n_toxic double, spans array<struct<start: long, end: long, probability: double>>")


def _scored(model: Model, texts: list[str], known: dict[str, float]):
    """(first, scores, features, odds, offsets) of runs of texts of bounded size."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < 4_000_000):
            size += len(texts[hi])
            hi += 1
        if len(known) > 300_000:
            known.clear()
        split = [t.split() for t in texts[lo:hi]]
        offsets, odds = _offsets(split), _odds(model, split, known)
        x = doc_features(odds, offsets)
        yield lo, model.scores(x), x, odds, offsets
        lo = hi


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold. Rows are judged one by one, whatever their ids."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        known: dict[str, float] = {}

        def mask(texts: list[str]) -> list[bool]:
            return [bool(s < threshold) for _, scores, *_ in _scored(sent.value, texts, known) for s in scores]

        return mask

    return rows_where(docs, text_col, decide)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learns from the labelled documents among docs and scores all of them; see score()."""
    return score(docs, train(*sample(docs, labels)), **options)
