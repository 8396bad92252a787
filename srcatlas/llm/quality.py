"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote good, bad or nothing on each document.
2. Expectation-maximisation over the counts of vote patterns (at most 3**9 of
   them, counted over all documents) estimates each labeller's accuracy, and from
   these the posterior that a document of each pattern is good.
3. Posterior labels train a hashed linear scorer (logistic regression on hashed
   byte triplets and on the labellers' hashed measurements). Training rows are a
   sample of at most about SAMPLE documents by hash of the id; everything else
   covers all documents.
4. Every whole text is scored; a document is kept when its score is at least 0.5.

A text without words (null, empty, only white space) scores 0 and is not kept.
Rows repeat as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, prepared, typed
from .text import SLICE_BYTES, buffers, row_starts, slices, word_hashes

#: Most rows, on average, that the scorer is trained on; width of its hashed features.
SAMPLE, WIDTH, MEASURE_SLOTS = 6000, 2048, 16
LABELLERS = ("symbols", "capitals", "variety", "word_length", "clean_ends", "short_words", "sentences", "digits", "repeats")
#: Limits of each labeller: (good from, good to, bad below, bad above); a measurement outside both says nothing.
LIMITS = np.array(
    [
        [0.0, 0.01, -1.0, 0.05],
        [0.0, 0.15, -1.0, 0.40],
        [0.50, 1.0, 0.30, 2.0],
        [3.0, 8.0, 2.0, 11.0],
        [0.90, 1.0, 0.60, 2.0],
        [0.20, 0.80, 0.05, 0.95],
        [0.01, 0.40, -1.0, 0.70],
        [0.0, 0.05, -1.0, 0.20],
        [0.0, 0.05, -1.0, 0.15],
    ]
)
#: Fewest words from which a labeller votes.
LEAST = np.array([1, 3, 20, 1, 1, 20, 20, 30, 10])
#: Words whose variety is measured at a time, so that long texts are held to the same limits as short ones.
WINDOW = 200

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}[]=~^_\\@+`")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END_OK = _ALPHA | _DIGIT
_END_OK[list(b".,;:?\"')")] = True


def measured(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, measurements rows x labellers)."""
    n = len(offsets) - 1
    out = np.zeros((n, len(LABELLERS)))
    if not len(data):
        return np.zeros(n, np.int64), out
    h, starts, ends, counts = word_hashes(data, offsets)
    edges = row_starts(counts)

    def total(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts])

    chars, words = np.maximum(np.diff(offsets), 1), np.maximum(counts, 1)
    letters = np.maximum(total(_ALPHA[data], offsets), 1)
    out[:, 0] = total(_SYMBOL[data], offsets) / chars
    out[:, 1] = total(_UPPER[data], offsets) / letters
    row = np.repeat(np.arange(n), counts)
    window = (np.arange(len(h)) - edges[row]) // WINDOW
    seen = np.unique(h ^ ((row * 1_000_003 + window).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out[:, 2] = np.bincount(row[seen], minlength=n) / words
    size = ends - starts
    shown = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out[:, 3] = total(shown[ends] - shown[starts], edges) / words
    out[:, 4] = total(_END_OK[data[ends - 1]], edges) / words
    out[:, 5] = total(size <= 3, edges) / words
    out[:, 6] = total(np.isin(data[ends - 1], np.frombuffer(b".?!", np.uint8)), edges) / words
    out[:, 7] = total(_DIGIT[data], offsets) / chars
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out[:, 8] = total(same, edges) / words
    return counts, out


def votes(counts: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """0 nothing, 1 bad, 2 good, for each row and labeller."""
    low, high, under, over = LIMITS.T
    out = np.where((measures >= low) & (measures <= high), 2, np.where((measures < under) | (measures > over), 1, 0))
    return np.where(counts[:, None] >= LEAST, out, 0)


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


class Posterior:
    """Accuracies of the labellers by expectation-maximisation; the posterior of a pattern."""

    def __init__(self, patterns: np.ndarray, weight: np.ndarray, rounds: int = 100):
        v = self._unpacked(patterns)
        self.prior, self.accuracy = 0.8, np.full((2, len(LABELLERS)), 0.8)
        if not len(patterns):
            return
        p = np.clip(0.5 + 0.5 * ((v == 2).sum(1) - (v == 1).sum(1) * 2) / np.maximum((v > 0).sum(1), 1), 0.02, 0.98)
        for _ in range(rounds):
            w = weight * p, weight * (1 - p)
            self.prior = (w[0].sum() + 8) / (weight.sum() + 10)
            # the share of right votes in each class, with a belief: a labeller seldom calls a good text bad,
            # and sees a part of the bad ones
            for c, (right, belief, trust) in enumerate(((2, 0.995, 0.2), (1, 0.4, 0.5))):
                k = trust * w[c].sum() + 1
                self.accuracy[c] = (((v == right) * w[c][:, None]).sum(0) + belief * k) / (((v > 0) * w[c][:, None]).sum(0) + k)
            p = self._of(v)

    @staticmethod
    def _unpacked(patterns: np.ndarray) -> np.ndarray:
        return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3

    def _of(self, v: np.ndarray) -> np.ndarray:
        good, bad = np.log(self.accuracy), np.log(1 - self.accuracy)
        a = np.log(self.prior) + np.where(v == 2, good[0], np.where(v == 1, bad[0], 0)).sum(1)
        b = np.log(1 - self.prior) + np.where(v == 1, good[1], np.where(v == 2, bad[1], 0)).sum(1)
        return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))

    def of(self, patterns: np.ndarray) -> np.ndarray:
        return self._of(self._unpacked(np.asarray(patterns)))


def features(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """Hashed features (rows x WIDTH): square roots of the shares of byte triplets, and a slot for the band of
    every measurement."""
    n, room = len(offsets) - 1, WIDTH - len(LABELLERS) * MEASURE_SLOTS
    flat = np.zeros(n * room)
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES + 2].astype(np.uint32)
        m = min(len(part) - 2, SLICE_BYTES)
        if m <= 0:
            break
        h = (part[:m] | (part[1 : m + 1] << np.uint32(8)) | (part[2 : m + 2] << np.uint32(16))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        first = np.arange(at, at + m)
        ends = np.searchsorted(offsets, first, "right")
        inside = offsets[ends] - first > 2
        flat += np.bincount(((ends - 1) * room + (h >> np.uint32(8)) % np.uint32(room))[inside], minlength=n * room)
    out = np.zeros((n, WIDTH), np.float32)
    share = flat.reshape(n, room)
    out[:, :room] = np.sqrt(share / np.maximum(share.sum(axis=1), 1)[:, None])
    scale = np.maximum(LIMITS[:, 3], 1e-9) * 2
    scale[LIMITS[:, 3] >= 2] = 1.0
    scale[3] = 16.0
    band = np.clip((measures / scale * MEASURE_SLOTS).astype(np.int64), 0, MEASURE_SLOTS - 1)
    slot = room + np.arange(len(LABELLERS)) * MEASURE_SLOTS + band
    voting = counts[:, None] >= LEAST
    out[np.nonzero(voting)[0], slot[voting]] = 0.5
    return out


class Scorer:
    """Logistic regression on hashed features, fitted to posterior labels by gradient descent with momentum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4):
        self.w, self.b = np.zeros(WIDTH, np.float32), np.float32(2.0)
        if not len(y):
            return
        # both classes count alike, so that a rare one is not outvoted
        weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1)).astype(np.float32)
        weight /= weight.sum()
        step, vw, vb = np.float32(4.0), np.zeros_like(self.w), np.float32(0)
        for _ in range(rounds):
            off = (1 / (1 + np.exp(-(x @ self.w + self.b))) - y).astype(np.float32) * weight
            vw = np.float32(0.9) * vw - step * (x.T @ off + np.float32(ridge) * self.w)
            vb = np.float32(0.9) * vb - step * np.float32(off.sum())
            self.w, self.b = self.w + vw, self.b + vb

    def of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -50, 50).astype(np.float64)))


def _patterns(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, d, o in slices(data, offsets):
                counts, m = measured(d, o)
                np.add.at(seen, pattern(votes(counts, m))[counts > 0], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pattern", "n"])

    rows = mapped(docs.select(text), run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return np.array([r.pattern for r in rows], np.int64), np.array([r.n for r in rows], np.float64)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[Posterior, Scorer]:
    prepared(docs.sparkSession)
    patterns, weight = _patterns(docs, text)
    labels = Posterior(patterns, weight)
    total = max(1.0, weight.sum())
    share = int(min(1.0, sample / total) * (1 << 30))
    chosen = docs.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share) if share < 1 << 30 else docs

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, d, o in slices(data, offsets):
                counts, m = measured(d, o)
                has = counts > 0
                x = features(d, o, counts, m)[has]
                packed = np.minimum(np.round(x * 255), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(pattern(votes(counts, m))[has])], ["x", "pattern"])

    rows = mapped(chosen.select(text), run, "x binary, pattern long").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    y = labels.of(rows["pattern"].to_numpy()) if len(x) else np.zeros(0)
    order = np.lexsort((x[:, :64].astype(np.int64).sum(1), rows["pattern"].to_numpy())) if len(x) else []
    return labels, Scorer(x[order].astype(np.float32) / 255, y[order].astype(np.float32))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None, sample: int = SAMPLE) -> DataFrame:
    """keep's columns (key by default) with n_words, posterior (of the votes), score and kept."""
    spark, keep = docs.sparkSession, keep or (key,)
    model = spark.sparkContext.broadcast(fit(docs, key, text, sample))

    def run(batches):
        labels, scorer = model.value
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            for a, b, d, o in slices(data, offsets):
                counts, m = measured(d, o)
                score = np.zeros(b - a)
                for k in range(0, b - a, 512):
                    e = min(k + 512, b - a)
                    score[k:e] = scorer.of(features(d[o[k] : o[e]], o[k : e + 1] - o[k], counts[k:e], m[k:e]))
                score = np.where(counts > 0, score, 0.0)
                good = np.where(counts > 0, labels.of(pattern(votes(counts, m))), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(batch.num_columns - 1)), pa.array(counts), pa.array(good), pa.array(score), pa.array(score >= 0.5)], [*keep, "n_words", "posterior", "score", "kept"])

    schema = typed(docs, keep, "n_words long, posterior double, score double, kept boolean")
    return mapped(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)), run, schema)
