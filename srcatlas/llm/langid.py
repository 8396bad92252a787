"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 letters,
lower case, inside words, with word edges as a mark) by rank. A document's own
list is compared with each profile by out-of-place distance: the sum of rank
differences, the list's length for an n-gram that the profile lacks. The nearest
profile wins. Profiles count every training document; documents are read whole,
longer ones than a slice in parts cut at a non-letter, which no n-gram spans.

null text or a text without letters is `und` with score 0; ties of rank go by
the n-gram's hash, ties of distance by the language's name. With no training
rows every document is `und`. Rows repeat as they come.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import char_kinds
from .shared import mapped, prepared, typed
from .text import SLICE_BYTES, buffers, mix, slices

#: Length of profiles and of documents' lists.
LIST = 300
GRAM_BITS = 48
_MASK = np.int64((1 << GRAM_BITS) - 1)


@cache
def folded() -> np.ndarray:
    """Lower-case code point of every letter, 0 for anything else."""
    kind = char_kinds()
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(kind == 1).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(row of each part, bytes, offsets): as given, a long row in parts that end at an ASCII non-letter."""
    if len(offsets) > 2 or len(data) <= SLICE_BYTES:
        yield np.arange(len(offsets) - 1), data, offsets
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        if end < len(data):
            cut = np.flatnonzero(data[at:end] <= 0x20)
            end = at + int(cut[-1]) + 1 if len(cut) else end
            while end < len(data) and (data[end] & 0xC0) == 0x80:
                end += 1
        yield np.zeros(1, np.int64), data[at:end], np.array([0, end - at])
        at = end


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram hash, count), ordered by row and hash."""
    found = []
    for rows, d, o in _pieces(data, offsets):
        if not len(d):
            continue
        cp = np.frombuffer(d.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(d) + 1, np.int64)
        np.cumsum((d & 0xC0) != 0x80, out=heads[1:])
        ends = np.minimum(heads[o], len(cp))
        # a mark between rows, so that no n-gram spans two
        low = np.insert(folded()[cp], ends[1:-1], 0) if len(o) > 2 else folded()[cp]
        row = np.repeat(rows, np.diff(ends) + np.append(np.ones(len(rows) - 1, np.int64), 0))
        low = np.concatenate([np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)]).astype(np.uint64)
        row = np.concatenate([row[:1], row, row[-1:]]).astype(np.uint64) << np.uint64(GRAM_BITS)
        one, two = low[:-1], low[1:]
        keys = [(row[1:-1][low[1:-1] > 0], low[1:-1][low[1:-1] > 0])]
        pair = (one > 0) | (two > 0)
        inside = np.where(one > 0, row[:-1], row[1:])
        keys.append((inside[pair], (one[pair] << np.uint64(21)) | two[pair] | np.uint64(1 << 62)))
        mid = low[1:-1] > 0
        keys.append((row[1:-1][mid], (low[:-2][mid] << np.uint64(42)) | (low[1:-1][mid] << np.uint64(21)) | low[2:][mid] | np.uint64(1 << 63)))
        flat = np.concatenate([r | (mix(g) >> np.uint64(64 - GRAM_BITS)) for r, g in keys]).view(np.int64)
        flat.sort()
        new = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        found.append((flat[new], np.diff(np.append(new, len(flat)))))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    keys, counts = found[0]
    if len(found) > 1:
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
    return keys >> GRAM_BITS, keys & _MASK, counts


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int = LIST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank) of each row's most frequent n-grams."""
    key = (row << 40) | (((1 << 40) - 1) - np.minimum(count, (1 << 40) - 1))
    order = np.argsort(key, kind="stable")
    row = row[order]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    kept = rank < most
    return row[kept], gram[order][kept], rank[kept]


class Profiles:
    """Ranks of n-grams by language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, rank in rows:
            self.rank[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank

    def distances(self, row: np.ndarray, gram: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
        """Mean out-of-place distance of n rows to each language, 0 to 1."""
        at = np.searchsorted(self.grams, gram)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != gram] = len(self.grams)
        theirs = self.rank[at]
        off = np.where(theirs < 0, LIST, np.minimum(np.abs(theirs - rank[:, None]), LIST))
        size = np.bincount(row, minlength=n)
        return np.stack([np.bincount(row, off[:, k], n) for k in range(len(self.langs))], axis=1) / (np.maximum(size, 1) * LIST)[:, None]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Learned from all rows of docs whose lang is not null; LIST rows for each language reach the driver."""
    prepared(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            names, which = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for a, b, d, o in slices(data, offsets):
                row, gram, count = gram_counts(d, o)
                key, back = np.unique((which[a:b][row] << GRAM_BITS) | gram, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key >> GRAM_BITS].astype(object), pa.string()), pa.array(key & _MASK, pa.int64()), pa.array(np.bincount(back, count, len(key)).astype(np.int64))], ["lang", "gram", "n"])

    counted = mapped(docs.where(F.col(lang).isNotNull()).select(text, F.col(lang).cast("string").alias("lang")), run, "lang string, gram long, n long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", place).where(F.col("rank") <= LIST)
    return Profiles([(r.lang, r.gram, r.rank - 1) for r in top.select("lang", "gram", "rank").collect()])


def identify(docs: DataFrame, known: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with lang_pred and score (how much nearer the best profile is than the second, 0 to 1)
    and distance (to the best profile, 0 to 1)."""
    spark = docs.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        p = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            for a, b, d, o in slices(data, offsets):
                n = b - a
                lang, score, best = np.full(n, "und", object), np.zeros(n), np.ones(n)
                if len(p.langs):
                    row, gram, rank = ranked(*gram_counts(d, o))
                    has = np.bincount(row, minlength=n) > 0
                    far = p.distances(row, gram, rank, n)
                    order = np.sort(far, axis=1)
                    lang = np.where(has, np.array(p.langs, object)[far.argmin(axis=1)], "und")
                    best = np.where(has, order[:, 0], 1.0)
                    second = order[:, 1] if far.shape[1] > 1 else np.ones(n)
                    score = np.where(has, np.clip((second - order[:, 0]) / np.maximum(second, 1e-12), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, n) for k in range(batch.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score), pa.array(best)], [*keep, "lang_pred", "score", "distance"])

    schema = typed(docs, keep, "lang_pred string, score double, distance double")
    return mapped(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)), run, schema)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """(key, held_out, lang_pred, score, distance): learned from the rows whose remainder is not 0."""
    known = profiles(docs.where(remainder(F.col(key), folds) != 0), text, lang)
    out = identify(docs.select(key, (remainder(F.col(key), folds) == 0).alias("held_out"), text), known, text, (key, "held_out"))
    return out
