"""Document fingerprints: a quartile bucket digest, compared with a bounded difference.

The byte triplets of a sliding window of four are hashed into 128 buckets. Each
bucket becomes two bits: which quartile of the bucket counts its count lies in.
A header holds a checksum, the length on a logarithmic scale and two ratios of
the quartiles. The difference of two digests sums the buckets' distances (a full
step of three counts six) and the header's; it is bounded by CAP, and likeness
is 1 - difference / CAP.

null text counts as empty. Texts of under three bytes have empty buckets; equal
texts have equal digests. Neighbours are by ascending id, nulls first, equal ids
by text; the last row's neighbour is the first row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import mapped, prepared, typed, written
from .text import SLICE_BYTES, buffers, slices

BUCKETS, CAP = 128, 240.0
_TRIPLETS = ((0, 1, 2, 0x9E3779B1), (0, 1, 3, 0x85EBCA77), (0, 2, 3, 0xC2B2AE3D))


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (rows x BUCKETS) of hashed triplets; a row longer than a slice is counted part by part."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES + 3].astype(np.uint32)
        first = np.arange(at, min(at + SLICE_BYTES, len(data)))
        ends = np.searchsorted(offsets, first, "right")
        row = (ends - 1) * BUCKETS
        left = offsets[ends] - first
        for a, b, c, k in _TRIPLETS:
            m = len(part) - c
            if m <= 0:
                continue
            m = min(m, len(first))
            h = (part[a : a + m] | (part[b : b + m] << np.uint32(8)) | (part[c : c + m] << np.uint32(16))) * np.uint32(k)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            spot = row[:m] + (h >> np.uint32(25))
            out += np.bincount(spot[left[:m] > c], minlength=len(out))
    return out.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One digest of 36 bytes for each row, as a byte matrix."""
    n = len(offsets) - 1
    out = np.zeros((n, 4 + BUCKETS // 4), np.uint8)
    if not n:
        return out
    counts = bucket_counts(data, offsets)
    order = np.sort(counts, axis=1)
    q1, q2, q3 = (order[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(n, -1, 4)
    out[:, 4:] = code[:, :, 0] | (code[:, :, 1] << 2) | (code[:, :, 2] << 4) | (code[:, :, 3] << 6)
    raw = data.tobytes()
    ends = offsets.tolist()
    out[:, 0] = [zlib.crc32(raw[a:b]) & 255 for a, b in zip(ends[:-1], ends[1:])]
    out[:, 1] = np.minimum(np.floor(np.log(np.maximum(np.diff(offsets), 1)) / np.log(1.2)), 255)
    top = np.maximum(q3[:, 0], 1)
    out[:, 2] = q1[:, 0] * 15 // top
    out[:, 3] = q2[:, 0] * 15 // top
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0 at a difference of CAP or more."""
    a, b = a.astype(np.int16), b.astype(np.int16)
    total = (a[:, 0] != b[:, 0]).astype(np.float64)
    far = np.abs(a[:, 1] - b[:, 1])
    total += np.where(far <= 1, far, np.minimum(far * 2, 40))
    total += np.minimum(np.abs(a[:, 2:4] - b[:, 2:4]) * 2, 12).sum(axis=1)
    for k in (0, 2, 4, 6):
        d = np.abs(((a[:, 4:] >> k) & 3) - ((b[:, 4:] >> k) & 3))
        total += np.where(d == 3, 6, d).sum(axis=1)
    return np.maximum(0.0, 1.0 - total / CAP)


def hex_of(m: np.ndarray) -> list[str]:
    raw, w = m.tobytes().hex(), m.shape[1] * 2
    return [raw[k : k + w] for k in range(0, len(raw), w)]


def of_texts(texts: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    parts = [digests(d, o) for _, _, d, o in slices(data, offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, 4 + BUCKETS // 4), np.uint8)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a column fingerprint."""
    prepared(docs.sparkSession)
    names = [c for c in docs.columns if c != "fingerprint"]

    def run(batches):
        for batch in batches:
            found = hex_of(of_texts([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found, pa.string())], [*names, "fingerprint"])

    return mapped(docs.select(*[f"`{c}`" for c in names]), run, typed(docs, tuple(names), "fingerprint string"))


def edited(a: str, b: str) -> str:
    """a with its last floor(n/2) characters replaced by the first as many (or all) of b."""
    h = len(a) // 2
    return a[: len(a) - h] + b[:h]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(keys: list, texts: list[str], own: np.ndarray, then: list[str], after: np.ndarray) -> list[pa.Array]:
    """The result's columns for rows `texts` whose neighbours are `then`."""
    new = [edited(a, b) for a, b in zip(texts, then)]
    theirs = of_texts(new)
    return [
        pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        pa.array(hex_of(own), pa.string()), pa.array(hex_of(theirs), pa.string()), pa.array(likeness(own, theirs)), pa.array(likeness(own, after)),
    ]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row and the next.

    One range exchange puts neighbours together; the rows at the edges of partitions (two each) are matched after."""
    spark = docs.sparkSession
    prepared(spark)
    order = F.col(key).asc_nulls_first()
    ranged = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text)).repartitionByRange(order).sortWithinPartitions(order, text)
    empty = lambda n, kind: pa.nulls(n, kind)

    def row(columns, edge, part, texts):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, pa.array([edge] * n, pa.string()), pa.array([part] * n, pa.int32()), texts], [key, *_NAMES, "_edge", "_part", "_text"])

    def edge_row(k, t, edge, part):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return row([pa.array([k], pa.int64()), *[empty(1, kind) for kind in kinds[1:]]], edge, part, pa.array([t], pa.string()))

    def run(batches):
        part, keys, texts, marks = TaskContext.get().partitionId(), [], [], None
        for batch in batches:
            new_keys, new_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not new_keys:
                continue
            if marks is None:
                yield edge_row(new_keys[0], new_texts[0], "first", part)
            own = of_texts(new_texts)
            keys, texts, marks = keys + new_keys, texts + new_texts, own if marks is None else np.concatenate([marks, own])
            n = len(keys) - 1
            if n:
                yield row(compared(keys[:n], texts[:n], marks[:n], texts[1:], marks[1:]), None, part, pa.nulls(n, pa.string()))
            keys, texts, marks = keys[n:], texts[n:], marks[n:]
        if keys:
            yield edge_row(keys[0], texts[0], "last", part)

    done = written(mapped(ranged, run, f"`{key}` long, {RESULT}, _edge string, _part int, _text string"), "digests")
    firsts, lasts = done.where("_edge = 'first'"), done.where("_edge = 'last'")
    # a number per partition that has rows; no texts in the single-task window
    place = firsts.select("_part", (F.row_number().over(Window.orderBy("_part")) - 1).alias("_at"))
    total = place.agg(F.max("_at").alias("_top"))
    then = firsts.join(place, "_part").select("_at", F.col("_text").alias("_then"))
    before = lasts.join(place, "_part").crossJoin(F.broadcast(total)).select(key, "_text", F.when(F.col("_at") == F.col("_top"), 0).otherwise(F.col("_at") + 1).alias("_at"))

    def close(batches):
        for batch in batches:
            texts, after = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(compared(batch.column(0).to_pylist(), texts, of_texts(texts), after, of_texts(after)), [key, *_NAMES])

    rest = mapped(before.join(then, "_at").select(key, "_text", "_then"), close, f"`{key}` long, {RESULT}")
    return done.where("_edge is null").select(key, *_NAMES).unionByName(rest)
