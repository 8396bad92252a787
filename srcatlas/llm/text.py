"""Vectorised splitting and hashing of Arrow string batches: no Python loop per word or character."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch holds at most so many bytes of text (one longer document stands alone).
SLICE_BYTES = 1 << 20
U64 = np.uint64
#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Spans of more bytes than this are hashed one by one.
_LONG = 64
_LENGTHS, _MULTIPLY = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one integer (bytes past the end are 0)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes that depends on its content only: a chain of its eight-byte blocks, each
    mixed in by a bijection, so spans of one block and equal length never share a hash. Long spans take BLAKE2b."""
    size = ends - starts
    h = mix(size.astype(U64) * _LENGTHS + U64(0x2545F4914F6CDD1D))
    at8 = blocks(data)
    left, at, who = size, starts, None  # who: the spans that go on (None: all)
    long = np.flatnonzero(size > _LONG)
    if len(long):
        who = np.flatnonzero(size <= _LONG)
        left, at = size[who], starts[who]
    while len(left):
        keep = (np.minimum(left, 8).astype(U64)) << U64(3)
        block = at8[at] & np.where(keep < 64, (U64(1) << (keep & U64(63))) - U64(1), U64(0xFFFFFFFFFFFFFFFF))
        if who is None:
            h = mix((h ^ block) * _MULTIPLY)
        else:
            h[who] = mix((h[who] ^ block) * _MULTIPLY)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        who = more if who is None else who[more]
        left, at = left[more] - 8, at[more] + 8
    for k in long.tolist():
        h[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes from a and from b on are equal, by their bytes."""
    at8 = blocks(data)
    out = np.ones(len(a), bool)
    long = size > _LONG
    for k in np.flatnonzero(long & (a != b)).tolist():
        out[k] = bool((data[a[k] : a[k] + size[k]] == data[b[k] : b[k] + size[k]]).all())
    who = np.flatnonzero(~long & (a != b) & (size > 0))
    done = 0
    while len(who):
        left = size[who] - done
        x = at8[a[who] + done] ^ at8[b[who] + done]
        keep = np.minimum(left, 8).astype(U64) << U64(3)
        x &= np.where(keep < 64, (U64(1) << (keep & U64(63))) - U64(1), U64(0xFFFFFFFFFFFFFFFF))
        out[who] &= x == 0
        who, done = who[left > 8], done + 8
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct span, in the order of first places; number of each span's distinct one), by bytes:
    spans that share a hash are compared."""
    number = pa.array(span_hashes(data, starts, ends)).dictionary_encode().indices.to_numpy()
    first = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    size = ends - starts
    rep = first[number]
    odd = (size != size[rep]) | ~same_spans(data, starts, starts[rep], np.minimum(size, size[rep]))
    if odd.any():  # two contents of one hash: these few by a table of their bytes
        number, known, more = number.astype(np.int64), {}, []
        for k in np.flatnonzero(odd).tolist():
            word = data[starts[k] : ends[k]].tobytes()
            if word not in known:
                known[word] = len(first) + len(more)
                more.append(k)
            number[k] = known[word]
        first = np.concatenate([first, np.array(more, np.int64)])
    return first, number


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most `most` bytes."""
    most = most or SLICE_BYTES
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the number per row of words [^\x20\x09-\x0D]+; a word never spans two rows."""
    inside = ~SPACE[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, their starts and ends, and the number per row."""
    starts, ends, counts = words(data, offsets)
    return span_hashes(LOWER[data], starts, ends), starts, ends, counts


def row_starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[s:s+n] of every (s, n), one after the other."""
    if not len(lengths):
        return pool[:0]
    out = np.repeat(starts - (row_starts(lengths)[:-1]), lengths)
    out += np.arange(len(out))
    return pool[out]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
