"""Byte-level BPE by a table of distinct words.

1. Texts go in slices of about SLICE bytes, which one exchange deals out. Each is
   split into words (pre-tokens) with array operations; a slice sends each of its
   distinct words once, to the word's hash partition, packed by partition.
2. A partition is its part of the table of distinct words, keyed by their bytes (no
   hash stands for a word): each word of the corpus is encoded once, in one place.
3. A slice gets the ids of its words back, in the order in which it sent them, and
   they return to their positions by an indexed copy. Ids meet the table of pieces
   (as many rows as the vocabulary) by index to be decoded. What moves is each slice
   once, its distinct words and their ids, never a row per position.

`Encoder` alone, with a bounded table of words in each worker, serves streams that
cannot wait for a join (files of ids, see planes.py).

null and empty texts have no ids and decode to an empty text. Rows repeat and tie
as they come: each is coded by itself, in no promised order. An empty table gives an
empty result. A word of any length is one row. A text that holds a special token goes
to the tokenizer whole, as one word. Other columns travel along, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import mapped, prepared, trim, typed
from .text import blocks, buffers, distinct_spans, ragged, row_starts, slices, span_hashes

#: Bytes of text in a slice (one longer text stands alone); bytes of words and ids that a worker's
#: own table holds before it starts anew.
SLICE, HELD_BYTES = 4 << 20, 16 << 20
_SP, _LETTER, _NUMBER, _OTHER = range(4)


@cache
def char_kinds() -> np.ndarray:
    """Class (space, letter, number, other) of every code point."""
    kind = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            kind[c] = _LETTER
        elif g == "N":
            kind[c] = _NUMBER
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SP
    return kind


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = char_kinds()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        cp = b & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            cp[more] = (cp[more] << 6) | (data[lead[more] + k] & 0x3F)
        found = table[cp]
        kind[lead] = found
        for k in (1, 2, 3):
            more = size > k
            kind[lead[more] + k] = found[more]
    return kind


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the words of the byte-level pattern; words tile each row."""
    n = len(data)
    kind = byte_kinds(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    flag = first[:-1].copy()
    flag[1:] |= kind[1:] != kind[:-1]
    space = kind == _SP
    # white space just before a word: a blank belongs to the word, anything else stands alone
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
    blank = data[before] == 0x20
    flag[before[blank] + 1] = False
    for _ in range(3):
        before = before - ((data[before] & 0xC0) == 0x80)
    flag[before] = True
    # 's 't 'm 'd 're 've 'll at the start of a word
    at = np.flatnonzero((data == 0x27) & flag)
    if len(at):
        row_end = offsets[np.searchsorted(offsets, at, "right")]
        pad = np.concatenate([data, np.zeros(3, data.dtype)])
        one = np.where(at + 1 < row_end, pad[at + 1], 0)
        two = np.where(at + 2 < row_end, pad[at + 2], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.zeros(len(at), bool)
        for x, y in (b"re", b"ve", b"ll"):
            long |= (one == x) & (two == y)
        for which, size in ((short, 2), (long, 3)):
            hit = at[which]
            flag[hit + 1] = False
            after = hit + size
            flag[after[after < n]] = True
    return np.flatnonzero(flag)


def placed(values: list[bytes], number: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (as bytes) of word number[0], number[1], ... one after the other, and how many each row has; edges: the
    first word of each row, and the number of words."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    pool = np.frombuffer(b"".join(values), "<i4")
    each = size[number]
    return ragged(pool, row_starts(size)[:-1][number], each), np.diff(row_starts(each)[edges])


class Encoder:
    """The tokenizer with a table of words, by their bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_bytes = [x.encode() for x in self.special]
        self.reset()
        to_byte = _byte_of_char()
        self.char_of = {b: c for c, b in to_byte.items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pieces = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            pieces[i] = token.encode() if token in self.special else bytes(to_byte[c] for c in token)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = row_starts(self.piece_len)[:-1]
        self.piece_pool = np.frombuffer(b"".join(pieces), np.uint8)
        digits = [str(i).encode() + b"," for i in range(size)]
        self.digit_len = np.array([len(p) for p in digits], np.int64)
        self.digit_at = row_starts(self.digit_len)[:-1]
        self.digit_pool = np.frombuffer(b"".join(digits), np.uint8)

    def reset(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word, or of a whole text with special tokens."""
        if any(x in raw for x in self.special_bytes):
            return self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(self.char_of))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and their number per row."""
        starts, ends = self.split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        first, number = distinct_spans(data, starts, ends)
        if self.held > HELD_BYTES:
            self.reset()
        raw, known = data.tobytes(), self.known
        words = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
        ids = [known.get(w) for w in words]
        for k, found in enumerate(ids):
            if found is None:
                ids[k] = known[words[k]] = np.array(self.word(words[k]), "<i4").tobytes()
                self.held += len(words[k]) + len(ids[k])
        return placed(ids, number, np.searchsorted(starts, offsets))

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words; a row with a special token is one word."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = split_words(data, offsets)
        raw = data.tobytes()
        if any(x.encode() in raw for x in self.special):
            ends = offsets.tolist()
            for a, b in zip(ends[:-1], ends[1:]):
                if any(x.encode() in raw[a:b] for x in self.special):
                    starts = starts[(starts <= a) | (starts >= b)]
        return starts, np.append(starts[1:], len(data))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[str]:
        """Each row's text: its ids joined with the table of pieces; broken UTF-8 becomes U+FFFD."""
        size = self.piece_len[ids]
        flat = ragged(self.piece_pool, self.piece_at[ids], size).tobytes()
        ends = row_starts(size)[row_starts(counts)].tolist()
        for a, b in zip(ends[:-1], ends[1:]):
            yield flat[a:b].decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """Each row's ids in decimal, joined by commas."""
        size = self.digit_len[ids]
        flat = ragged(self.digit_pool, self.digit_at[ids], size).tobytes()
        ends = row_starts(size)[row_starts(counts)].tolist()
        for a, b in zip(ends[:-1], ends[1:]):
            yield flat[a : max(a, b - 1)]


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PACKED = "slice long, part int, n int, size long, data binary"


def sliced(df: DataFrame, text: str) -> DataFrame:
    """df as rows (slice, docs): an Arrow stream of the rows of about SLICE bytes of text, compressed."""

    def run(batches):
        part, at = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def done():
            nonlocal at, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                for h in held:
                    out.write_batch(h)
            row = pa.RecordBatch.from_arrays([pa.array([part + at]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "docs"])
            at, held, size = at + 1, [], 0
            return row

        for batch in batches:
            data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
            for a, b, d, _ in slices(data, offsets, SLICE):
                if held and size + len(d) > SLICE:
                    yield done()
                held.append(batch.slice(a, b - a))
                size += len(d)
        if held:
            yield done()

    return mapped(df, run, "slice long, docs binary")


def opened(docs: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs).read_all().combine_chunks().to_batches()[0]


def dealt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, edges, number): the first places of the distinct words by partition (and within one by their first
    letters, which packs them well), where each partition begins, and which of these each word is."""
    first, number = distinct_spans(data, starts, ends)
    part = ((span_hashes(data, starts[first], ends[first]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    letters = blocks(data)[starts[first]].astype("<u8").byteswap()
    order = np.lexsort((letters, part))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], np.searchsorted(part[order], np.arange(parts + 1)), place[number]


def packed(size: np.ndarray, pool: np.ndarray) -> tuple[int, bytes]:
    """Sizes and values, compressed, and the bytes before that."""
    wide = np.min_scalar_type(int(size.max(initial=0))).itemsize
    raw = bytes([wide]) + size.astype(f"<u{wide}").tobytes() + pool.tobytes()
    return len(raw), pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpacked(n: int, length: int, data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(data, length, asbytes=True)
    wide = raw[0]
    return np.frombuffer(raw, f"<u{wide}", n, 1).astype(np.int64), np.frombuffer(raw, kind, offset=1 + n * wide)


def coded(df: DataFrame, path: str, text: str, run: Callable, schema: StructType) -> DataFrame:
    """run(rows, ids, ids per row) of every slice's rows, as a table of the schema."""
    spark = df.sparkSession
    prepared(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt out once: the exchange serves both the split and the way back
    slices_of = sliced(df, text).repartition("slice")
    names = [f.split()[0] for f in PACKED.split(", ")]

    def row(at, part, n, size, data):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names)

    def split(batches):
        enc = encoder(path)
        for batch in batches:
            for at, docs in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = opened(docs.as_buffer())
                data, offsets = buffers(rows.column(rows.schema.get_field_index(text)))
                starts, ends = enc.split(data, offsets)
                order, edges, _ = dealt(data, starts, ends, parts)
                size = (ends - starts)[order]
                out = []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[k], edges[k + 1]
                    out.append(row(at, k, b - a, *packed(size[a:b], ragged(data, starts[order[a:b]], size[a:b]))))
                if out:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    def encoded(batches):
        """The ids of every row's words; the table of this partition's distinct words grows as they come."""
        enc, table = encoder(path), {}
        for batch in batches:
            out = []
            for at, part, n, size, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                sizes, pool = unpacked(n, size, data, "u1")
                raw, cuts = pool.tobytes(), row_starts(sizes).tolist()
                ids = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    word = raw[a:b]
                    found = table.get(word)
                    if found is None:
                        found = table[word] = np.array(enc.word(word), "<i4").tobytes()
                    ids.append(found)
                count = np.fromiter(map(len, ids), np.int64, n) // 4
                flat = np.frombuffer(b"".join(ids), "<i4")
                # the bytes of ids by significance: the upper ones are nearly all zero
                out.append(row(at, part, n, *packed(count, flat.view(np.uint8).reshape(-1, 4).T)))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    words = mapped(slices_of, split, PACKED).repartition(parts, "part")
    found = mapped(words, encoded, PACKED)

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        by_part = {p: (n, size, data) for p, n, size, data in zip(*(right.column(k).to_pylist() for k in range(1, 5)))}
        for docs in left.column(1):
            rows = opened(docs.as_buffer())
            data, offsets = buffers(rows.column(rows.schema.get_field_index(text)))
            starts, ends = encoder(path).split(data, offsets)
            order, edges, number = dealt(data, starts, ends, parts)
            sizes, pools = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for k in np.flatnonzero(np.diff(edges)).tolist():  # a partition that is not there is an error
                size, planes = unpacked(*by_part[k], "u1")
                sizes.append(size)
                pools.append(np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel())
            size, pool = np.concatenate(sizes), np.concatenate(pools)
            each = size[number]
            out.append(run(rows, ragged(pool, row_starts(size)[:-1][number], each), np.diff(row_starts(each)[np.searchsorted(starts, offsets)])))
        trim()
        return pa.Table.from_batches(out)

    return slices_of.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(fill, schema)


def _lists(ids: np.ndarray, per: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(row_starts(per), pa.int32()), pa.array(ids, pa.int32()))


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with a column of token ids (array<int>); an empty or null text has none."""
    names = [f.name for f in df.schema.fields if f.name != ids]

    def run(rows, found, per):
        return pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(n)) for n in names), _lists(found, per)], [*names, ids])

    return coded(df.select(*[f"`{n}`" for n in names]), path, text, run, typed(df, tuple(names), f"`{ids}` array<int>"))


def encode_checked(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with token_ids and round_trip (whether they decode to the text)."""
    names = [f.name for f in df.schema.fields if f.name not in ("token_ids", "round_trip")]

    def run(rows, ids, per):
        data, offsets = buffers(rows.column(rows.schema.get_field_index(text)))
        raw, cuts = data.tobytes(), offsets.tolist()
        same = [raw[x:y] == t.encode() for x, y, t in zip(cuts[:-1], cuts[1:], encoder(path).decode(ids, per))]
        return pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(n)) for n in names), _lists(ids, per), pa.array(same, pa.bool_())], [*names, "token_ids", "round_trip"])

    return coded(df.select(*[f"`{n}`" for n in names]), path, text, run, typed(df, tuple(names), "token_ids array<int>, round_trip boolean"))


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids, null ids as an empty text."""
    prepared(df.sparkSession)
    names = [f.name for f in df.schema.fields if f.name != text]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(list(enc.decode(flat, counts)), pa.string())], [*names, text])

    return mapped(df.select(*[f"`{n}`" for n in names]), run, typed(df, tuple(names), f"`{text}` string"))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(rows, ids, per):
        found = [pa.array([sha(x) for x in encoder(path).decimal(ids, per)], pa.string()), pa.array([sha(x.encode()) for x in encoder(path).decode(ids, per)], pa.string())]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(per, pa.int64()), *found], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    named = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return coded(named, path, "_text", run, StructType([df.select(F.col(f"`{key}`").alias(key)).schema[0], *StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields]))
