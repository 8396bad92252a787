"""Token ids in binary files: bit-plane shuffled, zstandard-compressed blocks with a chunk index.

One file holds the ids of a range of documents in order:

    magic "IDPL1\\n"
    blocks: BLOCK ids each (the last may be shorter), transposed into 32 bit planes or
        4 byte planes, every plane compressed by itself with zstandard
    document table: zstandard over (doc_id int64, is_null uint8, n_ids int64) arrays
    chunk index: int64 rows (offset, n_ids, compressed length of each plane)
    footer: json (planes, block, docs, blocks, offsets), its length as uint32, magic

The index table beside the files (Parquet, one row per file) has each file's
first and last document and its number of ids; the position of every document
is the sum of the files and documents before it.

A task writes a file under a name of its own and only the table of committed
tasks names files, so a task that runs twice or is lost leaves nothing that a
reader sees. null text counts as empty; null doc_ids come first; rows with the
same doc_id keep the order of their texts; an empty table gives no file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import SLICE, encoder
from .shared import fresh_path, mapped, opened_folder, prepared
from .text import buffers, row_starts, slices

MAGIC, BLOCK, LEVEL = b"IDPL1\n", 1 << 16, 3
INDEX = "part int, file string, n_docs long, n_ids long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(found: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in found], axis=1).copy().view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in found], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file to an open binary stream; memory holds one block and the document table."""

    def __init__(self, out, planes: str = "byte", block: int = BLOCK):
        import zstandard

        self.out, self.planes, self.block, self.zip = out, planes, block, zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.index, self.docs, self.rest, self.n_ids = len(MAGIC), [], [], np.zeros(0, np.uint32), 0
        out.write(MAGIC)

    def add(self, keys: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((np.array([k or 0 for k in keys], np.int64), np.array([k is None for k in keys], np.uint8), counts.astype(np.int64)))
        self.n_ids += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(self.rest) // self.block * self.block
        for a in range(0, whole, self.block):
            self._put(self.rest[a : a + self.block])
        self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        zipped = [self.zip.compress(p) for p in to_planes(ids, self.planes)]
        self.index.append([self.at, len(ids), *map(len, zipped)])
        for z in zipped:
            self.out.write(z)
            self.at += len(z)

    def close(self) -> int:
        if len(self.rest):
            self._put(self.rest)
        table = b"".join(np.concatenate([d[k] for d in self.docs]).tobytes() if self.docs else b"" for k in range(3))
        docs, chunks = self.zip.compress(table), np.array(self.index, "<i8").tobytes()
        self.out.write(docs)
        self.out.write(chunks)
        foot = json.dumps({"planes": self.planes, "block": self.block, "docs": sum(len(d[0]) for d in self.docs), "blocks": len(self.index), "docs_at": self.at, "docs_len": len(docs)}).encode()
        self.out.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        return self.n_ids


class Reader:
    """Reads a file by its chunk index: documents in turn, or the ids of any range."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        tail = 4 + len(MAGIC)
        source.seek(size - tail)
        n, magic = struct.unpack(f"<I{len(MAGIC)}s", source.read(tail))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        source.seek(size - tail - n)
        self.foot = json.loads(source.read(n))
        at, length, docs = self.foot["docs_at"], self.foot["docs_len"], self.foot["docs"]
        source.seek(at)
        table = self.unzip.decompress(source.read(length)) if length else b""
        self.keys = np.frombuffer(table, "<i8", docs)
        self.null = np.frombuffer(table, np.uint8, docs, docs * 8)
        self.counts = np.frombuffer(table[docs * 9 :], "<i8", docs)
        width = 2 + (4 if self.foot["planes"] == "byte" else 32)
        self.index = np.frombuffer(source.read(self.foot["blocks"] * width * 8), "<i8").reshape(-1, width)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        self.source.seek(at)
        raw = self.source.read(sum(sizes))
        cuts = row_starts(np.array(sizes)).tolist()
        return from_planes([self.unzip.decompress(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], n, self.foot["planes"])

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n of the file; reads only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        a, b = first // self.foot["block"], (first + n - 1) // self.foot["block"]
        out = np.concatenate([self.block(k) for k in range(a, b + 1)])
        return out[first - a * self.foot["block"] :][:n]

    def crcs(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian unsigned 32-bit integers, block by block."""
        out, ends = np.zeros(len(self.counts), np.int64), np.cumsum(self.counts)
        doc, done = 0, 0
        for k in range(len(self.index)):
            ids = self.block(k)
            raw, stop = ids.tobytes(), done + len(ids)
            at = done
            while doc < len(ends) and at < stop:
                upto = min(int(ends[doc]), stop)
                out[doc] = zlib.crc32(raw[(at - done) * 4 : (upto - done) * 4], int(out[doc]))
                at = upto
                if ends[doc] <= stop:
                    doc += 1
            done = stop
        return out


def write_ids(df: DataFrame, vocabulary: str, out: str, key: str = "doc_id", text: str = "text", end_id: int = 0, planes: str = "byte") -> DataFrame:
    """Encodes df's texts in ascending key order into files under out (a URI all machines see), an end id after
    each; returns the index table, which is also written to out/index."""
    spark = df.sparkSession
    prepared(spark)
    # the range exchange moves texts: ids before it would be made twice, as Spark samples its input
    ordered = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    files = out.rstrip("/") + "/files"

    def run(batches):
        enc, writer, part = encoder(vocabulary), None, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b, d, o in slices(data, offsets, SLICE):
                if writer is None:
                    system, base = opened_folder(files)
                    name = f"{part:06d}-{uuid.uuid4().hex}.idpl"
                    stream = system.open_output_stream(f"{base}/{name}")
                    writer, n_docs = Writer(stream, planes), 0
                ids, counts = enc.encode(d, o)
                ends = row_starts(counts)[1:]
                writer.add(keys[a:b], counts + 1, np.insert(ids, ends, end_id))
                n_docs += b - a
        if writer is not None:
            n_ids = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    mapped(ordered, run, INDEX).write.mode("overwrite").parquet(out.rstrip("/") + "/index")
    return spark.read.schema(INDEX).parquet(out.rstrip("/") + "/index")


def read_ids(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files that out/index names."""
    prepared(spark)
    files = out.rstrip("/") + "/files"
    index = spark.read.schema(INDEX).parquet(out.rstrip("/") + "/index")
    # one row per file: the window's single task holds as many rows as there are files
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = index.select("part", "file", before.alias("before"))
    spread = placed.repartition(max(1, min(index.count(), 10_000)), "part")

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                system, top = opened_folder(files)
                path = f"{top}/{name}"
                with system.open_input_file(path) as source:
                    r = Reader(source, source.size())
                    crcs = r.crcs()
                    starts = base + row_starts(r.counts)[:-1]
                for a in range(0, len(crcs), 100_000):
                    b = a + 100_000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.keys[a:b], pa.int64(), mask=r.null[a:b].astype(bool)), pa.array(starts[a:b], pa.int64()), pa.array(r.counts[a:b], pa.int64()), pa.array(crcs[a:b], pa.int64())],
                        [key, "start", "n_tokens", "ids_crc32"],
                    )

    return mapped(spread, run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", planes: str = "byte") -> DataFrame:
    """Writes df's ids under the shared folder and reads the files back."""
    out = fresh_path(df.sparkSession, "ids")
    write_ids(df, vocabulary, out, key, text, planes=planes)
    return read_ids(df.sparkSession, out, key)
