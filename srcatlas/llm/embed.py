"""Embedding near-duplicates: randomised-rotation binary codes with correction factors.

1. A vector of d components is normalised and turned by fixed random rotations;
   the signs of the turned vector are its code, stored once. Of the first max(d,
   CODE) dimensions a correction factor 1 / <code, vector> is stored as well, with
   which <code, other vector> estimates inner products without bias, and the turned
   vector itself in four bits a dimension, to stand for the other vector.
2. Candidates share one of L groups of k bits of the code. k is chosen for the
   number of vectors (few pairs share a group by chance), and L so that a pair at
   the threshold shares one with probability RECALL or more (0.97; pairs above it
   more surely: 0.999 at a cosine of 0.96).
3. Codes, factors and four-bit vectors of candidates meet. The estimate and its
   confidence bound (EPS standard errors) dismiss pairs; a pair is looked at in the
   first group of bits that it shares, as told by the stored codes.
4. Only vectors with a pair that is left travel, and are computed again in double
   precision; only that links. Links leave a task as counts per vector and a
   spanning forest, never as pairs. Groups of more than BLOCK vectors are cut into
   blocks that meet pairwise, so a group of any size is spread over tasks. Equal
   vectors (by SHA-256 of their components) are one node with a weight.

Null, empty or zero vectors and those with null or non-finite components link with
nothing: n_links 0, their own component, kept. Vectors of different length never
link. Repeated rows are equal vectors. Null ids take part; a component is named by
its smallest id that is not null. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import hot_keys, mapped, prepared, salted_join, written
from .text import U64, mix, signed

#: Least bits of a code; standard errors of the confidence bound; vectors of a block; aimed-at recall at the threshold.
CODE, EPS, BLOCK, RECALL = 256, 5.0, 1024, 0.97


def plan_sets(n: int, threshold: float) -> tuple[int, int]:
    """(bits k, groups L) for n vectors, so that least moves: a key for each group, and a code for each group that is
    shared by chance."""
    best = None
    for k in range(4, 41):
        agree = (1 - math.acos(threshold) / math.pi) ** k
        sets = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))
        cost = sets * (16 + min(1.0, n / 2**k) * (max(k * sets, CODE) / 8 + CODE / 2 + 40))
        if best is None or cost < best[0]:
            best = (cost, k, sets)
    return best[1], best[2]


@cache
def rotation(d: int, bits: int) -> np.ndarray:
    """d x bits: orthonormal blocks of a random rotation of max(d, CODE) dimensions, as many as needed."""
    side = max(d, CODE)
    rng, parts = np.random.default_rng(20_240_501 + d), []
    while sum(p.shape[1] for p in parts) < bits:
        q, r = np.linalg.qr(rng.standard_normal((side, side)))
        parts.append((q * np.sign(np.diag(r)))[:d])
    return np.concatenate(parts, axis=1)[:, : max(bits, side)].astype(np.float32)


def codes(unit: np.ndarray, bits: int = CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, correction factors, turned vectors in four bits, their steps) of unit vectors."""
    side = max(unit.shape[1], CODE)
    turned = unit.astype(np.float32) @ rotation(unit.shape[1], max(bits, side))
    first = turned[:, :side]
    along = np.abs(first).sum(axis=1) / np.sqrt(side)
    step = np.maximum(np.abs(first).max(axis=1), 1e-9) / 7.5
    level = np.clip(np.floor(first / step[:, None] + 8), 0, 15).astype(np.uint8)
    low = level[:, 0::2] | (np.pad(level[:, 1::2], ((0, 0), (0, side % 2))) << 4)
    return np.packbits(turned > 0, axis=1, bitorder="little"), (1 / np.maximum(along, 1e-6)).astype(np.float32), low, step.astype(np.float32)


def turned_back(low: np.ndarray, step: np.ndarray, side: int) -> np.ndarray:
    """The turned vectors that four bits a dimension stand for."""
    level = np.stack([low & 15, low >> 4], axis=2).reshape(len(low), -1)[:, :side]
    return (level.astype(np.float32) - np.float32(7.5)) * step[:, None]


def estimates(signs: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates (rows of signs x rows of low) of inner products, and their error bounds."""
    x = np.unpackbits(signs, axis=1, count=side, bitorder="little").astype(np.float32) * 2 - 1
    f = factor.astype(np.float64) ** 2
    # the code's own error, and that of four bits
    error = np.maximum(f - 1, 0)[:, None] / (side - 1) + f[:, None] * (step.astype(np.float64) ** 2 / 12)[None, :]
    return (x @ turned_back(low, step, side).T) * (factor / np.float32(np.sqrt(side)))[:, None], EPS * np.sqrt(error)


def set_keys(signs: np.ndarray, k: int, sets: int, d: int) -> np.ndarray:
    """rows x sets: a hash of each group of k bits of the codes of vectors of d components."""
    bits = np.unpackbits(signs, axis=1, count=k * sets, bitorder="little").reshape(len(signs), sets, k).astype(U64)
    value = (bits << np.arange(k, dtype=U64)).sum(axis=2, dtype=U64)
    dimension = np.array([d], U64) * U64(0x9E3779B97F4A7C15)
    return mix(value + (np.arange(sets, dtype=U64) << U64(48)) + dimension)


def valid_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, None if it cannot link."""
    lists = column.cast(pa.list_(pa.float64()))
    flat = np.asarray(pc.fill_null(lists.values, float("nan")).to_numpy(zero_copy_only=False), np.float64)
    ends = lists.offsets.to_numpy()
    null = np.asarray(lists.is_null())
    out = []
    for k in range(len(lists)):
        v = flat[ends[k] : ends[k + 1]]
        out.append(v if not null[k] and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _units(raw: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, np.float64) for x in raw])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def first_shared(ka: np.ndarray, kb: np.ndarray, key: int) -> np.ndarray:
    """Whether `key` is the first that the rows of ka and kb share."""
    t = (ka == kb).argmax(axis=1)
    return ka[np.arange(len(ka)), t] == U64(key & 0xFFFFFFFFFFFFFFFF)


def survivors(a: dict, b: dict | None, key: int, k: int, sets: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Members of blocks a and b (of a alone if b is None) with a pair that the bound leaves and whose first group is key."""
    other = a if b is None else b
    side = max(a["d"], CODE)
    guess, bound = estimates(a["signs"], a["factor"], other["low"], other["step"], side)
    near = guess + bound >= threshold
    i, j = np.nonzero(np.triu(near, 1) if b is None else near)
    if len(i):
        ka = set_keys(a["signs"], k, sets, a["d"])
        kb = ka if b is None else set_keys(other["signs"], k, sets, a["d"])
        out = []
        for at in range(0, len(i), 100_000):  # so many pairs' keys at a time
            x, y = i[at : at + 100_000], j[at : at + 100_000]
            out.append(first_shared(ka[x], kb[y], key))
        first = np.concatenate(out)
        i, j = i[first], j[first]
    return np.unique(i), np.unique(j)


def block_links(a: dict, b: dict | None, key: int, k: int, sets: int, threshold: float):
    """(nodes, numbers of links by weight, forest) of the pairs of blocks a and b (of a alone if b is None) whose first
    group is key."""
    other = a if b is None else b
    near = a["unit"] @ other["unit"].T >= threshold - 1e-9
    i, j = np.nonzero(np.triu(near, 1) if b is None else near)
    if not len(i):
        return None
    ka = set_keys(a["signs"], k, sets, a["d"])
    kb = ka if b is None else set_keys(other["signs"], k, sets, a["d"])
    kept = []
    for at in range(0, len(i), 100_000):
        x, y = i[at : at + 100_000], j[at : at + 100_000]
        exact = np.einsum("ij,ij->i", a["unit"][x], other["unit"][y]) >= threshold
        kept.append(exact & first_shared(ka[x], kb[y], key))
    kept = np.concatenate(kept)
    i, j = i[kept], j[kept]
    if not len(i):
        return None
    sa, sb, wa, wb = a["node"], other["node"], a["w"], other["w"]
    node, back = np.unique(np.concatenate([sa[i], sb[j]]), return_inverse=True)
    links = np.bincount(back, np.concatenate([wb[j], wa[i]])).astype(np.int64)
    # smallest labels over the links until they stand still: a forest of edges to the smallest node
    x, y = np.searchsorted(node, sa[i]), np.searchsorted(node, sb[j])
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = np.flatnonzero(label != np.arange(len(node)))
    return node, links, list(zip(node[apart].tolist(), node[label[apart]].tolist()))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = df.sparkSession
    prepared(spark)

    def read(batches):
        part, at = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            raw = [None if v is None else v.tobytes() for v in valid_rows(batch.column(1))]
            digest = [None if r is None else sha256(r).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part + at, part + at + len(raw))), batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["_row", "_key", "digest", "v"])
            at += len(raw)

    rows = written(mapped(df.select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("_v")), read, "_row long, _key long, digest binary, v binary"), "vectors")
    valid = rows.where("digest is not null")
    same = written(valid.groupBy("digest").agg(F.count("*").alias("w"), F.min("_row").alias("node"), F.min("_key").alias("least"), F.first("v").alias("v")), "nodes")
    k, sets = plan_sets(same.count(), threshold)

    def encode(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for at in by_length(raw):
                signs, factor, low, step = codes(_units([raw[x] for x in at]), k * sets)
                rest = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (signs, low)), pa.array(factor), pa.array(step)], ["node", "w", "v", "signs", "low", "factor", "step"])

    nodes = written(mapped(same.select("node", "w", "v"), encode, "node long, w long, v binary, signs binary, low binary, factor float, step float"), "codes")
    light = nodes.select("node", (F.length("v") / 8).cast("int").alias("d"), "signs", "low", "factor", "step")

    def keyed(batches):
        for batch in batches:
            d, signs = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for at in by_length(signs, d.tolist()):
                found = set_keys(stacked([signs[x] for x in at]), k, sets, int(d[at[0]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[at], sets)), pa.array(signed(found.ravel()))], ["node", "k"])

    keys = mapped(light.select("node", "d", "signs"), keyed, "node long, k long")
    met = written(keys.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "met")
    placed = salted_join(keys, met, "k", hot_keys(met, "k", "m")).withColumn("n", F.ceil(F.col("m") / BLOCK).cast("int"))
    placed = placed.withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    by = ("k", "i", "j")
    placed = placed.select("k", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), (F.col("i") > F.col("o")).cast("int").alias("side"), "node")

    def in_blocks(batches, done):
        """done(key of a block pair, rows of its first block, of its second) for runs of rows (k, i, j, side, ...)."""
        at, held = None, ([], [])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    if at is not None:
                        yield from done(at, *held)
                    at, held = row[:3], ([], [])
                held[row[3]].append(row[4:])
        if at is not None:
            yield from done(at, *held)

    def pairs_of(at, a, b):
        """The block pair as (rows, rows or None) of one vector length each; none if no pair is in it."""
        alone = at[1] == at[2]
        for d in {r[1] for r in a}:
            x, y = [r for r in a if r[1] == d], None if alone else [r for r in b if r[1] == d]
            if (alone and len(x) > 1) or (not alone and x and y):
                yield x, y

    def sift(batches):
        def done(at, a, b):
            for x, y in pairs_of(at, a, b):
                i, j = survivors(_codes_of(x), None if y is None else _codes_of(y), at[0], k, sets, threshold)
                first = set(i.tolist()) | (set(j.tolist()) if y is None else set())
                left = [(x[r][0], 0) for r in sorted(first)] + ([] if y is None else [(y[r][0], 1) for r in j.tolist()])
                if left:
                    n = len(left)
                    yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.int64()), pa.array([at[1]] * n, pa.int32()), pa.array([at[2]] * n, pa.int32()), pa.array([s for _, s in left], pa.int32()), pa.array([r for r, _ in left], pa.int64())], [*by, "side", "node"])

        yield from in_blocks(batches, done)

    dealt = lambda df: df.repartition(*by).sortWithinPartitions(*by, "side")
    left = written(mapped(dealt(placed.join(light, "node").select(*by, "side", "node", "d", "signs", "low", "factor", "step")), sift, "k long, i int, j int, side int, node long"), "left")
    heavy = nodes.select("node", (F.length("v") / 8).cast("int").alias("d"), "w", "v", "signs")

    def compare(batches):
        def done(at, a, b):
            for x, y in pairs_of(at, a, b):
                found = block_links(_vectors_of(x), None if y is None else _vectors_of(y), at[0], k, sets, threshold)
                if found:
                    node, n, forest = found
                    yield pa.RecordBatch.from_arrays([pa.array([*node.tolist(), *(p for p, _ in forest)], pa.int64()), pa.array([*[None] * len(node), *(q for _, q in forest)], pa.int64()), pa.array([*n.tolist(), *[0] * len(forest)], pa.int64())], ["a", "b", "n"])

        yield from in_blocks(batches, done)

    found = written(mapped(dealt(left.join(heavy, "node").select(*by, "side", "node", "d", "w", "v", "signs")), compare, "a long, b long, n long"), "links")
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b is not null").select("a", "b")).select("node", F.col("component").alias("class"))
    named = same.select("digest", "node", "w", "least").join(degree, "node", "left").join(linked, "node", "left")
    named = written(named.select("digest", "w", "least", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("class", "node").alias("class")), "named")
    classes = written(named.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "classes")
    nodes_named = salted_join(named, classes.select("class", "component_id"), "class", hot_keys(classes, "class", "m"))
    full = salted_join(valid.select("digest", "_key"), nodes_named.select("digest", "n_links", "component_id"), "digest", hot_keys(named, "digest", "w"))
    out = full.select("_key", "n_links", "component_id").unionByName(rows.where("digest is null").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id")))
    return out.select(F.col("_key").alias(key), "n_links", "component_id", (F.col("component_id").isNull() | F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False))).alias("kept"))


def by_length(raw: list[bytes], more: list | None = None) -> list[list[int]]:
    """Places of rows of equal length (and equal `more`)."""
    out: dict = {}
    for at, r in enumerate(raw):
        out.setdefault((len(r), more[at] if more else 0), []).append(at)
    return list(out.values())


def stacked(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _codes_of(rows: list[tuple]) -> dict:
    _, d, signs, low, factor, step = zip(*rows)
    return {"d": d[0], "signs": stacked(signs), "low": stacked(low), "factor": np.array(factor, np.float32), "step": np.array(step, np.float32)}


def _vectors_of(rows: list[tuple]) -> dict:
    node, d, w, v, signs = zip(*rows)
    return {"d": d[0], "node": np.array(node, np.int64), "w": np.array(w, np.int64), "unit": _units(v), "signs": stacked(signs)}
