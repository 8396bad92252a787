"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

N-grams are ordered by hash. A document's set is cut into fragments of that
order; fragments' partial overlaps are counted separately and summed per pair.

1. Candidates. Two sets with Jaccard >= t and sizes at most u differ in at most
   d = (1 - t) / (1 + t) * 2u n-grams, so of more than d fragments at least one is
   equal in both. Sizes fall in bands (the smaller of a pair is in the larger's
   band or the one below), each band with its number of fragments; the row
   (band, fragment, content) of every non-empty fragment meets its equals in a
   sorted exchange. In the order of how many sets share a fragment, the first that
   a pair shares is among the first d + 1 of both: only these make candidates, so
   fragments of passages that many documents share drop out of documents that
   have enough of their own. A set with too few non-empty fragments for the
   argument also sends its empty ones, and keeps all. Rows of a fragment are as many
   as members, never their pairs.
2. Each set is compared with one of its fragments' centres first, the one that it
   shares most candidate fragments with. What links is joined, so a group of copies
   is one component from here on, and its fragments are done.
3. Only fragments whose members are in several components are left; of fragments
   with the same members one is. Its members are cut into blocks of at most BLOCK
   sets that meet pairwise, those of a component that fills blocks of its own only
   with the others. (Where the fragments that chain sets together overlap so much
   that all these sets meet in fewer rows, the chain takes the fragments' place.)
   Block by block the order is cut into fragments, the partial overlaps of all pairs in a fragment are counted, and the sums decide with
   integers. Only edges that connect the same sets leave a block pair, one per set.
4. Components of the links; equal sets (same hash of the whole set) are one node.

No candidate is dropped, and no fragment is collected in one task: one with m
members costs at most (m / BLOCK)**2 / 2 block pairs, spread over tasks, whatever
the fragments that chain it to others. Sets and n-grams are told apart by 64-bit
hashes of their content (words by chained mixing, see text.py).

null or wordless text: an empty set, linked with nothing; its component is its own
id. Fewer than n words: one n-gram of all words. Repeated rows are equal sets;
null ids take part, and the component is the smallest id that is not null (null
if there is none). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .shared import hot_keys, mapped, prepared, salted_join, written
from .text import U64, buffers, mix, ragged, row_starts, signed, slices, word_hashes

#: Sets and n-grams in a block; fragments of the order that are counted one after the other in a block pair.
BLOCK, BLOCK_GRAMS, COUNTED = 512, 500_000, 8
#: Rows of one fragment that a task holds; the number of sets that a fragment with more counts as having.
HELD, HUGE = 1 << 20, 1 << 40
#: The low bits of a set's hash are 0; a fragment's row has there whether it stands in the band above its own.
_LOW = U64(3)


def set_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row, sorted by hash, one row after the other, and their number per row."""
    h, _, _, counts = word_hashes(data, offsets)
    rows, edges = len(counts), row_starts(counts)
    grams = np.maximum(counts - n + 1, 0)
    first = ragged(np.arange(len(h)), edges[:-1], grams)
    g = np.zeros(len(first), U64)
    for k in range(n):
        g = (g * U64(0xD6E8FEB86659FD93)) ^ h[first + k]
        g = mix(g)
    row = np.repeat(np.arange(rows), grams)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        s = np.zeros(len(short), U64)
        for k in range(n - 1):
            has = counts[short] > k
            s[has] = mix((s[has] * U64(0xD6E8FEB86659FD93)) ^ h[edges[short[has]] + k])
        g, row = np.concatenate([g, mix(s + counts[short].astype(U64))]), np.concatenate([row, short])
    order = np.argsort(g)
    order = order[np.argsort(row[order], kind="stable")]
    g, row = g[order], row[order]
    if len(g):
        new = np.append(True, (g[1:] != g[:-1]) | (row[1:] != row[:-1]))
        g, row = g[new], row[new]
    return g, np.bincount(row, minlength=rows)


def signatures(g: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each row's whole set, never 0; 0 for an empty one."""
    if not len(g):
        return np.zeros(len(counts), U64)
    edges = row_starts(counts)
    total = np.concatenate([[U64(0)], np.cumsum(mix(g ^ U64(0x5851F42D4C957F2D)))])
    s = mix((total[edges[1:]] - total[edges[:-1]]) + counts.astype(U64) * U64(0x2545F4914F6CDD1D))
    return np.where(counts > 0, np.maximum(s & ~_LOW, U64(4)), U64(0))


def band_of(size: np.ndarray, percent: int) -> np.ndarray:
    """Bands of sizes: bounds grow by 1 / threshold, so a pair is in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def most_differing(band: np.ndarray, percent: int) -> np.ndarray:
    """Most n-grams that a linked pair differs in whose larger set is in the band."""
    top = np.ceil((100 / percent) ** (band + 1) + 1e-6)
    return np.floor((100 - percent) * 2 * top / (100 + percent) + 1e-9).astype(np.int64)


def fragment_keys(g: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, step, key, quota, sent) of every fragment that has to meet its equals. step: 0 in the set's own band,
    1 in the one above. quota: how many of the set's fragments, rarest first, make candidates; sent: how many it sends."""
    out: list[tuple[np.ndarray, ...]] = []
    edges, own = row_starts(counts), band_of(counts, percent)
    for up in (0, 1):  # as the larger of a pair, or as the smaller below larger ones
        band = own + up
        differ = most_differing(band, percent)
        pieces = np.ceil(differ * 1.15).astype(np.int64) + 2
        # sets that differ in nothing are equal, and those are one node already
        rows = np.flatnonzero((counts > 0) & (differ > 0))
        if not len(rows):
            continue
        size = counts[rows]
        grams = ragged(g, edges[rows], size)
        at = np.repeat(np.arange(len(rows)), size)
        f = ((grams >> U64(32)) * pieces[rows][at].astype(U64)) >> U64(32)
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (f[1:] != f[:-1])))
        content = np.add.reduceat(mix(grams ^ U64(0x8CB92BA72F3D8DD7)), new)
        place = mix(band[rows][at[new]].astype(U64) * U64(1 << 32) + f[new] + U64(0x7F4A7C15))
        filled = np.bincount(at[new], minlength=len(rows))
        few = filled <= differ[rows]
        quota = np.where(few, pieces[rows], differ[rows] + 1)
        sent = np.where(few, pieces[rows], filled)

        def put(local: np.ndarray, keys: np.ndarray, rows=rows, up=up, quota=quota, sent=sent) -> None:
            out.append((rows[local], np.full(len(local), up), keys, quota[local], sent[local]))

        put(at[new], mix(content + place))
        for r in np.flatnonzero(few):
            gone = np.setdiff1d(np.arange(pieces[rows[r]], dtype=U64), f[new][at[new] == r])
            put(np.full(len(gone), r), mix(mix(band[rows[r]].astype(U64) * U64(1 << 32) + gone + U64(0x7F4A7C15)) ^ U64(0xE7037ED1A0B428DB)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.view(U64), z, z
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def linked_forest(ids_a: np.ndarray, sets_a: list[np.ndarray], ids_b: np.ndarray, sets_b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between two blocks (or within one, given twice) connect."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    row_a, row_b = np.repeat(np.arange(len(sets_a)), size_a), np.repeat(np.arange(len(sets_b)), size_b)
    overlap = np.zeros(len(sets_a) * len(sets_b), np.int32)
    part_a, part_b = flat_a >> U64(61), flat_b >> U64(61)  # COUNTED fragments of the order
    for f in range(COUNTED):
        in_a, in_b = part_a == f, part_b == f
        x, ra, y, rb = flat_a[in_a], row_a[in_a], flat_b[in_b], row_b[in_b]
        order = np.argsort(y)
        y, rb = y[order], rb[order]
        lo, hi = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        n = hi - lo
        done, edges = 0, row_starts(n)
        while done < len(x):  # so many partial overlaps at a time
            stop = max(done + 1, int(np.searchsorted(edges, edges[done] + 500_000, "right")) - 1)
            pair = np.repeat(ra[done:stop], n[done:stop]) * len(sets_b) + ragged(rb, lo[done:stop], n[done:stop])
            overlap += np.bincount(pair, minlength=len(overlap)).astype(np.int32)
            done = stop
    overlap = overlap.reshape(len(sets_a), len(sets_b))
    union = size_a[:, None] + size_b[None, :] - overlap
    linked = 100 * overlap.astype(np.int64) >= percent * union
    return stars_of(linked, ids_a, ids_b)


def stars_of(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id reached) of the components of a matrix of links; ids without a link give none."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part = linked[np.ix_(rows, columns)]
    label_a, label_b = ids_a[rows], ids_b[columns]
    none = np.iinfo(np.int64).max
    while len(rows):
        new_a = np.minimum(label_a, np.where(part, label_b[None, :], none).min(axis=1))
        new_b = np.minimum(label_b, np.where(part, new_a[:, None], none).min(axis=0))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    ids, labels = np.concatenate([ids_a[rows], ids_b[columns]]), np.concatenate([label_a, label_b])
    apart = ids != labels
    return ids[apart], labels[apart]


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between signatures from rows (grp, i, j, side, sig, grams) sorted by block pair."""

    def run(batches):
        key, held = None, ([], [])

        def done():
            a, b = held
            if key is None or not a:
                return []
            other = a if key[1] == key[2] else b
            if not other:
                return []
            ids = lambda rows: np.array([x for x, _ in rows], np.int64)
            x, y = linked_forest(ids(a), [s for _, s in a], ids(other), [s for _, s in other], percent)
            return [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])] if len(x) else []

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(5)]
            grams = batch.column(5)
            for k, (grp, i, j, side, sig) in enumerate(zip(*cols)):
                if (grp, i, j) != key:
                    yield from done()
                    key, held = (grp, i, j), ([], [])
                held[side].append((sig, np.frombuffer(grams[k].as_py(), U64)))
        yield from done()

    return mapped(blocks.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side"), run, "a long, b long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row; rows link when 100 * |both| >= percent * |either|."""
    spark = docs.sparkSession
    prepared(spark)
    own = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    def summary(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b, d, o in slices(data, offsets):
                g, counts = set_hashes(d, o, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(signed(signatures(g, counts)))], ["_key", "n_shingles", "sig"])

    table = written(mapped(own, summary, "_key long, n_shingles long, sig long"), "sets")

    def keys(batches):
        known: set[int] = set()  # the sets whose fragments this task has sent: copies send none
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, d, o in slices(data, offsets):
                g, counts = set_hashes(d, o, n)
                own_sig = signatures(g, counts)
                fresh = np.array([counts[r] > 0 and not (s in known or known.add(s)) for r, s in enumerate(own_sig.tolist())], bool)
                g, counts, own_sig = g[np.repeat(fresh, counts)], counts[fresh], own_sig[fresh]
                row, step, k, quota, sent = fragment_keys(g, counts, percent)
                sig = own_sig[row] | step.astype(U64)
                # quota and sent are functions of the set; they travel as their difference, and only matter where fragments meet
                yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(signed(sig)), pa.array((sent - quota).astype(np.int32))], ["k", "sig", "spare"])

    fragments = mapped(own.select("_text"), keys, "k long, sig long, spare int")

    def shared(batches):
        """Rows of fragments that two or more sets have, with the number of these sets, repeated sets once. At most
        HELD rows of a fragment are held: a larger one counts as HUGE, and its rows go on as they come."""
        held_k, held, size, last_sig = None, [], 0, None

        def rows_of(parts, freq):
            rows = np.concatenate(parts)
            return np.column_stack([np.full(len(rows), held_k), rows, np.full(len(rows), freq)])

        def done():
            if not held:
                return None
            sets = len(np.unique(np.concatenate([h[:, 0] for h in held]) & ~3))
            return rows_of(held, sets) if sets > 1 else None

        for batch in batches:
            k, rows = batch.column(0).to_numpy(), np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)])
            if not len(k):
                continue
            fresh = np.append(True, (k[1:] != k[:-1]) | (rows[1:, 0] != rows[:-1, 0]))
            k, rows = k[fresh], rows[fresh]
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            ends, out = np.append(starts[1:], len(k)), []
            # runs of one row, which are nearly all, need no look unless they touch the batch's edges
            for j in np.unique(np.concatenate([[0, len(starts) - 1], np.flatnonzero(ends - starts > 1)])):
                part = rows[starts[j] : ends[j]]
                if k[starts[j]] != held_k:
                    out.append(done())
                    held_k, held, size, last_sig = k[starts[j]], [], 0, None
                elif part[0, 0] == last_sig:
                    part = part[1:]
                if not len(part):
                    continue
                last_sig = part[-1, 0]
                size += len(part)
                if size <= HELD:
                    held.append(part)
                else:
                    out.append(rows_of([*held, part], HUGE))
                    held = []
            found = [o for o in out if o is not None]
            if found:
                yield named(np.concatenate(found))
        rest = done()
        if rest is not None:
            yield named(rest)

    def named(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3])], ["k", "sig", "spare", "freq"])

    met = mapped(fragments.repartition("k").sortWithinPartitions("k", "sig"), shared, "k long, sig long, spare long, freq long")
    own_order = Window.partitionBy("sig").orderBy("freq", "k")
    ranked = met.withColumn("rank", F.row_number().over(own_order)).withColumn("n", F.count("*").over(Window.partitionBy("sig")))
    # fragments that no other set has come first and make no candidates: of n shared ones, n - spare are left
    kept = written(ranked.where(F.col("rank") <= F.col("n") - F.col("spare")).select("k", F.col("sig").bitwiseAND(F.lit(~3)).alias("sig")), "candidates")
    # one row per distinct set, with its rows; a set with a third of all rows is combined before the shuffle
    distinct = written(table.where("sig <> 0").groupBy("sig").agg(F.count("*").alias("m"), F.min("_key").alias("least"), F.min(F.struct(F.col("_key").isNull(), "_key")).alias("doc"), F.first("n_shingles").alias("n_shingles")), "distinct")
    fragments_of = kept.groupBy("k").agg(F.min("sig").alias("centre"), F.max("sig").alias("top"), F.count("*").alias("m")).where("centre <> top")
    fragments_of = written(fragments_of.select("k", "centre", "m"), "fragments")
    in_common = written(salted_join(kept, fragments_of.select("k", "centre"), "k", hot_keys(fragments_of, "k", "m")), "in-common")
    involved = in_common.select("sig").distinct()

    def grams(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, d, o in slices(data, offsets):
                g, counts = set_hashes(d, o, n)
                e = row_starts(counts).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(signed(signatures(g, counts))), pa.array([g[x:y].tobytes() for x, y in zip(e[:-1], e[1:])], pa.binary())], ["sig", "grams"])

    # one document for each set that has a candidate; its text is read again
    chosen = distinct.join(involved, "sig").select("sig", "n_shingles", F.col("doc._key").alias("_key"))
    texts = own.join(chosen.select("_key").distinct(), own["_key"].eqNullSafe(chosen["_key"]), "left_semi").select("_text")
    sets = mapped(texts, grams, "sig long, grams binary").groupBy("sig").agg(F.first("grams").alias("grams"))
    members = written(chosen.select("sig", "n_shingles").join(sets, "sig"), "members")
    sizes = members.select("sig", "n_shingles")

    # each set with the centre that it shares most with
    near = in_common.where("sig <> centre").groupBy("sig", "centre").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "centre")).alias("b")).select("sig", F.col("b.centre").alias("grp"))
    near = written(_numbered(near.join(sizes, "sig")).select("grp", "sig", (F.col("i") + 1).alias("j")), "near")
    ends = near.select("grp", F.lit(0).alias("i"), "j", F.lit(1).alias("side"), "sig").unionByName(near.select("grp", F.lit(0).alias("i"), "j", F.lit(0).alias("side"), F.col("grp").alias("sig")).distinct())
    first = written(_links(ends.join(members, "sig").select("grp", "i", "j", "side", "sig", "grams"), percent), "first-links")
    joined = components(first).select(F.col("node").alias("sig"), F.col("component").alias("class"))

    # fragments whose members are in several components, one of those with the same members
    marked = written(in_common.select("k", "sig").join(joined, "sig", "left").join(sizes, "sig").select("k", "sig", F.coalesce("class", "sig").alias("class"), "n_shingles"), "marked")
    same = [F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"), F.count("*").alias("m"), F.min("sig").alias("lo"), F.max("sig").alias("hi")]
    open_ = marked.groupBy("k").agg(*same, F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    open_ = written(open_.groupBy("x", "y", "m", "lo", "hi").agg(F.min("k").alias("k")).select("k", "m", "lo"), "open")
    left = written(salted_join(marked, open_.select("k", "lo"), "k", hot_keys(open_, "k", "m")), "left")
    # where fragments overlap so much that all sets that they chain meet in fewer rows than fragment by fragment, these do
    chains = written(components(left.where("sig <> lo").select(F.col("sig").alias("a"), F.col("lo").alias("b"))), "chains")
    rows_of = lambda m: m * F.ceil(m / BLOCK)
    together = chains.groupBy(F.col("component").alias("chain")).agg(F.count("*").alias("m"))
    apart = open_.join(chains, open_["lo"] == chains["node"]).groupBy(F.col("component").alias("chain")).agg(F.sum(rows_of(F.col("m"))).alias("apart"))
    whole = written(together.join(apart, "chain").where(rows_of(F.col("m")) <= F.col("apart")).select("chain", "m"), "whole")
    of_chain = chains.select(F.col("node").alias("sig"), F.col("component").alias("chain"))
    of_chain = salted_join(of_chain, whole.withColumn("_whole", F.lit(True)).drop("m"), "chain", hot_keys(whole, "chain", "m"), "left")
    sets_of = written(left.select("sig", "class", "n_shingles").distinct().join(of_chain, "sig"), "chained")
    by_chain = sets_of.where("_whole").select(F.col("chain").alias("grp"), "sig", "class", "n_shingles")
    by_fragment = left.join(sets_of.where("_whole is null").select("sig"), "sig").select(F.col("k").alias("grp"), "sig", "class", "n_shingles")
    met = _met(written(by_chain.unionByName(by_fragment), "meeting"))
    second = _links(met.join(members.select("sig", "grams"), "sig").select("grp", "i", "j", "side", "sig", "grams"), percent)

    linked = components(first.unionByName(second)).select(F.col("node").alias("sig"), F.col("component").alias("class"))
    named = written(distinct.join(linked, "sig", "left").select("sig", "m", "least", F.coalesce("class", "sig").alias("class")), "named")
    classes = written(named.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "classes")
    found = salted_join(named.select("sig", "class"), classes.select("class", "component_id"), "class", hot_keys(classes, "class", "n"))
    full = salted_join(table.where("sig <> 0"), found.select("sig", "component_id"), "sig", hot_keys(named, "sig", "m"))
    full = full.select(F.col("_key").alias(key), "n_shingles", "component_id")
    return full.unionByName(table.where("sig = 0").select(F.col("_key").alias(key), "n_shingles", F.col("_key").alias("component_id")))


def _blocks(m, grams):
    return F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(grams / BLOCK_GRAMS)).cast("int")


def _numbered(placed: DataFrame) -> DataFrame:
    """placed (sig, grp, n_shingles) with the number i of its block in its group, by hash: a group of any size is
    numbered without a task that holds it."""
    counts = written(placed.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("grams")), "groups")
    dealt = salted_join(placed, counts.select("grp", _blocks(F.col("m"), F.col("grams")).alias("n")), "grp", hot_keys(counts, "grp", "m"))
    return dealt.select("sig", "grp", F.pmod(F.xxhash64("sig"), F.col("n")).cast("int").alias("i"))


def _met(left: DataFrame) -> DataFrame:
    """(grp, i, j, side, sig) of the block pairs of each group of left (grp, sig, class, n_shingles). The largest class,
    if it fills more than a block, has blocks of its own, which meet only the others'."""
    per = written(left.groupBy("grp", "class").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("grams")), "parts")
    groups = per.groupBy("grp").agg(F.max(F.struct("m", "class", "grams")).alias("top"), F.sum("m").alias("m"), F.sum("grams").alias("grams"))
    apart = F.col("top.m") > BLOCK
    rest = [F.col(c) - F.when(apart, F.col(f"top.{c}")).otherwise(0) for c in ("m", "grams")]
    groups = groups.select("grp", "m", F.when(apart, F.col("top.class")).alias("big"), _blocks(*rest).alias("n"), F.when(apart, _blocks(F.col("top.m"), F.col("top.grams"))).otherwise(0).alias("n_big"))
    groups = written(groups, "parts")
    dealt = salted_join(left, groups.drop("m"), "grp", hot_keys(groups, "grp", "m"))
    inside = F.coalesce(F.col("class") == F.col("big"), F.lit(False))
    i = F.when(inside, F.col("n") + F.pmod(F.xxhash64("sig"), F.greatest("n_big", F.lit(1)))).otherwise(F.pmod(F.xxhash64("sig"), F.col("n"))).cast("int")
    others = F.sequence(F.lit(0), F.when(inside, F.col("n")).otherwise(F.col("n") + F.col("n_big")) - 1)
    placed = dealt.withColumn("i", i).withColumn("o", F.explode(others))
    return placed.select("grp", F.least("i", "o").cast("int").alias("i"), F.greatest("i", "o").cast("int").alias("j"), (F.col("i") > F.col("o")).cast("int").alias("side"), "sig")
