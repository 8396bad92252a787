"""Mixing sources to target weights over a curriculum whose weights change in time.

1. Weights share `total` words among sources; no source gives more than `epochs`
   times its size, and what it cannot give goes to the others by weight
   (water-filling in closed form, over one row per source).
2. A source's documents form a stream in a fixed random order (md5 of the id),
   repeated per epoch; the mix takes its first `target` words.
3. Each source's weight goes linearly from weight * (1 + tilt) at the start to
   weight * (1 - tilt) at the end. Its integral is the source's cumulative demand;
   the inverse of it at a document's place in the stream is the training position.
4. Documents are range-sorted by position.

Only DataFrame operations. The running sums are two-level: 4096 hash buckets of
each source are summed first, so no task ever holds a source.

null text or no words: size 0, taken 0. A null source is a source of its own, last.
Equal ids (repeated rows) are ordered by text; equal rows are interchangeable.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights in turn of the sources, and how far each one's weight tilts over the run.
WEIGHTS, TILTS = (5.0, 2.0, 1.0), (0.5, 0.0, -0.5)
SHARE, EPOCHS, BUCKET_DIGITS = 1.5, 2, 3
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS, tilts=TILTS) -> DataFrame:
    """sizes (source, source_size) with weight, tilt and target; one row per source."""
    w = lambda *order: Window.orderBy(*order)  # noqa: E731  a row per source: one small task
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), ((F.col("source_rank") - 1) % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("source_rank", F.row_number().over(w(F.col("source").asc_nulls_last())))
    ranked = ranked.select("*", pick(weights).alias("weight"), pick(tilts).alias("tilt"), (F.col("source_size") * epochs).alias("most"))
    order = (F.col("most") / F.col("weight"), F.col("source_rank"))
    upto = w(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = w(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(upto), F.lit(0))) / F.sum("weight").over(rest)
    # sources before the first whose limit the level leaves out stop at their limit; the others get weight * level
    found = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct(*order, "level"))).over(everything)["level"]
    return found.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * level, F.col("most").cast("double")))).select(
        "source", "source_size", "weight", "tilt", "target"
    )


def position(at: Column, target: Column, tilt: Column) -> Column:
    """The time x in 0..1 at which a source's demand target * ((1 + tilt) x - tilt x^2) reaches `at`."""
    y = F.when(target > 0, F.least(at / target, F.lit(1.0))).otherwise(0.0)
    root = F.sqrt(F.greatest((1 + tilt) * (1 + tilt) - 4 * tilt * y, F.lit(0.0)))
    # the form of the smaller root that holds for tilt = 0 as well
    return 2 * y / ((1 + tilt) + root)


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: key, size, source, source_size, target, taken, copies, first_position, last_position.

    whole: documents are taken whole (a copy counts when at least half of it is within the target);
    otherwise the last document of each source is cut at the target. keep: columns to carry along as they are."""
    name = F.col(source).cast("string")
    own = docs.select(
        F.col(key).alias("_key"), size_of(F.col(text)).alias("size"), F.coalesce(name, F.lit("")).alias("_source"), name.isNull().alias("_none"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_order"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tie"), *[F.col(f"`{c}`").alias(f"_keep_{k}") for k, c in enumerate(keep)],
    )
    own = own.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    by = ["_source", "_none"]
    buckets = own.groupBy(*by, "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    sizes = buckets.groupBy(*by).agg(F.sum("_sum").alias("source_size")).select(F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size")
    goals = targets(sizes).select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "source_size", "target", "tilt")
    # the window below uses the join's partitioning: the documents are shuffled once
    joined = own.join(starts.join(goals, by), [*by, "_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy("_order", "_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("_at", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal, at, size, full = F.round("target").cast("long"), F.col("_at"), F.col("size"), F.col("source_size")
    if whole:
        held = lambda e: F.when((size > 0) & (2 * (goal - full * e - at) >= size), size).otherwise(0)
    else:
        held = lambda e: F.greatest(F.lit(0), F.least(size, goal - full * e - at))
    parts = [held(e) for e in range(EPOCHS)]
    taken, copies = sum(parts[1:], parts[0]), sum([F.when(p > 0, 1).otherwise(0) for p in parts[1:]], F.when(parts[0] > 0, 1).otherwise(0))
    out = placed.withColumn("taken", taken.cast("long")).withColumn("copies", copies.cast("int"))
    when = lambda e: F.round(position((at + full * e).cast("double"), F.col("target"), F.col("tilt")), 9)
    last = when(F.col("copies") - 1)
    return out.select(
        F.col("_key").alias(key), "size", F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size", "target", "taken", "copies", F.when(F.col("copies") > 0, when(F.lit(0))).alias("first_position"), F.when(F.col("copies") > 0, last).alias("last_position"),
        *[f"_keep_{k}" for k in range(len(keep))],
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The plan, range-sorted by training position; documents that are not taken come last."""
    order = [F.col("first_position").asc_nulls_last(), F.col(key)]
    return plan(docs, key, text, source).repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix takes them: whole documents, a row for each copy, range-sorted by position."""
    names = docs.columns
    planned = plan(docs, key, text, source, whole=True, keep=tuple(names))
    copies = planned.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.when(F.col("_copy") == 0, F.col("first_position")).otherwise(F.col("last_position"))
    order = [F.col("_position"), F.col(f"`{key}`")]
    return copies.withColumn("_position", at).repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(names)])
