"""Ordered unions and the list of base files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .search import collapse_parallel


def ordered_union(parts: list[DataFrame], key: str, order: str = "rank", removed: DataFrame | None = None) -> DataFrame:
    """The rows of parts, one for each key: the first by (number of its part, order), less removed keys.

    min over (part, order, row) is combined before the shuffle, so a key that repeats often stays cheap."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    if removed is not None:
        rows = rows.join(removed.select(key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c not in (key, "part", order)]
    first = rows.groupBy(key).agg(F.min(F.struct("part", order, *rest)).alias("_first"))
    return first.select(key, "_first.*")


def base_files(parts: list[DataFrame], models: DataFrame, removed: DataFrame | None = None, additions: DataFrame | None = None, confirmed: DataFrame | None = None, preferred: str = "") -> DataFrame:
    """(file_path, source, role, fan_in, confidence, confirmed, part, rank) of the context: found files (each once),
    parallel copies collapsed, then the user's additions; confirmations hold."""
    found = ordered_union([p.select("file_path", "source", "role", F.col("fan_in_count").alias("fan_in"), "confidence", "rank") for p in parts], "file_path", "rank", removed)
    found = found.join(models.select("file_path", "symbols", "type_symbols"), "file_path", "left")
    symbol = F.coalesce(F.array_min("type_symbols"), F.array_min("symbols"), paths.stem(F.col("file_path")))
    slashed = paths.slashes(F.col("file_path"))
    prefer = F.when(F.lit(bool(preferred)) & F.startswith(slashed, F.lit(preferred)), 0).otherwise(1)
    order = [prefer, -F.col("fan_in").cast("double"), -F.col("confidence")]
    kept = collapse_parallel(found, symbol, F.substring_index(slashed, "/", 1), order, [F.col("part"), F.col("rank"), F.col("file_path")]).drop("also_in", "symbols", "type_symbols").withColumn("confirmed", F.lit(False))
    if additions is not None:
        extra = additions.select("file_path", "rank").join(kept.select("file_path"), "file_path", "left_anti")
        if removed is not None:
            extra = extra.join(removed.select("file_path"), "file_path", "left_anti")
        extra = extra.groupBy("file_path").agg(F.min("rank").alias("rank")).select(
            "file_path", F.lit("user").alias("source"), F.lit(None).cast("string").alias("role"), F.lit(0).cast("long").alias("fan_in"), F.lit(1.0).alias("confidence"), F.lit(len(parts)).alias("part"), "rank", F.lit(True).alias("confirmed")
        )
        kept = kept.unionByName(extra)
    if confirmed is not None:
        marks = confirmed.select("file_path").distinct().withColumn("_sure", F.lit(True))
        kept = kept.join(marks, "file_path", "left").withColumn("confirmed", F.col("confirmed") | F.coalesce("_sure", F.lit(False))).drop("_sure")
    return kept.orderBy("part", "rank", "file_path")
