"""Exact vector search: distance, filter, top-k, collapse of parallel copies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import paths, vectors


def contains_filter(column: Column, pattern: str, literal: bool = False) -> Column:
    """column LIKE '%pattern%': `_` and `%` of the pattern are wildcards, unless literal."""
    return column.contains(pattern) if literal else column.like(f"%{pattern}%")


def knn(items: DataFrame, query: list[float], k: int, tiebreak: list[str], vector: str = "vector", where: Column | None = None, filter_mode: str = "pre", form: str = "l2_squared") -> DataFrame:
    """The k rows nearest to query with a column score, ascending; ties by tiebreak.

    filter_mode "pre" filters before the top k, "post" after it (fewer than k may be left). The query travels as
    a literal, so the plan is one scan and a top-k of k rows per task."""
    scored = items.where(where) if where is not None and filter_mode == "pre" else items
    q = F.array(*[F.lit(float(x)) for x in query])
    top = scored.withColumn("score", vectors.distance(F.col(vector), q, form)).orderBy("score", *tiebreak).limit(k)
    return top.where(where) if where is not None and filter_mode == "post" else top


def knn_batch(items: DataFrame, queries: DataFrame, k: int, tiebreak: list[str], vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", block: int = 10_000, form: str = "l2_squared") -> DataFrame:
    """items' columns with query_id, score and rank (1 to k) of the k rows nearest to each query; ties by tiebreak.

    The stated query set meets all rows in blocks of about `block` queries, of which one at a time is broadcast. Each
    batch of items keeps its k best rows (and all that tie with the last) for each query, so what is ranked is a few
    rows per query and batch, never items x queries. Rows or queries without a vector meet nothing."""
    schema = StructType([*queries.select(query_id).schema.fields, *items.schema.fields, StructField("score", DoubleType())])
    n = max(1, -(-queries.count() // block))
    asked = queries.where(F.col(query_vector).isNotNull())
    parts = [_nearest(items, asked.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == b), k, vector, query_id, query_vector, form, schema) for b in range(n)]
    order = Window.partitionBy(query_id).orderBy("score", *tiebreak)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(items: DataFrame, asked: DataFrame, k: int, vector: str, query_id: str, query_vector: str, form: str, schema: StructType) -> DataFrame:
    rows = asked.select(query_id, query_vector).toArrow()  # one block of the stated set
    ids, matrix = rows.column(0), [np.asarray(v, np.float64) for v in rows.column(1).to_pylist()]
    shared = items.sparkSession.sparkContext.broadcast(matrix)
    at = items.columns.index(vector)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(at)))
            held = np.array(batch.column(at).to_pylist(), np.float64)
            for q, wanted in enumerate(shared.value if batch.num_rows else ()):
                score = ((held - wanted) ** 2).sum(axis=1)
                if form != "l2_squared":
                    score = np.sqrt(score)
                last = np.partition(score, k - 1)[k - 1] if len(score) > k else np.inf
                best = np.flatnonzero(score <= last)
                taken = batch.take(pa.array(best))
                own = pa.concat_arrays([ids.slice(q, 1).combine_chunks()] * len(best)) if len(best) else ids.slice(0, 0).combine_chunks()
                yield pa.RecordBatch.from_arrays([own, *taken.columns, pa.array(score[best])], schema.fieldNames())

    return items.mapInArrow(run, schema)


def collapse_parallel(rows: DataFrame, symbol: Column, root: Column, order: list[Column], position: list[Column]) -> DataFrame:
    """Of rows with one symbol in two or more roots only the first by `order` stays, with `also_in` (the other
    roots, sorted); rows of a symbol within one root all stay. `position` makes the order total."""
    names = [f"`{c}`" for c in rows.columns]
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate([*order, *position])])
    marked = rows.withColumn("_symbol", symbol).withColumn("_root", root).withColumn("_rank", rank)
    # combined before the shuffle, so that a symbol with a third of all rows is one row per task
    groups = marked.groupBy("_symbol").agg(F.collect_set("_root").alias("_roots"), F.min("_rank").alias("_best"))
    joined = marked.join(groups.withColumnRenamed("_symbol", "_key"), F.col("_symbol").eqNullSafe(F.col("_key")))
    many = F.size("_roots") >= 2
    also = F.when(many, F.array_sort(F.array_except("_roots", F.array("_root"))))
    return joined.where(~many | (F.col("_rank") == F.col("_best"))).withColumn("also_in", also).select(*names, "also_in")


def primary_symbol(declarations: Column, path: Column) -> Column:
    """First declaration, else the file's stem."""
    return F.coalesce(F.get(declarations, F.lit(0)), paths.stem(path))


def collapse_results(hits: DataFrame, preferred: str = "") -> DataFrame:
    """collapse_parallel of search results (score, file_path, chunk_index, declarations, path_module)."""
    place = paths.slashes(F.when(F.coalesce("path_module", F.lit("")) != "", F.col("path_module")).otherwise(F.col("file_path")))
    prefer = F.when(F.lit(bool(preferred)) & F.startswith(place, F.lit(preferred)), 0).otherwise(1)
    root = paths.path_root(F.col("path_module"), F.col("file_path"))
    return collapse_parallel(hits, primary_symbol(F.col("declarations"), F.col("file_path")), root, [prefer, F.col("score")], [F.col("file_path"), F.col("chunk_index")])
