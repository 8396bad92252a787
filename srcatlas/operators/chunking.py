"""Size-adaptive chunks of files, as folds over each file's ordered declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import paths, roles
from ..functions import text as T

RANGE = "struct<start:int,end:int,names:array<string>>"


def merge_greedy(ranges: Column, target: Column) -> Column:
    """Consecutive ranges joined while the joined one has at most `target` lines. A range that is longer alone
    stays whole. The fold restarts at every cut, which no window frame expresses."""
    none = F.lit(None).cast(RANGE)
    start = F.struct(F.array().cast(f"array<{RANGE}>").alias("done"), none.alias("open"))

    def step(acc, r):
        open_ = acc["open"]
        fits = open_.isNotNull() & (r["end"] - open_["start"] + 1 <= target)
        joined = F.struct(open_["start"].alias("start"), r["end"].alias("end"), F.concat(open_["names"], r["names"]).alias("names"))
        done = F.when(open_.isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(open_)))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(r).cast(RANGE).alias("open"))

    return F.aggregate(ranges, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def add_overlap(ranges: Column, overlap: int) -> Column:
    """Every range but the first starts `overlap` lines earlier, at line 1 at the earliest."""
    return F.transform(ranges, lambda r, i: F.struct(F.when(i > 0, F.greatest(F.lit(1), r["start"] - overlap)).otherwise(r["start"]).cast("int").alias("start"), r["end"].alias("end"), r["names"].alias("names"), (i > 0).alias("has_overlap")))


def header(path: Column, package: Column, imports: Column) -> Column:
    """The package and import lines that chunks after the first start with; '' if there are none."""
    line = F.transform(imports, lambda m: F.concat(F.lit("import "), m["path"], F.when(m["is_wildcard"], ".*").otherwise(""), F.when(m["alias"].isNotNull(), F.concat(F.lit(" as "), m["alias"])).otherwise("")))
    above = F.when(~path.endswith(".swift") & (F.coalesce(package, F.lit("")) != ""), F.array(F.concat(F.lit("package "), package), F.lit(""))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(above, line)
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n"), F.lit("\n"))).otherwise("")


def chunk_files(parsed: DataFrame, settings: Settings | None = None) -> DataFrame:
    """chunks (without vectors) of parsed files."""
    s = settings or Settings("")
    path = F.col("file_path")
    top = F.filter("declarations", lambda d: d["depth"] == 0)
    ranges = F.transform(top, lambda d: F.struct((d["start_line0"] + 1).alias("start"), (d["end_line0"] + 1).alias("end"), F.array(d["name"]).alias("names")))
    base = parsed.where("error is null").select("file_path", "content", "package_name", "imports", ranges.alias("_ranges"), T.lines(F.col("content")).alias("_lines")).withColumn("_n", F.size("_lines"))
    whole = (F.col("_n") <= s.chunk_small_threshold) | (F.size("_ranges") == 0)
    large = F.col("_n") > s.chunk_medium_threshold
    target = F.when(large, s.chunk_target_lines_large).otherwise(s.chunk_target_lines_medium)
    names = F.when(F.col("_n") <= s.chunk_small_threshold, F.flatten(F.transform("_ranges", lambda r: r["names"]))).otherwise(F.array().cast("array<string>"))
    one = F.array(F.struct(F.lit(1).alias("start"), F.col("_n").alias("end"), names.alias("names"), F.lit(False).alias("has_overlap")))
    merged = merge_greedy(F.col("_ranges"), target)
    plain = F.transform(merged, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["names"].alias("names"), F.lit(False).alias("has_overlap")))
    cut = F.when(large & (F.size(merged) > 1), add_overlap(merged, s.chunk_overlap_lines)).otherwise(plain)
    parts = base.withColumn("_whole", whole).withColumn("_parts", F.when(F.col("_whole"), one).otherwise(cut)).withColumn("total_chunks", F.size("_parts"))
    # outer: no file is without parts, and the filter that Spark puts before a plain explode would work all of them out again
    rows = parts.select("*", F.posexplode_outer("_parts").alias("chunk_index", "_r"))
    body = F.array_join(F.slice("_lines", F.greatest(F.col("_r.start"), F.lit(1)), F.greatest(F.col("_r.end") - F.col("_r.start") + 1, F.lit(0))), "\n")
    above = F.when(F.col("chunk_index") > 0, header(path, F.col("package_name"), F.col("imports"))).otherwise("")
    return rows.select(
        "file_path", F.when(F.col("_whole"), F.col("content")).otherwise(F.concat(above, body)).alias("content"), F.col("_r.start").alias("start_line"), F.col("_r.end").alias("end_line"),
        F.col("chunk_index").cast("int").alias("chunk_index"), "total_chunks", F.col("_r.names").alias("declarations"), F.coalesce("package_name", F.lit("")).alias("package_name"),
        paths.path_module(path).alias("path_module"), F.when(F.col("_whole"), "whole_file").otherwise("ast_chunk").alias("chunk_type"), roles.arch_role(path).alias("arch_role"), F.col("_r.has_overlap").alias("has_overlap"),
    )
