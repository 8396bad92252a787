"""Source trees as a table: a Python data source, the parse table function and build modules.

Spark's own file listing leaves out names that start with `_` or `.` and cannot
prune directories by name, so the tree has a reader of its own. Paths are listed
on the driver (names only); contents are read by the tasks, which must see the
tree under the same path.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import paths, text

# Directories that are never entered.
PRUNED = frozenset([".git", ".gradle", ".idea", "build", "node_modules", "Pods", "DerivedData", ".mcp-context", "__pycache__", ".build", "Carthage"])
# Extensions by language.
EXTENSIONS = {"kotlin": [".kt", ".kts"], "swift": [".swift"]}
#: Levels of the tree in which build files are looked for.
BUILD_DEPTH = 5


def walk(root: str, extensions: list[str] | None = None) -> Iterator[str]:
    """Relative paths of files below root, pruned and sorted."""
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in PRUNED)
        for n in sorted(names):
            if extensions is None or os.path.splitext(n)[1] in extensions:
                yield os.path.relpath(os.path.join(top, n), root).replace(os.sep, "/")


class Part(InputPartition):
    def __init__(self, found: list[str]):
        super().__init__(None)
        self.found = found


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = options.get("extensions", "").split(",") if options.get("extensions") else None
        self.only = json.loads(options["only"]) if options.get("only") else None
        self.names_only = options.get("namesonly", "") == "true"
        self.per_part = int(options.get("filesperpartition", 256))

    def partitions(self) -> list[Part]:
        # known paths are looked at one by one; only an unknown tree is walked
        found = list(walk(self.root, self.extensions)) if self.only is None else sorted(p for p in set(self.only) if self._there(p))
        return [Part(found[k : k + self.per_part]) for k in range(0, len(found), self.per_part)] or [Part([])]

    def _there(self, p: str) -> bool:
        parts = p.split("/")
        known = self.extensions is None or os.path.splitext(parts[-1])[1] in self.extensions
        return known and ".." not in parts and PRUNED.isdisjoint(parts[:-1]) and os.path.isfile(os.path.join(self.root, p))

    def read(self, part: Part):
        for p in part.found:
            if self.names_only:
                yield p, None, None
                continue
            try:
                with open(os.path.join(self.root, p), "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            yield p, raw, raw.decode("utf-8", "replace")


class TreeSource(DataSource):
    """spark.read.format("source_tree").option("extensions", ".kt,.kts").load(root)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return schemas.FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, only: list[str] | None = None, per_part: int = 256, names_only: bool = False) -> DataFrame:
    """files (file_path, content_bytes, content); only: relative paths to read, when they are known. names_only: no contents."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("extensions", ",".join(extensions or [])).option("filesPerPartition", per_part).option("namesOnly", str(names_only).lower())
    if only is not None:
        reader = reader.option("only", json.dumps(sorted(only)))
    return reader.load(root)


def with_hash(files: DataFrame) -> DataFrame:
    """files with the SHA-256 of their bytes and their number of lines."""
    return files.withColumn("content_hash", F.sha2("content_bytes", 256)).withColumn("line_count", text.line_count(F.col("content")))


def parse(files: DataFrame) -> DataFrame:
    """One row per file of a known language; a file that cannot be parsed has its error and no declarations."""
    schema = StructType.fromDDL(schemas.PARSED)
    names = [f.name for f in schema]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        from ..lang import kotlin, swift

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                language = swift if path.endswith(".swift") else kotlin
                content = content or ""
                try:
                    package, imports, declarations = language.parse(content)
                    error = None
                except Exception as e:  # one bad file must not end the job; it is reported and tried again
                    package, imports, declarations, error = None, [], [], f"{type(e).__name__}: {e}"
                rows.append(dict(zip(names, (path, content, package, content.count("\n") + 1, error, imports, declarations))))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ext = paths.extension(F.col("file_path"))
    known = files.where(ext.isin([e for x in EXTENSIONS.values() for e in x]))
    return known.select("file_path", "content").mapInArrow(run, schema)


def declarations(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.inline("declarations"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.inline("imports"))


def listing(spark: SparkSession, root: str, depth: int = BUILD_DEPTH) -> DataFrame:
    """(path, is_dir) of entries in directories down to `depth` levels below root, pruned."""
    rows = []
    for top, dirs, names in os.walk(root):
        rel = os.path.relpath(top, root)
        level = 0 if rel == "." else rel.count(os.sep) + 1
        dirs[:] = sorted(d for d in dirs if d not in PRUNED)
        base = "" if rel == "." else rel.replace(os.sep, "/") + "/"
        rows += [(base + d, True) for d in dirs] + [(base + n, False) for n in sorted(names)]
        if level >= depth:
            dirs[:] = []
    return spark.createDataFrame(rows, "path string, is_dir boolean")


def build_modules(entries: DataFrame) -> DataFrame:
    """modules (name, path, build_file, is_feature): a row per Gradle build file."""
    p = F.col("path")
    folder = paths.directory(p)
    found = entries.where(~F.col("is_dir") & paths.base_name(p).isin("build.gradle", "build.gradle.kts"))
    return found.select(F.when(folder == "", "root").otherwise(paths.base_name(folder)).alias("name"), folder.alias("path"), paths.base_name(p).alias("build_file"), F.lower(folder).contains("feature").alias("is_feature"))


def platform(entries: DataFrame) -> DataFrame:
    """One row: type (android, ios, multi or unknown), languages, extensions."""
    name = paths.base_name(F.col("path"))
    gradle = name.isin("build.gradle", "build.gradle.kts") & ~F.col("is_dir")
    apple = name.endswith(".xcodeproj") | name.endswith(".xcworkspace") | ((name == "Package.swift") & ~F.col("is_dir"))
    seen = entries.agg(F.coalesce(F.bool_or(gradle), F.lit(False)).alias("g"), F.coalesce(F.bool_or(apple), F.lit(False)).alias("a"))
    g, a = F.col("g"), F.col("a")
    words = lambda *x: F.array(*[F.lit(v) for v in x])
    kind = F.when(g & a, "multi").when(g, "android").when(a, "ios").otherwise("unknown")
    languages = F.when(g & a, words("kotlin", "swift")).when(g, words("kotlin")).when(a, words("swift")).otherwise(F.array().cast("array<string>"))
    extensions = F.when(g & a, words(".kt", ".kts", ".swift")).when(g, words(".kt", ".kts")).when(a, words(".swift")).otherwise(words(".kt", ".kts", ".swift"))
    return seen.select(kind.alias("type"), languages.alias("languages"), extensions.alias("extensions"))


def nearest_module(files: DataFrame, module_paths: DataFrame, path: str = "file_path", out: str = "build_module") -> DataFrame:
    """files with the nearest ancestor directory in module_paths (path), '' if there is none: a longest-prefix
    join as an equi-join on ancestors."""
    above = files.select(path, F.posexplode(paths.ancestors(F.col(path))).alias("_pos", "_dir"))
    known = module_paths.select(F.col("path").alias("_dir")).where("_dir <> ''").distinct()
    best = above.join(known, "_dir").groupBy(path).agg(F.min_by("_dir", "_pos").alias(out))
    return files.join(best, path, "left").withColumn(out, F.coalesce(out, F.lit("")))


def gradle_dependencies(content: Column) -> Column:
    """array<string> of `configuration: target` of a build file."""
    pattern = r"(implementation|api)\s*\(?(?:project\()?[\"':](.*?)[\"']"
    pairs = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("b"))
    return F.transform(pairs, lambda x: F.concat(x["a"], F.lit(": "), x["b"]))
