"""A versioned table store: immutable buckets of files and numbered manifests, of which the newest holds.

Tables are cut into BUCKETS by a hash of the path. A change writes the buckets
that it touches beside the old ones, then a manifest that names the bucket
directories of all tables under the next number, by one rename to a name that
does not exist yet. Readers see one manifest or the next, never a mixture; a write
that fails before the rename leaves all as it was, and of two writers one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.modules import distinct_modules

TABLES = {"chunks": schemas.CHUNKS, "registry": schemas.REGISTRY, "parsed": schemas.PARSED}


#: Parts of a table that a change replaces one by one.
BUCKETS = 64


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(n)).cast("int")


class Files:
    """Small files by any Hadoop path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root if "://" in root else "file://" + root
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        p = self.path(name)
        fs = p.getFileSystem(self.conf)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        fs = p.getFileSystem(self.conf)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all; an error if there is one of that name."""
        new, place = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(name)
        fs = place.getFileSystem(self.conf)
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(place) or not fs.rename(new, place):
            fs.delete(new, False)
            raise FileExistsError(f"{name} was written by another process")

    def replace(self, name: str, text: str) -> None:
        """A file of which only the newest state matters (a reader may find none while it is replaced)."""
        new, old = self.path(name + ".new"), self.path(name)
        fs = old.getFileSystem(self.conf)
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not fs.rename(new, old):  # some file systems do not replace by a rename
            fs.delete(old, False)
            fs.rename(new, old)

    def delete(self, name: str) -> None:
        p = self.path(name)
        p.getFileSystem(self.conf).delete(p, True)


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2, buckets: int = BUCKETS):
        self.spark, self.files, self.keep, self.buckets = spark, Files(spark, root), keep, buckets

    def manifest(self) -> dict:
        """number, version, commit, dirty and failed (paths), tables (name to bucket to directory) of the newest manifest
        that can be read; what a store without one stands for."""
        for name in reversed([n for n in self.files.names("manifests") if n.endswith(".json")]):
            try:
                found = json.loads(self.files.read(f"manifests/{name}") or "")
            except ValueError:
                continue
            return found
        return {"number": 0, "version": 0, "commit": None, "dirty": [], "failed": [], "buckets": self.buckets, "tables": {n: {} for n in TABLES}}

    def mark(self, **marks) -> None:
        """The same tables with other marks."""
        self._publish(self.manifest() | marks)

    def _publish(self, new: dict) -> None:
        new["number"] += 1
        self.files.create(f"manifests/{new['number']:012d}.json", json.dumps(new, indent=1))

    def _paths(self, manifest: dict, name: str, buckets: list[int] | None = None) -> list[str]:
        found = manifest["tables"][name]
        return [f"{self.files.root}/{d}" for b, d in sorted(found.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets; empty before the first version."""
        places = self._paths(self.manifest(), name, buckets)
        return self.spark.read.schema(TABLES[name]).parquet(*places) if places else self.spark.createDataFrame([], TABLES[name])

    def commit(self, tables: dict[str, DataFrame], **marks) -> int:
        """The next version, with these tables in place of the current ones."""
        return self._write(tables, None, None, marks)

    def change(self, new: dict[str, DataFrame], touched: DataFrame, **marks) -> int:
        """The next version: of every table the rows of touched (file_path) go and those of new come. Only the buckets
        that hold touched paths are written."""
        n = self.manifest()["buckets"]
        places = touched.select(_bucket(n).alias("b")).distinct().collect()  # at most n numbers
        return self._write(new, touched.select("file_path").distinct(), sorted(r.b for r in places), marks)

    def _write(self, new: dict[str, DataFrame], touched: DataFrame | None, buckets: list[int] | None, marks: dict) -> int:
        now = self.manifest()
        version, n = now["version"] + 1, now["buckets"]
        tables = {name: dict(now["tables"][name]) for name in TABLES}
        for name, rows in new.items():
            columns = StructType.fromDDL(TABLES[name]).fieldNames()
            rows = rows.select(*columns)
            if touched is not None:
                rows = self.read(name, buckets).select(*columns).join(touched, "file_path", "left_anti").select(*columns).unionByName(rows)
            place = f"data/{name}/v={version}-{uuid.uuid4().hex[:8]}"
            # a bucket is one task's work, whichever tasks its rows come from
            rows.withColumn("b", _bucket(n)).repartition("b").write.partitionBy("b").parquet(f"{self.files.root}/{place}")
            written = {d[2:]: f"{place}/{d}" for d in self.files.names(place) if d.startswith("b=")}
            kept = {} if buckets is None else {b: d for b, d in tables[name].items() if int(b) not in buckets}
            tables[name] = kept | written
        self._publish(now | marks | {"version": version, "tables": tables})
        self._forget()
        return version

    def _forget(self) -> None:
        """Removes manifests older than the last `keep`, and what only they name."""
        found = [n for n in self.files.names("manifests") if n.endswith(".json")]
        if len(found) <= self.keep:
            return
        live = set()
        for name in found[-self.keep :]:
            for table in json.loads(self.files.read(f"manifests/{name}"))["tables"].values():
                live |= {d.rsplit("/", 1)[0] for d in table.values()}
        for name in TABLES:
            for place in self.files.names(f"data/{name}"):
                if f"data/{name}/{place}" not in live:
                    self.files.delete(f"data/{name}/{place}")
        for name in found[: -self.keep]:
            self.files.delete(f"manifests/{name}")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def modules(self) -> DataFrame:
        return distinct_modules(self.read("registry"))

    def module_files(self, module: str) -> DataFrame:
        return self.read("registry").where(F.col("build_module") == F.lit(module)).select("file_path")

