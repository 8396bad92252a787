"""Folders that driver and executors share, and what every operator needs of the session."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bounds of one Arrow batch, so that long documents cannot fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one on a local master (tests), and an
    error elsewhere: machines of a cluster would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="srcatlas-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read back with its schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def prepared(spark: SparkSession) -> None:
    """Bounds Arrow batches, where the session sets no bounds of its own, and lets executors import this package where
    PYTHONPATH does not name it. Frames run later than they are built, so the bounds stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_srcatlas_sent", False):
        return
    sc._srcatlas_sent = True
    out = os.path.join(tempfile.mkdtemp(prefix="srcatlas-zip-"), "srcatlas_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "srcatlas")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)


def opened_folder(path: str):
    """(file system, path in it) of a folder that a task writes or reads files in by itself; it is there afterwards."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path)
    system.create_dir(base, recursive=True)
    return system, base


def trim() -> None:
    """Gives memory that a Python worker has freed back to the machine."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def mapped(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow, with the worker's freed memory given back every few batches and at the end."""

    def frugal(batches):
        for k, out in enumerate(run(batches)):
            yield out
            if k % 16 == 15:
                trim()
        trim()

    return df.mapInArrow(frugal, schema)


#: A key with more than this share of the rows is hot (so there are at most 1 / HOT of them); salts of a hot key.
HOT, SALTS = 1 / 512, 64


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The hot keys of counts (key, n): at most 1 / HOT rows, so they can be broadcast."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.where(F.col(n) > max(total * HOT, SALTS)).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right (a row per key) on the key, where the rows of hot keys are dealt to SALTS tasks each."""
    marks = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS))).otherwise(0).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(marks, key, "left").withColumn("_salt", spread).drop("_hot")
    b = right.join(marks, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def typed(df: DataFrame, keep: tuple[str, ...], more: str) -> StructType:
    """The schema of df's columns `keep` followed by those of a DDL string."""
    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(more).fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
