"""Incremental upkeep as a stream: tables of changed paths drive the index.

The store's registry is the keyed state; a micro-batch of paths becomes one
refresh of these paths, so late and repeated notices are harmless (a file whose
hash is as stored is kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index

NOTICES = "file_path string, ts timestamp"


def notices(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines (file_path, ts) dropped into a folder."""
    return spark.readStream.schema(NOTICES).json(folder)


def keep_fresh(index: Index, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Refreshes the paths of every micro-batch that is there, then stops. No notice is too late: there is no watermark,
    and a micro-batch's paths are made distinct."""

    def run(batch: DataFrame, _: int) -> None:
        names = [r.file_path for r in batch.select("file_path").distinct().collect()]
        if names:
            index.refresh(sorted(names))

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_rates(changes: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window, root, n): notices per top-level directory and event-time window."""
    root = F.substring_index("file_path", "/", 1)
    return changes.withWatermark("ts", delay).groupBy(F.window("ts", window), root.alias("root")).agg(F.count("*").alias("n"))
