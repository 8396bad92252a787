"""Differences between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, stored: DataFrame, key: str = "file_path", value: str = "content_hash") -> DataFrame:
    """(key, op): add, update, remove or keep, by one full outer join on the key."""
    a = current.select(key, F.col(value).alias("_new"), F.lit(True).alias("_now"))
    b = stored.select(key, F.col(value).alias("_old"), F.lit(True).alias("_then"))
    op = F.when(F.col("_then").isNull(), "add").when(F.col("_now").isNull(), "remove").when(~F.col("_new").eqNullSafe(F.col("_old")), "update").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, op.alias("op"))
