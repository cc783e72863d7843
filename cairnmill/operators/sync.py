"""Incremental ingestion: what changed between the files on disk and the recorded states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(file_path, status, content_hash): new, changed, unchanged or deleted. Both sides have each path once."""
    both = disk.select("file_path", F.col("content_hash").alias("now"), F.lit(True).alias("_d")).join(known.select("file_path", F.col("content_hash").alias("before"), F.lit(True).alias("_k")), "file_path", "full_outer")
    status = F.when(F.col("_d").isNull(), "deleted").when(F.col("_k").isNull(), "new").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("changed")
    return both.select("file_path", status.alias("status"), F.coalesce("now", "before").alias("content_hash"))


def summary(changes: DataFrame) -> DataFrame:
    """One row of counts."""
    is_ = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0))
    return changes.agg(is_("unchanged").alias("unchanged"), (is_("changed") + is_("new")).alias("changed"), is_("deleted").alias("deleted"))
