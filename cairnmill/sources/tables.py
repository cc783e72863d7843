"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.functions.ids import epoch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def live_ids(rows: DataFrame) -> DataFrame:
    """id of every live id: its current row (greatest updated_at as a number) has no deleted_at. Null ids are left out.

    Two numeric maxima instead of a sort or a struct: rows with the greatest time are identical copies,
    so an id is live when the latest undeleted time equals the latest time. Aggregated before the shuffle.
    """
    at = epoch(F.col("updated_at"))
    return (
        rows.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(at).alias("_all"), F.max(F.when(F.col("deleted_at").isNull(), at)).alias("_live"))
        .filter(F.col("_all") == F.col("_live"))
        .select("id")
    )


def current_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """id and the named columns of the current row of every live id."""
    picked = F.struct(
        epoch(F.col("updated_at")).alias("_at"),
        F.col("deleted_at").isNull().alias("_live"),
        *[F.col(c) for c in columns],
    )
    return (
        rows.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(picked, epoch(F.col("updated_at"))).alias("_r"))
        .filter("_r._live")
        .select("id", *[F.col(f"_r.{c}").alias(c) for c in columns])
    )
