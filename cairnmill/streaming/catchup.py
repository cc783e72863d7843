"""A folder of Markdown as a stream: micro-batches of files go through the same catch-up as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """New and changed *.md files below root; deletions aren't seen by a stream, a batch run finds them."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", per_batch).load(root)
    return stream.select(F.regexp_replace("path", r"^file:/*(?=/)", "").alias("file_path"), F.decode("content", "UTF-8").alias("content"))


def catch_up(spark: SparkSession, root: str, checkpoint: str, apply: Callable[[DataFrame], None]) -> StreamingQuery:
    """Runs apply on each micro-batch until what is there has been read. A batch that fails is read again."""

    def batch(df: DataFrame, _: int) -> None:
        apply(df)

    return files(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
