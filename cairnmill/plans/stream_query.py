"""The streaming catch-up over documents written as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.functions.text import content_hash
from cairnmill.operators import chunking, sync
from cairnmill.session import Scratch
from cairnmill.sources.tables import table

#: Documents updated before are the known ones.
STREAM_KNOWN = "2025-01-01 00:00:00"


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Documents arrive as a stream of Parquet files; every micro-batch is chunked and the states of its files are recorded.

    What the stream recorded is compared with earlier states (documents before STREAM_KNOWN, the first of each path): files
    that came to be, changed, stayed, or gave no chunk any more. The batch number names its output folder, so a batch that
    is run again replaces its own output (exactly once).
    """
    s = Scratch(spark)
    d = table(spark, folder, "documents").filter("file_path is not null")
    docs = d.groupBy("file_path").agg(F.max_by("text", "doc_id").alias("content"))
    s.keep(docs.repartition(4), "files")
    out = f"{s.base}/states"

    def apply(df: DataFrame, batch: int) -> None:
        chunks = chunking.chunk(df, "file_path", "content", 256).groupBy("file_path").agg(F.count("*").alias("n_chunks"))
        states = df.select("file_path", content_hash(F.col("content")).alias("content_hash"))
        states.join(chunks, "file_path").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(s.now["files"])
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{s.base}/stream").trigger(availableNow=True).start().awaitTermination()
    now = spark.read.schema("file_path string, content_hash string, n_chunks bigint").option("recursiveFileLookup", "true").parquet(out)
    before = d.filter(F.col("updated_at") < F.lit(STREAM_KNOWN).cast("timestamp_ntz")).groupBy("file_path").agg(F.min_by("text", "doc_id").alias("content")).select("file_path", content_hash(F.col("content")).alias("content_hash"))
    return sync.diff(now, before).groupBy("status").agg(F.count("*").alias("n_files"))
