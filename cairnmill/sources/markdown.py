"""Markdown files under a folder, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of this name hold an index's own state and are skipped.
STATE_FOLDER = ".cairnmill"


def read(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """(file_path, content) of every file named *.md below root, links followed, state folders left out.

    Names that begin with _ or a dot, of files and folders, are left out by Spark's file index. Paths keep their scheme unless it is file:.

    Strict: a file that isn't UTF-8 fails the read; otherwise it is left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    path = F.regexp_replace("path", r"^file:/*(?=/)", "")
    kept = files.select(path.alias("file_path"), "content").filter(~F.array_contains(F.split("file_path", "/"), STATE_FOLDER))
    text = F.decode("content", "UTF-8") if strict else F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    out = kept.select("file_path", text.alias("content"))
    return out if strict else out.filter("content is not null")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """The paths in order, folder by folder."""
    return read(spark, root, strict=False).select("file_path").orderBy(F.split("file_path", "/"))
