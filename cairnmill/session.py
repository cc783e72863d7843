"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, name: str = "cairnmill") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset (tests), a temporary one."""
    conf = spark.sparkContext.getConf()
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("cairnmill.scratch", None) or (given.get() if given.isDefined() else None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairnmill-")
        spark.conf.set("cairnmill.scratch", base)
        _made.append((spark, base))
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, base in _made:
        try:
            remove(spark, base)
        except Exception:  # the session may be gone already
            pass


atexit.register(_clean)


class Scratch:
    """Tables written to the shared folder to cut lineage. Each survives the loss of executors.

    keep() writes a table and reads it back; a name written again replaces the table before it, once
    the new one is complete. Files of the last version of each name stay until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/cairnmill-{uuid.uuid4().hex}"
        self.now: dict[str, str] = {}
        _made.append((spark, self.base))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep_counting(df, name)[0]

    def keep_counting(self, df: DataFrame, name: str, count: Column | None = None) -> tuple[DataFrame, int]:
        """Also an aggregate of whole numbers, observed while writing."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        if count is None:
            df.write.parquet(path)
            n = 0
        else:
            seen = Observation()
            df.observe(seen, count.alias("n")).write.parquet(path)
            n = seen.get["n"] or 0
        if name in self.now:
            remove(self.spark, self.now[name])
        self.now[name] = path
        return self.spark.read.schema(df.schema).parquet(path), n

    def drop(self, name: str) -> None:
        if name in self.now:
            remove(self.spark, self.now.pop(name))
