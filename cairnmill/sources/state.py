"""A project's tables: bucketed Parquet versions under one numbered manifest.

Every table is cut into buckets by a hash of its key. A commit writes only the buckets that change, of all tables
together, and becomes current when a manifest with the next number is renamed into place; the greatest number counts. So a
reader sees all tables of one commit, a crash at any point leaves the commit before, and a second writer of the same
number fails instead of overwriting. The manifest pins the dimension of embeddings.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnmill import schemas
from cairnmill.operators.registry import delete_where, upsert

#: Buckets of each table, fixed when a project's first commit is made.
BUCKETS = 64


class DimensionMismatch(ValueError):
    """The store holds vectors of another dimension."""


class Conflict(RuntimeError):
    """Another writer committed meanwhile, or the commit couldn't be put in place; nothing of this commit is visible."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        return sorted(int(m[1]) for f in fs.listStatus(p) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName())))

    def _load(self, number: int) -> dict:
        fs, p = self._fs(f"{self.root}/manifest-{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The current manifest: number, facts, buckets, and for each table the folder of each bucket."""
        n = self._numbers()
        return self._load(n[-1]) if n else {"number": 0, "facts": {}, "buckets": self._buckets, "tables": {}}

    def bucket(self, key: str, now: dict | None = None):
        return F.pmod(F.xxhash64(key), F.lit((now or self.manifest())["buckets"])).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets that hold the keys of rows; at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(key).alias("b")).distinct().collect())

    def read(self, name: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """The current rows, of some buckets only if asked; no rows if there are none."""
        at = self.manifest()["tables"].get(name, {})
        paths = [f"{self.root}/{path}" for b, path in sorted(at.items()) if path and (buckets is None or int(b) in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, name: str, rows: DataFrame, key: str, buckets: list[int] | None = None) -> dict[str, dict[str, str | None]]:
        """Writes the new rows of the given buckets (all if None) beside the current ones; they count once committed."""
        now = self.manifest()
        version = f"{name}/v-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket(key, now)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{version}")
        fs, p = self._fs(f"{self.root}/{version}")
        have = {m[1] for f in fs.listStatus(p) if (m := re.fullmatch(r"_bucket=(\d+)", f.getPath().getName()))}
        every = [str(b) for b in (range(now["buckets"]) if buckets is None else buckets)]
        if not have <= set(every):
            raise ValueError(f"{name}: rows outside of the buckets that are replaced")
        return {name: {b: f"{version}/_bucket={b}" if b in have else None for b in every}}

    def commit(self, *staged: dict[str, dict[str, str | None]], **facts) -> None:
        """Makes staged buckets of any tables current, all at once."""
        old = self.manifest()
        new = {"number": old["number"] + 1, "facts": old["facts"] | facts, "buckets": old["buckets"], "tables": {k: dict(v) for k, v in old["tables"].items()}}
        for tables in staged:
            for name, at in tables.items():
                new["tables"].setdefault(name, {}).update(at)
        fs, temporary = self._fs(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(json.dumps(new).encode())
        out.close()
        _, target = self._fs(f"{self.root}/manifest-{new['number']:012d}.json")
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise Conflict(f"commit {new['number']} of {self.root} was made by another writer or couldn't be renamed")
        self._clean(old, new)

    def _clean(self, old: dict, new: dict) -> None:
        """Folders that only commits before the last one refer to; the last one stays for readers that began with it."""
        used = {p for m in (old, new) for t in m["tables"].values() for p in t.values() if p}
        for n in self._numbers():
            if n < old["number"]:
                for t in self._load(n)["tables"].values():
                    for p in t.values():
                        if p and p not in used:
                            fs, path = self._fs(f"{self.root}/{p}")
                            fs.delete(path, True)
                fs, path = self._fs(f"{self.root}/manifest-{n:012d}.json")
                fs.delete(path, False)


class ChunkStore:
    """Chunks with embeddings of one pinned dimension. A chunk's id is derived from its file, so a file's chunks lie in one bucket."""

    NAME = "chunks"

    def __init__(self, snapshots: Snapshots):
        self.snapshots = snapshots

    def dimension(self) -> int | None:
        return self.snapshots.manifest()["facts"].get("dimension")

    def ensure(self, dimension: int) -> None:
        have = self.dimension()
        if have is None:
            self.snapshots.commit(dimension=dimension)
        elif have != dimension:
            raise DimensionMismatch(f"the store holds vectors of dimension {have}, not {dimension}")

    def read(self) -> DataFrame:
        return self.snapshots.read(self.NAME, schemas.CHUNK)

    def stage(self, new: DataFrame | None = None, gone_files: DataFrame | None = None) -> dict:
        """Deletes the chunks of gone files (file_path) and puts new chunks in; only the buckets of those files are written. new has each id once."""
        files = [x.select("file_path") for x in (new, gone_files) if x is not None]
        buckets = self.snapshots.touched(files[0] if len(files) == 1 else files[0].union(files[1]), "file_path") if files else []
        rows = self.snapshots.read(self.NAME, schemas.CHUNK, buckets)
        if gone_files is not None:
            rows = delete_where(rows, gone_files, ["file_path"])
        if new is not None:
            dim = self.dimension()
            ok = F.col("embedding").isNull() | (F.size("embedding") == dim)
            checked = F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding isn't of dimension {dim}")).cast("array<float>"))
            rows = upsert(rows, new.withColumn("embedding", checked).select(*rows.columns), ["id"])
        return self.snapshots.stage(self.NAME, rows, "file_path", buckets)

    def replace(self, new: DataFrame | None = None, gone_files: DataFrame | None = None) -> None:
        self.snapshots.commit(self.stage(new, gone_files))

    def count(self) -> int:
        return self.read().count()
