"""Filling fixed-capacity containers with related texts, by lexical retrieval packing.

1. Every text is encoded once. Document frequencies of all terms (at most the vocabulary) and the mean length are those of
   the whole corpus.
2. Texts are dealt to shards by what they say: sums of random signs of their terms, weighted by inverse frequency, are
   assigned to centroids (fitted on a bounded sample of SAMPLE texts, as many as there are shards, MAX_CENTROIDS at most); a centroid
   above SHARD_TOKENS is cut along a projection of its texts. So no source, id or group of copies makes a hot shard.
3. Each shard holds a BM25 inverted index of all terms of its items. The largest unused item opens a container and retrieves
   its unused neighbours, all of them, by all of its terms; they fill the window in order of relevance while they fit, the
   rest is filled with the largest unused items that still fit. Only items above the capacity are divided, into full
   windows and a remainder.

Common terms of a shard are scored by a dense product, the others by postings: the same scores, less work.

Defined results: texts without tokens (null, empty) take no space and come out with no container; repeated rows are
items of their own; every token of every text is in exactly one container; ties are broken by the order of row numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.llm.ann import chain, fit
from cairnmill.llm.bpe import _steps, default_vocabulary, encoder
from cairnmill.session import Scratch
from cairnmill.sources.tables import table

CAPACITY = 2048
#: Texts of a shard on average, and tokens that it holds at most (about; a shard is cut at quantiles).
SHARD_ROWS, SHARD_TOKENS = 4096, 4_000_000
#: Texts that fit the centroids, at most about this many; most centroids; dimensions of a sketch.
SAMPLE, MAX_CENTROIDS, DIM = 20_000, 1024, 32
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Terms in more than this share of a shard's items are scored densely.
DENSE = 1 / 8


class Statistics:
    """Inverse frequencies and mean length of the corpus, and the signs of terms."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1.0, tokens / max(1, n))
        self._signs: np.ndarray | None = None

    def sketches(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unit sums of the weighted signs of each text's tokens."""
        if self._signs is None:
            rng = np.random.default_rng(11)
            self._signs = (rng.integers(0, 2, (len(self.idf), DIM)) * 2 - 1).astype(np.float32) * self.idf[:, None]
        out = np.zeros((len(ends) - 1, DIM), np.float32)
        for a in range(0, len(out), 256):
            lo, hi = ends[a], ends[min(a + 256, len(out))]
            some = np.flatnonzero(np.diff(ends[a : a + 257]))
            if len(some):
                out[a + some] = np.add.reduceat(self._signs[ids[lo:hi]], ends[a + some] - lo, axis=0)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.maximum(norm, 1e-12)


class Index:
    """BM25 index of a shard's items, with the statistics of the corpus."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, stats: Statistics):
        self.n = n = len(ends) - 1
        lengths = np.diff(ends)
        item = np.repeat(np.arange(n), lengths)
        pairs, tf = np.unique(ids.astype(np.int64) * max(n, 1) + item, return_counts=True) if len(ids) else (np.empty(0, np.int64), np.empty(0, np.int64))
        term, owner = pairs // max(n, 1), pairs % max(n, 1)
        terms, first, df = np.unique(term, return_index=True, return_counts=True)
        which = np.repeat(np.arange(len(terms)), df)
        norm = K1 * (1 - B + B * lengths / stats.mean)
        weight = (stats.idf[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32) if len(term) else np.empty(0, np.float32)
        common = np.flatnonzero(df > max(16, DENSE * n))
        column = np.full(len(terms), -1)
        column[common] = np.arange(len(common))
        self.dense = np.zeros((n, len(common)), np.float32)
        held = column[which] >= 0 if len(which) else np.empty(0, bool)
        self.dense[owner[held], column[which[held]]] = weight[held]
        self.first, self.last, self.item, self.weight = first, first + df, owner, weight
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(n + 1))
        self.rare = [t[column[t] < 0] for t in (which[order[a:b]] for a, b in zip(starts[:-1], starts[1:]))]

    def scores(self, item: int) -> np.ndarray:
        """BM25 of every item for all terms of this one."""
        out = self.dense @ (self.dense[item] > 0).astype(np.float32)
        terms = self.rare[item]
        if len(terms):
            a, b = self.first[terms], self.last[terms]
            size = b - a
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out = out + np.bincount(self.item[at], self.weight[at], self.n)
        return out

    def neighbours(self, item: int, unused: np.ndarray) -> np.ndarray:
        """All unused items that share terms with this one, most similar first."""
        score = self.scores(item)
        score[~unused] = 0
        score[item] = 0
        near = np.flatnonzero(score > 0)
        return near[np.lexsort((near, -score[near]))]


def pack(sizes: np.ndarray, index: Index, capacity: int) -> list[list[int]]:
    """Containers of item numbers; sizes are between 1 and capacity."""
    unused = np.ones(len(sizes), bool)
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stacks.setdefault(int(sizes[i]), []).append(i)
    filled = sum(1 << s for s in stacks)  # the bits of sizes that still have items

    def largest(room: int) -> int | None:
        nonlocal filled
        while (fits := filled & ((1 << (room + 1)) - 1)) != 0:
            s = fits.bit_length() - 1
            stack = stacks[s]
            while stack and not unused[stack[-1]]:
                stack.pop()
            if stack:
                return stack[-1]
            filled &= ~(1 << s)
        return None

    out = []
    while (seed := largest(capacity)) is not None:
        held, room = [seed], capacity - int(sizes[seed])
        unused[seed] = False
        if room and largest(room) is not None:
            near = index.neighbours(seed, unused)
            while room and len(fits := np.flatnonzero(sizes[near] <= room)):  # on through all neighbours, in order, as they fit
                j = int(near[fits[0]])
                near = near[fits[0] + 1 :]
                held.append(j)
                unused[j] = False
                room -= int(sizes[j])
            while room and (j := largest(room)) is not None:
                held.append(j)
                unused[j] = False
                room -= int(sizes[j])
        out.append(held)
    return out


_OUT = "container_id bigint, place int, doc_id bigint, piece int, first_token bigint, n_tokens int, row bigint"


def _encoded(path: str, pattern: str):
    """(row, doc_id, n, ids): every text as packed ids; and a row with row null and the document frequencies, once a task."""
    wide = "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        df = np.zeros(max(enc.token_of.values()) + 1, np.int64)
        kind = "<u2" if len(df) <= 1 << 16 else wide
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
        for b in batches:
            texts = b.column(2).to_pylist()
            for s, e in _steps(texts):
                ids, ends = enc.encode(texts[s:e])
                owner = np.repeat(np.arange(e - s), np.diff(ends))
                df += np.bincount(np.unique(owner * len(df) + ids) % len(df), minlength=len(df))
                raw = ids.astype(kind).tobytes()
                size = np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.array(np.diff(ends), pa.int32()), pa.array([raw[x * size : y * size] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([df.astype("<i8").tobytes()], pa.binary())], schema=schema)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            one = np.frombuffer(x, "<i8")
            total = one.copy() if total is None else total + one
    if total is not None:
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])


def _unpacked(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = [x if isinstance(x, bytes) else bytes(x) for x in column]
    ids = np.frombuffer(b"".join(raw), kind).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]) // np.dtype(kind).itemsize


def packer(sent, kind: str, capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        docs, numbers = rows["doc_id"].astype("Int64").tolist(), rows["row"].tolist()
        ids, ends = _unpacked(rows["ids"], kind)
        owner, piece, first, size = [], [], [], []
        for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            for k, s in enumerate(range(a, b, capacity)):
                owner.append(d)
                piece.append(k)
                first.append(s - a)
                size.append(min(b, s + capacity) - s)
        sizes = np.array(size, np.int64)
        # items lie one after the other in ids, as documents do
        index = Index(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), sent.value)
        out = [(None, None, docs[d], 0, 0, 0, numbers[d]) for d in range(len(docs)) if ends[d] == ends[d + 1]]
        base = int(key[0]) << 44 | int(key[1]) << 24
        for c, held in enumerate(pack(sizes, index, capacity)):
            out += [(base + c, p, docs[owner[i]], piece[i], first[i], size[i], numbers[owner[i]]) for p, i in enumerate(held)]
        got = pd.DataFrame(out, columns=["container_id", "place", "doc_id", "piece", "first_token", "n_tokens", "row"])
        return got.astype({"container_id": "Int64", "place": "Int32", "doc_id": "Int64"})

    return run


class Packing:
    """Documents (doc_id, text) in shards by content; see packed() and relatedness()."""

    def __init__(self, documents: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, path: str | None = None, pattern: str | None = None, by_content: bool = True):
        default = default_vocabulary() if path is None or pattern is None else ("", "")
        path, pattern = path or default[0], pattern or default[1]
        spark, self.capacity = documents.sparkSession, capacity
        scratch = Scratch(spark)
        rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        every = scratch.keep(rows.mapInArrow(_encoded(path, pattern), "row bigint, doc_id bigint, n int, ids binary"), "encoded")
        self.encoded = encoded = every.filter("row is not null")
        size = max(encoder(path, pattern).token_of.values()) + 1
        self.kind = kind = "<u2" if size <= 1 << 16 else "<u4"
        totals = encoded.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        counted = every.filter("row is null").select("ids").mapInArrow(_counts, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most the vocabulary
        df = np.zeros(size, np.int64)
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        self.stats = stats = Statistics(df, totals["n"], totals["tokens"])
        self.sent = sent = spark.sparkContext.broadcast(stats)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = sent.value.sketches(*_unpacked(b.column(1).to_pylist(), kind))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["row", "sketch"])

        share = max(1, totals["n"] // SAMPLE)
        sample = encoded.filter((F.col("n") > 0) & (F.pmod(F.xxhash64("ids"), F.lit(share)) == 0)).select("row", "ids").limit(2 * SAMPLE)
        drawn = sample.mapInArrow(sketch, "row bigint, sketch binary").select("sketch").collect()
        x = np.frombuffer(b"".join(bytes(r[0]) for r in drawn), np.float32).reshape(-1, DIM) if drawn else np.zeros((1, DIM), np.float32)
        c = fit(x, int(min(MAX_CENTROIDS, max(1, totals["n"] // shard_rows), max(1, len(x) // 8))))
        c = c[np.argsort(chain(c))]
        axis = np.random.default_rng(5).normal(size=DIM).astype(np.float32)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = sent.value.sketches(*_unpacked(b.column(3).to_pylist(), kind))
                near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1) if by_content else b.column(0).to_numpy() * 2_654_435_761 % len(c)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(np.round((x @ axis).astype(np.float64), 4))], names=["row", "doc_id", "n", "ids", "centroid", "along"])

        dealt = encoded.mapInArrow(assign, "row bigint, doc_id bigint, n int, ids binary, centroid int, along double")
        self.encoded = dealt = scratch.keep(dealt, "dealt")
        scratch.drop("encoded")
        # a centroid with too many tokens or rows is cut where its texts along one axis reach equal shares
        load = dealt.groupBy("centroid").agg(F.greatest(F.ceil(F.sum("n") / SHARD_TOKENS), F.ceil(F.count("*") / (2 * shard_rows))).cast("int").alias("parts"))
        parts = {r["centroid"]: r["parts"] for r in load.collect()}  # at most MAX_CENTROIDS rows
        cut, most = [z for z, p in parts.items() if p > 1], max(parts.values(), default=1)
        at = dealt.filter(F.col("centroid").isin(cut)).join(load, "centroid") if cut else None
        edges = {} if at is None else {r["centroid"]: r["edges"] for r in at.groupBy("centroid").agg(F.max("parts").alias("parts"), F.percentile_approx("along", [k / (4 * most) for k in range(1, 4 * most)], 20 * most).alias("edges")).collect()}
        bounds = {z: np.array(e)[np.linspace(-1, 4 * most - 1, parts[z] + 1).astype(int)[1:-1]] for z, e in edges.items()}

        def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z, along = b.column(4).to_numpy(), b.column(5).to_numpy()
                part = np.zeros(len(z), np.int32)
                for k in np.unique(z):
                    if k in bounds:  # copies lie at one point of the axis; where that fills several shares, they are dealt by row
                        of = z == k
                        low, high = np.searchsorted(bounds[k], along[of]), np.searchsorted(bounds[k], along[of], "right")
                        part[of] = low + (b.column(0).to_numpy()[of] * 2_654_435_761 >> 7) % (high - low + 1)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(part)], names=["row", "doc_id", "n", "ids", "centroid", "part"])

        self.shards = dealt.mapInArrow(shard, "row bigint, doc_id bigint, n int, ids binary, centroid int, part int")

    def packed(self) -> DataFrame:
        """(container_id, place, doc_id, piece, first_token, n_tokens)."""
        return self._containers().drop("row")

    def _containers(self) -> DataFrame:
        return self.shards.groupBy("centroid", "part").applyInPandas(packer(self.sent, self.kind, self.capacity), _OUT)

    def relatedness(self) -> DataFrame:
        """One row (n_containers, within, at_random): mean cosine of sketches between two texts of one container, and between any two texts, which random dealing would give."""
        sent, kind = self.sent, self.kind

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = sent.value.sketches(*_unpacked(b.column(1).to_pylist(), kind))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float32()))], names=["row", "x"])

        x = self.encoded.filter("n > 0").select("row", "ids").mapInArrow(sketch, "row bigint, x array<float>")
        held = self._containers().filter("container_id is not null and piece = 0").select("container_id", "row").join(x, "row")
        sums = [F.sum(F.col("x")[i].cast("double")).alias(f"s{i}") for i in range(DIM)]
        length = lambda: sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(DIM)), F.lit(0.0))
        mean = lambda: (length() - F.col("m")) / (F.col("m") * (F.col("m") - 1))
        per = held.groupBy("container_id").agg(*sums, F.count("*").alias("m")).filter("m > 1").select("m", mean().alias("c"))
        within = per.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum(F.col("c") * F.col("m")) / F.sum("m"), F.lit(0.0)).alias("within"))
        every = x.agg(*sums, F.count("*").alias("m")).select(F.when(F.col("m") > 1, mean()).otherwise(F.lit(0.0)).alias("at_random"))
        return within.withColumn("_", F.lit(1)).join(every.withColumn("_", F.lit(1)), "_").drop("_")  # one row each


def packed(documents: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, path: str | None = None, pattern: str | None = None) -> DataFrame:
    return Packing(documents, capacity, shard_rows, path, pattern).packed()


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    per = packing(spark, folder).filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("items"))
    return per.agg(F.count("*").alias("n_containers"), F.sum("held").alias("n_tokens"), F.coalesce(F.sum("held") / (F.count("*") * CAPACITY), F.lit(1.0)).alias("fill"), F.max("held").alias("most"), F.max("items").alias("most_items"))


def relatedness(spark: SparkSession, folder: str) -> DataFrame:
    return Packing(table(spark, folder, "documents")).relatedness()
