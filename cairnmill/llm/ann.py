"""The k most similar vectors of every vector, by an inverted multi-index.

The two halves of each unit vector are quantised separately; a cell is a pair of centroids. For each query, cells are
taken in the order of the summed distances of their two centroids, from a heap that starts at the nearest pair, until
they hold enough vectors; all vectors of those cells are compared.

How many are enough isn't fixed but measured: CALIBRATE queries are compared with every entry, and the traversal
goes as far as RECALL of their true neighbours lie, times MARGIN. So the searched share follows the data at every size;
recall() measures the result against brute force, and exact=True compares everything with everything. Where only neighbours of
at least some similarity are wanted, CALIBRATE_LEAST queries are compared, and the traversal takes every cell as near as those
of all their wanted neighbours (in distance beyond the nearest pair of centroids), times MARGIN; if they have fewer than ENOUGH
of those, it goes as far as for all neighbours.

The number of centroids grows with the root of the entries up to MAX_CENTROIDS a half, which bounds what is sent to the
workers (three numbers a cell). Exact copies (equal unit vectors) are one entry of the index with all their rows as
members, so no group of copies is compared with itself. Neighbouring cells are packed into blocks by the number of entries
for each core, BLOCK_ROWS at most (a cell above that is cut into several); a query goes once to each block that holds
any of its cells, and the queries of a block are dealt to tasks by load, each task in a partition of its own. Only the distance
that its traversal ended at goes with a query, not its cells. A task holds its block; queries pass by in slices, of which neither
the cells (PROBES) nor the similar entries (KEPT) exceed a number, however deep the traversal is.

Bounded, documented samples: SAMPLE vectors fit the centroids, CALIBRATE queries set the depth. All vectors are indexed and queried.

Defined results: only vectors of `dim` finite values that aren't all zero take part; equal similarities are
ordered by id; a row is never its own neighbour; with fewer than k others, all of them come out; empty tables give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnmill.session import Scratch
from cairnmill.sources.tables import current_rows, table

DIM, K = 96, 10
#: Vectors that fit the centroids of both halves, at most about this many, chosen by hash.
SAMPLE = 20_000
#: Mean entries of a cell, up to MAX_CENTROIDS centroids a half (so there are at most MAX_CENTROIDS^2 cells).
CELL_ROWS, MAX_CENTROIDS = 64, 2048
BLOCK_ROWS, QUERY_ROWS = 64_000, 32_000
#: Queries that pass by a block in one task (about).
TASK_ROWS = 512_000
#: Regions that cells are packed by.
COARSE = 256
#: Queries, at most about this many, whose true neighbours set how far every traversal goes: as far as RECALL of them, times MARGIN.
CALIBRATE, RECALL, MARGIN = 512, 0.99, 1.5
#: The same where only some neighbours are wanted: queries, and wanted neighbours of theirs that are enough to go by.
CALIBRATE_LEAST, ENOUGH = 4096, 50
#: Pairs of a query and a cell, and of a query and a similar entry, that a task holds at once (about).
PROBES, KEPT = 500_000, 1_000_000
#: Cells a query from which all cells are sorted instead of taken from a heap; cells of traversals that blocks are planned by.
DEEP, PLANNED = 400, 4_000_000
#: Members whose greatest similarity is taken together for a query's bar.
GROUP = 64


def unit_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vec): unit vectors as dim little-endian floats; rows that can't take part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ok = (np.diff(ends) == dim) & (nulls[ends[1:]] == nulls[ends[:-1]])
            at = np.flatnonzero(ok)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False)[ends[at][:, None] + np.arange(dim)].astype(np.float64)
            good = np.isfinite(x).all(axis=1)
            at, x = at[good], x[good]
            x /= np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
            norm = np.sqrt((x * x).sum(axis=1))
            at, x = at[norm > 0], (x[norm > 0] / norm[norm > 0][:, None]).astype("<f4") + np.float32(0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "vec"])

    return rows.select(F.col(key).alias("key"), F.col(vector)).mapInArrow(run, "key string, vec binary")


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, dim)


def fit(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; an emptied centroid moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32).copy()
    for _ in range(rounds):
        d = (c * c).sum(axis=1) - 2 * x @ c.T
        near = d.argmin(axis=1)
        counts = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, near, x)
        c = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], c).astype(np.float32)
        for j in np.flatnonzero(counts == 0):
            far = int(d[np.arange(len(x)), near].argmax())
            c[j], d[far] = x[far], -np.inf
    return c


def chain(c: np.ndarray) -> np.ndarray:
    """Centroids in a greedy chain of nearest neighbours, so that neighbours in space are near in order."""
    left, out = set(range(1, len(c))), [0]
    while left:
        rest = np.fromiter(left, np.int64)
        nxt = int(rest[((c[rest] - c[out[-1]]) ** 2).sum(axis=1).argmin()])
        out.append(nxt)
        left.remove(nxt)
    place = np.empty(len(c), np.int64)
    place[out] = np.arange(len(c))
    return place


class MultiIndex:
    """Centroids of both halves, cell counts and the blocks that cells are packed into. Small; sent to the workers."""

    def __init__(self, sample: np.ndarray, n: int):
        self.dim, self.half = sample.shape[1], sample.shape[1] // 2
        k = int(min(MAX_CENTROIDS, max(1, len(sample) // 8), max(2, round((n / CELL_ROWS) ** 0.5))))
        self.one, self.two = fit(sample[:, : self.half], k), fit(sample[:, self.half :], k)
        self.k = len(self.two)
        coarse = fit(sample, min(COARSE, max(1, len(sample) // 16)))
        self.coarse = coarse[np.argsort(chain(coarse))]

    def regions(self, cells: np.ndarray) -> np.ndarray:
        """The coarse centroid of whole vectors that is nearest to each cell's pair of centroids, numbered along their chain."""
        out, c = np.empty(len(cells), np.int64), (self.coarse * self.coarse).sum(axis=1)
        for s in range(0, len(cells), 100_000):
            at = cells[s : s + 100_000]
            pair = np.concatenate([self.one[at // self.k], self.two[at % self.k]], axis=1)
            out[s : s + len(at)] = (c - 2 * pair @ self.coarse.T).argmin(axis=1)
        return out

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = x[:, : self.half], x[:, self.half :]
        return (self.one * self.one).sum(axis=1) - 2 * a @ self.one.T, (self.two * self.two).sum(axis=1) - 2 * b @ self.two.T

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def count(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.counts = np.zeros(len(self.one) * self.k, np.int32)
        self.counts[cells] = counts
        self.order = None

    def pack(self, block_rows: int) -> None:
        """Cells to blocks of about block_rows entries, region by region; `first` is a cell's first block, `parts` its number of parts."""
        self.first, self.parts = np.zeros(len(self.counts), np.int32), np.ones(len(self.counts), np.int32)
        if self.order is None:
            some = np.flatnonzero(self.counts)
            self.order = some[np.argsort(self.regions(some), kind="stable")]
        n = self.counts[self.order].astype(np.int64)
        end = np.cumsum(n)
        large = n > block_rows // 8  # may be cut where a block ends
        first = np.where(large, (end - n) // block_rows, (end - n // 2 - 1) // block_rows)
        self.first[self.order] = first
        self.parts[self.order] = np.where(large, (end - 1) // block_rows - first + 1, 1)
        self.blocks = int((end[-1] - 1) // block_rows) + 1

    def plan(self, traversed: list[np.ndarray], n: int, cores: int) -> None:
        """Block size and tasks that send the fewest rows, with a task for each core and no task above its bounds."""
        best, most = None, min(BLOCK_ROWS, n)
        for rows in {-(-most // m): None for m in (1, 2, 3, 4, 6, 8, 12, 16, 32, 64)}:
            self.pack(rows)
            load = np.bincount(np.concatenate([self.blocks_of(c) for c in traversed]), minlength=self.blocks) * (n / len(traversed))
            self.deal(load, int(max(cores, load.sum() / TASK_ROWS)))
            sent = load.sum() + self.tasks.sum() / self.blocks * n
            if best is None or sent < best[0]:
                best = sent, rows, load
        self.pack(best[1])
        self.deal(best[2], int(max(cores, best[2].sum() / TASK_ROWS)))

    def deal(self, load: np.ndarray, tasks: int) -> None:
        """Tasks of each block by its share of the load; `offset` is a block's first task."""
        share = load / max(1.0, load.sum())
        self.tasks = np.maximum(1, np.ceil(share * tasks)).astype(np.int32)
        self.offset = (np.cumsum(self.tasks) - self.tasks).astype(np.int32)

    def depth(self, x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        """For each row of x and each of its given cells, how many entries a traversal meets until it has that cell."""
        a, b = self.distances(x)
        out = []
        for i, wanted in enumerate(cells):
            d = a[i][:, None] + b[i][None, :]
            of, back = np.unique(wanted, return_inverse=True)
            met = np.array([int(self.counts[(d <= d[c // self.k, c % self.k]).ravel()].sum()) for c in of], np.int64)
            out.append(met[back])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def blocks_of(self, cells: np.ndarray) -> np.ndarray:
        """The blocks that hold any of the cells; a cell in parts is in several."""
        first, parts = self.first[cells], self.parts[cells]
        if (parts > 1).any():
            first = np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.unique(first)

    def slices(self, n: int) -> Iterator[slice]:
        """Rows to traverse at a time, so that their distances to all centroids stay small."""
        step = max(16, 200_000 // self.k)
        return (slice(s, s + step) for s in range(0, n, step))

    def beyond(self, x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        """For each row of x and each of its given cells, how much farther that is than the nearest pair of centroids."""
        a, b = self.distances(x)
        least = a.min(axis=1) + b.min(axis=1)
        return np.concatenate([np.empty(0, np.float32), *(a[i, c // self.k] + b[i, c % self.k] - least[i] for i, c in enumerate(cells))])

    def traverse(self, x: np.ndarray, candidates: int, beyond: float = np.inf) -> Iterator[tuple[float, np.ndarray]]:
        """For each row of x, the cells to compare it with, nearest pair first until they hold enough entries or lie farther beyond it, and the distance of the last."""
        some = np.flatnonzero(self.counts)
        if beyond == np.inf and candidates * len(some) > DEEP * self.counts[some].sum(dtype=np.int64):
            held, ones, twos = self.counts[some].astype(np.int64), some // self.k, some % self.k
            for rows in self.slices(len(x)):
                for a, b in zip(*self.distances(x[rows])):
                    d = a[ones] + b[twos]
                    order = d.argsort()
                    n = min(len(some), int(np.searchsorted(np.cumsum(held[order]), candidates)) + 1)
                    yield float(d[order[n - 1]]), some[order[:n]]
            return
        for rows in self.slices(len(x)):
            yield from self._near(x[rows], candidates, beyond)

    def _near(self, x: np.ndarray, candidates: int, beyond: float) -> Iterator[tuple[float, np.ndarray]]:
        a, b = self.distances(x)
        oa, ob = a.argsort(axis=1), b.argsort(axis=1)
        sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        counts, k, na, nb = self.counts, self.k, a.shape[1], b.shape[1]
        for da, db, ia, ib in zip(sa.tolist(), sb.tolist(), oa.tolist(), ob.tolist()):
            heap, popped, got, out, last = [(da[0] + db[0], 0, 0)], [0] * na, 0, [], da[0] + db[0]  # popped[i]: how many pairs of row i are taken
            end = da[0] + db[0] + beyond
            while heap and got < candidates and heap[0][0] <= end:
                d, i, j = heapq.heappop(heap)
                popped[i] = j + 1
                cell = ia[i] * k + ib[j]
                if n := counts.item(cell):
                    got += n
                    out.append(cell)
                    last = d
                if i + 1 < na and popped[i + 1] == j:
                    heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
                if j + 1 < nb and (i == 0 or popped[i - 1] > j + 1):
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            yield last, np.array(out, np.int64)


class Block:
    """The members of a task, by cell."""

    def __init__(self, index: MultiIndex, vecs: list[np.ndarray], ids: list[np.ndarray], cells: list[np.ndarray]):
        of = np.concatenate(cells)
        order = np.argsort(of, kind="stable")
        self.index, self.ids = index, np.concatenate(ids)[order]
        self.members = np.concatenate(vecs)
        vecs.clear()
        self.members = self.members[order]
        self.cells, starts = np.unique(of[order], return_index=True)
        self.starts = np.append(starts, len(of))

    def best(self, queries: np.ndarray, query_ids: np.ndarray, reach: np.ndarray, k: int, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(entry, near, similarity): the top k of the block for each query, compared with the cells up to its reach."""
        ones, twos = self.cells // self.index.k, self.cells % self.index.k
        step = max(1, PROBES // len(self.cells))
        begin, held, found = 0, 0, []
        for s in range(0, len(queries), step):
            a, b = self.index.distances(queries[s : s + step])
            d = a[:, ones] + b[:, twos]
            near = d <= reach[s : s + step, None] + 1e-5  # distances may differ in the last digits from those that were sent
            rows, cells = np.nonzero(near)
            nearest = cells == d.argmin(axis=1)[rows]
            found.append(((rows + s - begin).astype(np.int32), cells.astype(np.int32), nearest))
            held += len(rows)
            end = min(len(queries), s + step)
            if held >= PROBES or end == len(queries):
                r, m, sims = compare(self.members, self.ids, self.starts, queries[begin:end], query_ids[begin:end], *map(np.concatenate, zip(*found)), k, least)
                yield query_ids[begin:end][r], m, sims
                begin, held, found = end, 0, []


def best_of(r: np.ndarray, m: np.ndarray, s: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, member, similarity), the top k of each of n rows, equal similarities by the members' ids."""
    order = np.lexsort((ids[m], -s, r))
    r, m, s = r[order], m[order], s[order]
    top = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r] < k
    return r[top], m[top], s[top]


def compare(members: np.ndarray, member_ids: np.ndarray, starts: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, cells: np.ndarray, nearest: np.ndarray, k: int, least: float | None = None):
    """Top k entries of one block for each query: (row, entry, similarity); with `least`, only what is about as similar.

    Members lie by cell, from starts[cell] on. rows, cells: which query meets which cell; nearest: whether that is its nearest.
    """
    floor = np.float32(-np.inf if least is None else least - 1e-5)
    bar = np.full(len(queries), floor, np.float32)  # what the (k + 1)-th best reaches at least
    keep, held, most = [], 0, KEPT
    for turn in (nearest, ~nearest):  # the nearest cells set bars that little of the others passes
        by_cell = np.flatnonzero(turn)
        by_cell = by_cell[np.argsort(cells[by_cell], kind="stable")]
        r_of, c_of = rows[by_cell], cells[by_cell]
        some, begins = np.unique(c_of, return_index=True)
        for cell, a, b in zip(some.tolist(), begins.tolist(), [*begins.tolist()[1:], len(c_of)]):
            lo, hi = int(starts[cell]), int(starts[cell + 1])
            step = max(1, 2_000_000 // max(1, hi - lo))
            for s in range(a, b, step):
                r = r_of[s : min(b, s + step)]
                sims = queries[r] @ members[lo:hi].T
                fresh = np.flatnonzero(bar[r] == floor) if least is None else ()
                if len(fresh) and hi - lo > k:
                    bar[r[fresh]] = np.partition(sims[fresh], hi - lo - k - 1, axis=1)[:, hi - lo - k - 1]
                i, j = np.nonzero(sims >= bar[r][:, None])
                keep.append((r[i], (lo + j).astype(np.int32), sims[i, j]))
                held += len(i)
                if held > most:  # only the k + 1 best of each query stay, and raise its bar
                    keep = [best_of(*map(np.concatenate, zip(*keep)), member_ids, len(queries), k + 1)]
                    r, _, sims = keep[0]
                    ends = np.searchsorted(r, np.arange(len(queries)), "right")
                    full = np.flatnonzero(np.diff(ends, prepend=0) > k)
                    bar[full] = np.maximum(bar[full], sims[ends[full] - 1])
                    held = len(r)
                    most = held + KEPT
    if not keep:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    r, m, s = map(np.concatenate, zip(*keep))
    other = member_ids[m] != query_ids[r]
    r, m, s = best_of(r[other], m[other], s[other], member_ids, len(queries), k)
    return r, member_ids[m], s


def compare_all(members: np.ndarray, member_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, least: float | None = None):
    """Top k of all members for each query: (row, entry, similarity); with `least`, only what is about as similar."""
    out, groups = [], len(members) // GROUP
    members_t, step = members.T, max(1, 16_000_000 // max(1, len(members)))
    for s in range(0, len(queries), step):
        sims = queries[s : s + step] @ members_t
        bar = np.full(len(sims), -np.inf if least is None else least - 1e-5, np.float32)
        if groups > k:  # k + 1 groups reach this bar, so the k + 1 best do
            tops = sims[:, : groups * GROUP].reshape(len(sims), groups, GROUP).max(axis=2)
            bar = np.maximum(bar, np.partition(tops, groups - k - 1, axis=1)[:, groups - k - 1])
        r, j = np.nonzero(sims >= bar[:, None])
        m, sim = member_ids[j], sims[r, j]
        other = m != query_ids[s + r]
        r, m, sim = r[other], m[other], sim[other]
        order = np.lexsort((m, -sim, r))
        r, m, sim = r[order], m[order], sim[order]
        top = np.arange(len(r)) - np.searchsorted(r, np.arange(len(sims)))[r] < k
        out.append((s + r[top], m[top], sim[top]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out))


_SERVED = pa.schema([("entry", pa.int64()), ("near", pa.int64()), ("sim", pa.float32())])


class Neighbours:
    def __init__(self, vectors: DataFrame, dim: int = DIM, k: int = K, exact: bool = False, least: float | None = None):
        """vectors: (key, vec) of unit_vectors(). exact: brute force instead of the index. least: neighbours less similar aren't wanted."""
        self.k, self.dim, self.scratch = k, dim, (s := Scratch(vectors.sparkSession))
        self.rows = rows = s.keep(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
        # copies: vectors are only shuffled where their hashes repeat
        again = rows.groupBy(F.xxhash64("vec").alias("_h")).count().filter("count > 1").select("_h")
        suspects = rows.withColumn("_h", F.xxhash64("vec")).join(again, "_h", "left_semi").select("vec", "row", "key")
        groups = suspects.groupBy("vec").agg(F.min("row").alias("entry"), F.count("*").alias("n")).filter("n > 1").drop("n")
        self.copies = copies = s.keep(suspects.join(groups, "vec").select("row", "key", "entry"), "copies")
        self.entries = plain = rows.join(copies.filter("row <> entry").select("row"), "row", "left_anti").select(F.col("row").alias("entry"), "vec")
        n = plain.count()
        self.n, self.found, self.candidates, self.beyond = n, None, None, np.inf
        if n:
            self.found = s.keep(self._best(self._all(plain, n, plain, n, dim, k, least) if exact else self._search(least), k), "found")

    def _sample(self, about: int, salt: int) -> DataFrame:
        """About so many entries, chosen by hash; all if there are fewer."""
        share = max(1, self.n // about)
        return self.entries.filter(F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(share)) == 0).limit(2 * about)

    def _search(self, least: float | None) -> DataFrame:
        plain, n, dim, k = self.entries, self.n, self.dim, self.k
        context = plain.sparkSession.sparkContext
        sample = self._sample(SAMPLE, 0).select("vec").collect() or [plain.select("vec").first()]
        index = MultiIndex(matrix([r[0] for r in sample], dim).copy(), n)
        centroids = context.broadcast(index)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = centroids.value.cells(matrix(b.column(0).to_pylist(), dim)) if b.num_rows else np.empty(0, np.int64)
                some, counts = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts, pa.int64())], names=["cell", "n"])

        counted = plain.select("vec").mapInArrow(cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most MAX_CENTROIDS^2 rows
        index.count(counted.column("cell").to_numpy(), counted.column("n").to_numpy())
        asked = self._sample(CALIBRATE if least is None else CALIBRATE_LEAST, 1).collect() or [plain.first()]
        queries = matrix([r["vec"] for r in asked], dim)
        far = index.beyond(queries, self._true_cells(centroids, asked, queries, least)) if least is not None else ()
        if len(far) >= ENOUGH:
            self.candidates, self.beyond = n, float(far.max() * MARGIN) + 1e-5
        else:
            asked, queries = asked[: 2 * CALIBRATE], queries[: 2 * CALIBRATE]
            met = index.depth(queries, self._true_cells(centroids, asked, queries, None))
            self.candidates = int(np.ceil(np.quantile(met, RECALL) * MARGIN)) if len(met) else 1
        some, held = [], 0
        for _, found in index.traverse(queries[: 2 * CALIBRATE], self.candidates, self.beyond):
            if some and held + len(found) > PLANNED:
                break
            some.append(found)
            held += len(found)
        index.plan(some, n, context.defaultParallelism)
        whole, candidates, beyond = context.broadcast(index), self.candidates, self.beyond
        centroids.unpersist()

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each entry to the tasks of its block, as a member, and once to each block that it asks, as a query."""
            ix = whole.value
            names = ["task", "turn", "entry", "vec", "cell", "reach"]
            for b in batches:
                if not b.num_rows:
                    continue
                ids, vecs = b.column(0).to_numpy(), b.column(1)
                x = matrix(vecs.to_pylist(), dim)
                cell = ix.cells(x)
                block = ix.first[cell] + ids % ix.parts[cell]
                copies = ix.tasks[block]
                at = np.repeat(np.arange(len(ids)), copies)
                task = ix.offset[block][at] + np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(2 * task.astype(np.int64)), pa.array(ids[at]), vecs.take(pa.array(at)), pa.array(cell[at], pa.int32()), pa.nulls(len(at), pa.float32())], names=names)
                for rows in ix.slices(len(ids)):
                    ends, blocks = [], []
                    for end, found in ix.traverse(x[rows], candidates, beyond):
                        ends.append(end)
                        blocks.append(ix.blocks_of(found))
                    at = np.repeat(np.arange(len(ends)), [len(b) for b in blocks])
                    block, query = np.concatenate(blocks), ids[rows][at]
                    task = ix.offset[block] + (query * 2_654_435_761 >> 7) % ix.tasks[block]
                    yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(2 * task.astype(np.int64) + 1), pa.array(query), vecs.take(pa.array(at + rows.start)), pa.nulls(len(at), pa.int32()), pa.array(np.array(ends, np.float32)[at])], names=names)

        def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each task, the members of a block come first, then the queries dealt to it."""
            now, block, vecs, ids, cells = None, None, [], [], []
            for b in batches:
                turn = b.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(turn)) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(turn)]):
                    if s == e:
                        continue
                    part, task, asks = b.slice(s, e - s), turn[s] // 2, turn[s] % 2
                    if task != now:
                        now, block, vecs, ids, cells = task, None, [], [], []
                    x, of = matrix(part.column(2).to_pylist(), dim), part.column(1).to_numpy()
                    if not asks:
                        vecs.append(x)
                        ids.append(of)
                        cells.append(part.column(3).to_numpy())
                        continue
                    if block is None and ids:
                        block = Block(whole.value, vecs, ids, cells)
                        vecs, ids, cells = [], [], []
                    if block is not None:
                        for q, near, sims in block.best(x, of, part.column(4).to_numpy(), k, least):
                            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near), pa.array(sims)], schema=_SERVED)

        sent = plain.mapInArrow(send, "task int, turn bigint, entry bigint, vec binary, cell int, reach float")
        dealt = sent.repartitionById(int(index.tasks.sum()), "task").drop("task").sortWithinPartitions("turn")
        return dealt.mapInArrow(serve, "entry bigint, near bigint, sim float")

    def _true_cells(self, centroids, asked: list, queries: np.ndarray, least: float | None) -> list[np.ndarray]:
        """The cells of the true neighbours (of at least `least`) of each of the asked entries."""
        near: dict[int, list[int]] = {r["entry"]: [] for r in asked}
        best = self._best(self._exact([r["entry"] for r in asked], queries, centroids, least), self.k)
        for r in best.select("entry", "near").collect():  # k rows a query; near is a cell
            near[r["entry"]].append(r["near"] >> 40)
        return [np.array(near[r["entry"]], np.int64) for r in asked]

    def _exact(self, ids: list[int], queries: np.ndarray, centroids, least: float | None) -> DataFrame:
        """The true neighbours (of at least `least`) of a bounded set of queries: (entry, near, sim); near is the neighbour's cell << 40, with its row to tell neighbours apart."""
        k, dim = self.k, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, rows = matrix(b.column(1).to_pylist(), dim), b.column(0).to_numpy()
                r, m, sims = compare_all(x, np.arange(len(rows)), queries, np.full(len(ids), -1), k + 1, least)
                other = rows[m] != np.array(ids)[r]
                r, m, sims = r[other], m[other], sims[other]
                cell = centroids.value.cells(x[m]) if len(m) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[r], pa.int64()), pa.array(cell << 40 | rows[m] & (1 << 40) - 1, pa.int64()), pa.array(sims)], schema=_SERVED)

        return self.entries.mapInArrow(run, "entry bigint, near bigint, sim float")

    def recall(self, chosen: DataFrame) -> DataFrame:
        """One row (n_queries, n_true, recall): the share of the true neighbours of the chosen keys (key) that the index found."""
        asked = self.rows.join(chosen.select("key").distinct(), "key", "left_semi").select(F.col("row").alias("entry"), "vec")
        asked = self.scratch.keep(asked.join(self.copies.filter("row <> entry").select(F.col("row").alias("entry")), "entry", "left_anti"), "chosen")
        m = asked.count()
        if not m:
            return asked.agg(F.count("*").alias("n_queries"), F.count("*").alias("n_true"), F.lit(1.0).alias("recall"))
        true = self._best(self._all(self.entries, self.n, asked, m, self.dim, self.k, None), self.k)
        worst = true.groupBy("entry").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
        hits = self.found.join(worst, "entry").groupBy("entry").agg(F.sum((F.col("sim") >= F.col("worst") - 1e-6).cast("int")).alias("hits"))
        per = worst.join(hits, "entry", "left").select("n", F.least("n", F.coalesce("hits", F.lit(0))).alias("hits"))
        return per.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("hits") / F.sum("n"), F.lit(1.0)).alias("recall"))

    @staticmethod
    def _best(best: DataFrame, k: int) -> DataFrame:
        """Of a query, at most k rows for each block it went to."""
        merged = best.groupBy("entry").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("sim"), (-F.col("near")).alias("near"))), asc=False), 1, k).alias("near"))
        return merged.select("entry", F.explode("near").alias("x")).select("entry", (-F.col("x.near")).alias("near"), "x.sim")

    @staticmethod
    def _all(entries: DataFrame, n: int, asked: DataFrame, m: int, dim: int, k: int, least: float | None) -> DataFrame:
        """Every block of entries meets every part of the queries in a task of its own."""
        blocks, parts = -(-n // BLOCK_ROWS), -(-m // QUERY_ROWS)
        of = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
        each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        members = entries.withColumn("block", of("entry", blocks)).withColumn("task", each(parts))
        queries = asked.select(F.col("entry").alias("query"), F.col("vec").alias("asked")).withColumn("part", of("query", parts)).withColumn("of", each(blocks))

        def serve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"entry": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float32")})
            q = right["query"].to_numpy()
            r, m, sims = compare_all(matrix(left["vec"], dim), left["entry"].to_numpy(), matrix(right["asked"], dim), q, k, least)
            return pd.DataFrame({"entry": q[r], "near": m, "sim": sims})

        return members.groupBy("block", "task").cogroup(queries.groupBy("of", "part")).applyInPandas(serve, "entry bigint, near bigint, sim float")

    def pairs(self, least: float | None = None) -> DataFrame:
        """(key, near, similarity, rank): the k most similar other rows of every row, best first; only those of at least `least`."""
        k = self.k
        kept = self.rows.select("row", "key").join(self.copies.select("row", "entry"), "row", "left").select("key", F.coalesce("entry", "row").alias("entry"))
        several = self.copies.select("entry").distinct()
        if self.found is None:
            return kept.select("key", F.col("key").alias("near"), F.lit(0.0).cast("float").alias("similarity"), F.lit(0).alias("rank")).limit(0)
        near = self.found if least is None else self.found.filter(F.col("sim") >= least)
        w = Window.partitionBy("entry").orderBy("key")
        wanted = near.select(F.col("near").alias("entry")).union(several).distinct()
        few = kept.join(wanted, "entry", "left_semi").withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k + 1).drop("_i")
        ids = self.scratch.keep(few.groupBy("entry").agg(F.sort_array(F.collect_list("key")).alias("ids")), "ids")  # k + 1 at most
        listed = near.join(ids.select(F.col("entry").alias("near"), "ids"), "near").groupBy("entry").agg(F.collect_list(F.struct("sim", "ids")).alias("others"))
        copies = several.join(ids.withColumnRenamed("ids", "copies"), "entry")
        lists = copies.join(listed, "entry", "full").select("entry", F.coalesce("others", F.array().cast("array<struct<sim:float,ids:array<string>>>")).alias("others"), F.coalesce("copies", F.array().cast("array<string>")).alias("copies"))
        mine = F.transform(F.filter("copies", lambda x: x != F.col("key")), lambda x: F.struct((-F.lit(1.0).cast("float")).alias("s"), x.alias("near")))
        rest = F.flatten(F.transform("others", lambda o: F.transform(o["ids"], lambda x: F.struct((-o["sim"]).alias("s"), x.alias("near")))))
        ranked = F.slice(F.array_sort(F.concat(mine, rest)), 1, k)
        return kept.join(lists, "entry").select("key", F.posexplode(ranked).alias("_p", "_x")).select("key", F.col("_x.near").alias("near"), (-F.col("_x.s")).alias("similarity"), (F.col("_p") + 1).alias("rank"))


def neighbours(spark: SparkSession, folder: str, least: float | None = None) -> Neighbours:
    now = current_rows(table(spark, folder, "chunks"), "embedding")
    return Neighbours(unit_vectors(now, "id", "embedding", DIM), least=least)


def knn(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(spark, folder).pairs().withColumnsRenamed({"key": "chunk_id", "near": "near_chunk_id"})


def hundredth(key: Column) -> Column:
    """Whether a UUID, taken as a number, is divisible by 100."""
    rest = F.lit(0).cast("long")
    for part in range(4):
        rest = (rest * (2**32 % 100) + F.conv(F.substring(F.replace(key, F.lit("-"), F.lit("")), 8 * part + 1, 8), 16, 10).cast("long")) % 100
    return rest == 0


def recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall at ten, of all live chunks whose id is divisible by 100 against all rows."""
    n = neighbours(spark, folder)
    return n.recall(n.rows.filter(hundredth(F.col("key"))))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of similarity 0.8 and more. The rank of such a neighbour only depends on neighbours at least as similar."""
    p = neighbours(spark, folder, 0.8).pairs(least=0.8)
    return p.select(F.least("key", "near").alias("chunk_id_a"), F.greatest("key", "near").alias("chunk_id_b")).distinct()
