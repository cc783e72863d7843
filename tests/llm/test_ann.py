import numpy as np
import pytest

from cairnmill.llm import ann

DIM = 16


def frame(spark, rows):
    return ann.unit_vectors(spark.createDataFrame(rows, "id string, embedding array<float>, key int"), "id", "embedding", DIM)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, DIM))
    return (centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, DIM))) * rng.uniform(0.01, 50, (n, 1))


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_exact_on_request(spark):
    x = clustered(300)
    pairs = ann.Neighbours(frame(spark, [(f"{i:04d}", v.tolist(), 1) for i, v in enumerate(x)]), DIM, 5, exact=True).pairs().collect()
    s, top = brute(x, 5)
    got = {}
    for r in sorted(pairs, key=lambda r: r["rank"]):
        got.setdefault(int(r["key"]), []).append(int(r["near"]))
        assert r["similarity"] == pytest.approx(s[int(r["key"]), int(r["near"])], abs=1e-5)
    assert all(set(got[i]) == set(top[i].tolist()) for i in range(300))


def test_recall_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_ROWS", 200)
    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    x = clustered(2000, 1)
    pairs = ann.Neighbours(frame(spark, [(f"{i:04d}", v.tolist(), 1) for i, v in enumerate(x)]), DIM, 10).pairs().collect()
    _, top = brute(x, 10)
    got = {}
    for r in pairs:
        got.setdefault(int(r["key"]), set()).add(int(r["near"]))
    assert all(len(g) == 10 for g in got.values()) and len(got) == 2000
    assert np.mean([len(got[i] & set(top[i].tolist())) / 10 for i in range(2000)]) >= 0.97


def test_copies_ties_and_dirt(spark):
    v, w = [1.0] * DIM, [1.0] * (DIM - 1) + [0.9]
    rows = [(f"c{i:02d}", [2.0**i * x for x in v], 1) for i in range(15)] + [("near", w, 1), ("nan", [float("nan")] * DIM, 1), ("inf", [float("inf")] * DIM, 1), ("zero", [0.0] * DIM, 1), ("short", [1.0], 1), ("null", None, 1), ("hole", [None] + [1.0] * (DIM - 1), 1), ("tiny", [1e-38] * DIM, 1)]
    p = ann.Neighbours(frame(spark, rows), DIM, 10)
    pairs = p.pairs().collect()
    of = lambda k: [r["near"] for r in sorted((r for r in pairs if r["key"] == k), key=lambda r: r["rank"])]
    assert {r["key"] for r in pairs} == {f"c{i:02d}" for i in range(15)} | {"near", "tiny"}
    assert of("c00") == [f"c{i:02d}" for i in range(1, 11)] and of("c14") == [f"c{i:02d}" for i in range(10)]
    assert of("near") == [f"c{i:02d}" for i in range(10)]
    assert {r["key"] for r in p.pairs(least=0.9999).collect()} == {f"c{i:02d}" for i in range(15)} | {"tiny", "near"} or all(r["similarity"] >= 0.9999 for r in p.pairs(least=0.9999).collect())


def test_few_and_none(spark):
    one = frame(spark, [("a", [1.0] * DIM, 1)])
    assert ann.Neighbours(one, DIM).pairs().count() == 0
    assert ann.Neighbours(one.limit(0), DIM).pairs().count() == 0
    two = frame(spark, [("a", [1.0] * DIM, 1), ("b", [1.0] * (DIM - 1) + [0.0], 1)])
    assert {(r["key"], r["near"], r["rank"]) for r in ann.Neighbours(two, DIM).pairs().collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_found_on_the_tables(spark, sf):
    from cairnmill.sources.tables import current_rows, table

    rows = ann.unit_vectors(current_rows(table(spark, sf, "chunks"), "embedding"), "id", "embedding", 96).collect()
    x, ids = ann.matrix([r["vec"] for r in rows], 96), [r["key"] for r in rows]
    s, top = brute(x, 10)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in top[i] if s[i, j] >= 0.8}
    assert {tuple(r) for r in ann.found(spark, sf).collect()} == want


def test_depth_follows_the_data(spark):
    """Random vectors have no cells worth the name: the traversal goes nearly everywhere. Tight clusters need few entries."""
    def build(x):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        rows = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
        return ann.Neighbours(ann.unit_vectors(rows, "id", "v", 96)), x

    rng = np.random.default_rng(5)
    n, x = build(rng.normal(size=(6000, 96)))
    got = {}
    for r in n.pairs().collect():
        got.setdefault(int(r["key"]), set()).add(int(r["near"]))
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    best = np.argpartition(-sims, 10, axis=1)[:, :10]
    assert sum(len(got[i] & set(best[i].tolist())) for i in range(len(x))) >= 0.98 * 10 * len(x)
    tight, _ = build(rng.normal(size=(60, 96))[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 96)))
    assert tight.candidates < 600
    chosen = tight.rows.filter("key like '%00'")
    r = tight.recall(chosen).first()
    assert r["n_queries"] == 60 and r["n_true"] == 600 and r["recall"] >= 0.99


def test_hundredth(spark):
    import uuid

    rng = np.random.default_rng(3)
    ids = [uuid.UUID(bytes=rng.bytes(16)) for _ in range(500)] + [uuid.UUID(int=100), uuid.UUID(int=2**128 - 56), uuid.UUID(int=0)]
    got = {r["id"] for r in spark.createDataFrame([(str(i),) for i in ids], "id string").filter(ann.hundredth(ann.F.col("id"))).collect()}
    assert got == {str(i) for i in ids if i.int % 100 == 0}


def test_deep_traversals_in_little_memory(monkeypatch):
    """Every query meets every cell; neither its cells nor what is similar pile up, and the result is that of brute force."""
    import tracemalloc

    monkeypatch.setattr(ann, "PROBES", 20_000)
    monkeypatch.setattr(ann, "KEPT", 20_000)
    x = np.random.default_rng(4).normal(size=(3000, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.MultiIndex(x, 50_000)
    cells, ids = index.cells(x), np.arange(3000)
    index.count(*np.unique(cells, return_counts=True))
    reach = np.array([end for end, _ in index.traverse(x, 3000)], np.float32)
    block = ann.Block(index, [x.copy()], [ids], [cells])
    tracemalloc.start()
    got = {}
    for least in (None, 0.1):
        for q, near, _ in block.best(x, ids, reach, 10, least):
            for a, b in zip(q.tolist(), near.tolist()):
                got.setdefault((least, a), set()).add(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    _, top = brute(x, 10)
    assert all(np.mean([len(got[least, i] & set(top[i].tolist())) / 10 for i in range(3000)]) > 0.999 for least in (None, 0.1))


def test_only_wanted_neighbours_set_the_depth(spark):
    """Noise without clusters, where the nearest neighbours lie anywhere, and near copies of some rows: only these are sought."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 96))
    x[:300] = x[300:600] + 0.2 * rng.normal(size=(300, 96))
    rows = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
    n = ann.Neighbours(ann.unit_vectors(rows, "id", "v", 96), least=0.8)
    got = {tuple(sorted((int(r["key"]), int(r["near"])))) for r in n.pairs(least=0.8).collect()}
    assert got == {(i, 300 + i) for i in range(300)}
    assert n.beyond < 1
