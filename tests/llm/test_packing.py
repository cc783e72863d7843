from collections import Counter

import numpy as np

from cairnmill.llm import bpe, packing


def run(spark, rows, **k):
    return packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string, piece int"), **k).collect()


def check(got, texts, capacity):
    enc = bpe.encoder(*bpe.default_vocabulary())
    sizes = dict(zip(texts, enc.sizes(list(texts.values())).tolist()))
    held, spans = Counter(), {}
    for r in got:
        if r["container_id"] is not None:
            held[r["container_id"]] += r["n_tokens"]
            spans.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
        else:
            assert sizes[r["doc_id"]] == 0
    assert max(held.values(), default=0) <= capacity
    for d, n in sizes.items():
        at = 0
        for first, size in sorted(spans.get(d, [])):
            assert first == at and (size == capacity or at + size == n)
            at += size
        assert at == n and (n <= capacity) == (len(spans.get(d, [])) <= 1)
    return held


def test_every_token_once(spark):
    texts = {i: f"topic{i % 5} words about topic{i % 5} " * (1 + i * 7 % 23) for i in range(300)} | {1000: "long " * 5000, 1001: None, 1002: "", 1003: "x"}
    got = run(spark, [(d, t, 1) for d, t in texts.items()], capacity=256)
    held = check(got, texts, 256)
    assert sum(held.values()) / (len(held) * 256) > 0.95


def test_related_texts_share_containers(spark):
    texts = {i: f"subject{i % 10} " * 20 for i in range(200)}
    got = run(spark, [(d, t, 1) for d, t in texts.items()], capacity=512)
    mates = Counter()
    for c in {r["container_id"] for r in got}:
        kinds = [r["doc_id"] % 10 for r in got if r["container_id"] == c]
        mates["same"] += max(Counter(kinds).values())
        mates["all"] += len(kinds)
    assert mates["same"] / mates["all"] > 0.7


def test_shards_and_empty(spark):
    texts = {i: f"text {i} " * (i % 9) for i in range(100)}
    held = check(run(spark, [(d, t, 1) for d, t in texts.items()], capacity=64, shard_rows=10), texts, 64)
    assert held
    assert run(spark, []) == []


def test_bm25_finds_the_nearest():
    docs = [[1, 2, 3], [1, 2, 4], [5, 6, 7], [1, 8, 9]]
    ids, ends = np.array([x for d in docs for x in d], np.int32), np.cumsum([0, *map(len, docs)])
    near = packing.Index(ids, ends, packing.Statistics(np.bincount(ids, minlength=10), 4, 12)).neighbours(0, np.ones(4, bool))
    assert near.tolist() == [1, 3]


def test_scores_are_those_of_plain_bm25():
    """Dense and sparse terms together give the scores of the formula, with the corpus's frequencies and not the shard's."""
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.5, rng.integers(5, 60)) % 50 for _ in range(60)]
    ids, ends = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    df = np.bincount([t for d in docs for t in set(d.tolist())], minlength=50) * 3
    stats = packing.Statistics(df, 200, 6000)
    index = packing.Index(ids, ends, stats)
    for q in (0, 7, 59):
        want = []
        for d in docs:
            tf = Counter(d.tolist())
            want.append(sum(stats.idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / 30)) for t in set(docs[q].tolist()) if tf[t]))
        assert np.allclose(index.scores(q), want, rtol=1e-4)


def test_related_texts_meet_across_the_corpus(spark):
    """Shards hold what belongs together, wherever it lies in the table; random dealing doesn't."""
    rng = np.random.default_rng(8)
    topics = [[f"w{t}x{k}" for k in range(30)] for t in range(12)]
    rows = [(int(i), " ".join(rng.choice(topics[i % 12], 25)), 1) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece int").repartition(6)
    p = packing.Packing(df, capacity=600, shard_rows=100)
    r = p.relatedness().first()
    loose = packing.Packing(df, capacity=600, shard_rows=100, by_content=False).relatedness().first()
    assert r["within"] > 0.5 > loose["within"] + 0.05 or r["within"] > loose["within"] + 0.1
    assert r["at_random"] < 0.3


def test_a_third_of_copies_is_no_hot_shard(spark):
    rows = [(i, "the same text again and again", 1) for i in range(2000)] + [(5000 + i, f"text {i} on subject {i % 7}", 1) for i in range(2000)]
    p = packing.Packing(spark.createDataFrame(rows, "doc_id bigint, text string, piece int"), shard_rows=200)
    sizes = [r["count"] for r in p.shards.groupBy("centroid", "part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 4 * 200
