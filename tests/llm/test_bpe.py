import base64
import random

import pytest

from cairnmill.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pair():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return bpe.Encoder(*bpe.default_vocabulary()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(pair, texts):
    enc, tk = pair
    ids, ends = enc.encode(texts)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == (tk.encode_ordinary(t) if t else []), repr(t)


def test_edges(pair):
    same(pair, [None, "", " ", "  ", "\n", "a", " a", "a ", "don't", "<|endoftext|>", "\U000f0001 a  b", "\U000f0001", "  ", "a\x1cb", "naïve 中文 字", "\r\n\r\n  x", None])


def test_random_mixtures(pair):
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "Zb", "é", "中文", "!?", "12", "'s", "　", "\x1c", "\U000f0001", "."]
    same(pair, ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(3000)])


def test_long_words(pair):
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 20_000):
        same(pair, ["ab1c" * (n // 4), "z" * n, ("中" * n)[:n]])


def test_forgetting(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    for k in range(5):
        same(pair, [f"words number {k} and {j}" for j in range(30)])


def test_rows(spark, pair):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (2, "", 9), (3, "x " * 50_000, 9)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert got[:3] == [(1, 2), (2, 0), (2, 0)] and got[3][1] == len(pair[1].encode_ordinary("x " * 50_000))
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
