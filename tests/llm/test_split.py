import random

import pyarrow.parquet as pq
import pytest

from cairnmill.llm import split


def check(text, limit=768, overlap=64):
    got = split.cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a <= c <= b < d and 0 <= b - c <= overlap
    assert all(b - a <= limit for a, b in got)
    return got


def test_corpus(sf):
    for t in pq.read_table(f"{sf}/chunks.parquet", columns=["content"])["content"].to_pylist():
        if t:
            check(t)


@pytest.mark.parametrize("text", ["", "x", "x" * 768, "x" * 769, "x" * 20_000, "é́" * 2000, "a\r\n" * 900, " " * 5000, "word " * 1000, "中文。" * 1000, "```\n" + "code line\n" * 300 + "```\n", "| a | b |\n" * 300, "👩‍💻" * 900])
def test_shapes(text):
    check(text)


def test_random():
    rnd = random.Random(1)
    parts = ["word ", "End. ", "\n", "\n\n", "# Head\n", "```\n", "- item\n", "x" * 300, "中文，", "| a | b |\n", "\r\n"]
    for _ in range(150):
        check("".join(rnd.choice(parts) for _ in range(rnd.randrange(5, 400))), 200, 40)


def test_prefers_headings_and_never_cuts_words_needlessly():
    text = "".join(f"# Part {i}\n\n" + "Some words here. " * 25 + "\n\n" for i in range(6))
    for a, b in check(text)[:-1]:
        assert text[b - 1].isspace()
    assert any(text[b:].startswith("# Part") for _, b in check(text)[:-1])


def test_rows(spark):
    df = spark.createDataFrame([("a", "x" * 769, 1), ("b", None, 1), ("c", "", 1), ("d", "y" * 768, 1), ("a", "x" * 769, 1)], "id string, content string, piece int")
    got = split.split(df, "id", "content").collect()
    assert sorted((r["id"], r["n_pieces"]) for r in got) == [("a", 2)] * 4 + [("b", 1), ("c", 1), ("d", 1)]
    assert split.split(df.limit(0), "id", "content").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split.split(df, "id", "content", 100, 90)


def test_long_frontmatter_is_kept_together():
    """A block of any number of lines counts as frontmatter: cuts inside of it cost more."""
    for n in (50, 70, 400):
        text = "---\n" + "".join(f"key{i}: value\n" for i in range(n)) + "---\n\n# Title\n"
        at = split.boundaries(text, 768)
        assert at[text.index("key5:")] == split.LINE + split.INSIDE and at[text.index("# Title")] == split.HEADING


def test_words_are_boundaries_everywhere():
    text = "One two. Three, four five\nsix seven. " * 40
    at = split.boundaries(text, 768)
    assert at[text.index("two")] == split.WORD and at[text.index("four")] == split.CLAUSE and at[text.index("Three")] == split.SENTENCE


def test_many_tables_take_linear_time():
    import time

    def run(n):
        text = "Some words here.\n\n| a | b |\n| 1 | 2 |\n\n" * n
        t = time.time()
        got = split.cuts(text)
        assert got[-1][1] == len(text)
        return time.time() - t

    run(200)
    assert run(8000) < 40 * max(run(400), 0.02)
