"""Operators of the index and the registry on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmill import schemas
from cairnmill.functions import text as tx
from cairnmill.functions.vectors import cosine, vector
from cairnmill.operators import chunking, classify, frontmatter, graph, registry, router, search, sync


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    assert [one(spark, tx.estimated_tokens(F.lit(t))) for t in ("", "abcd", "abcde", "né😀")] == [0, 1, 2, 1]
    assert one(spark, tx.keywords(F.lit("The depends_on, of né GRAPH-vector"))) == ["the", "depends", "né", "graph", "vector"]
    assert one(spark, tx.mention_tokens(F.lit("what is the depends_on relation for TASK-010b?"))) == ["depends_on", "relation", "TASK-010b"]
    assert one(spark, tx.paragraphs(F.lit("a\n\n\nb"))) == ["a\n\n", "\n", "b"] or one(spark, tx.paragraphs(F.lit("a\n\n\nb"))) == ["a\n\n", "\nb"]
    assert one(spark, tx.sentences(F.lit("One. Two!No? x"))) == ["One.", " Two!No?", " x"]
    assert one(spark, tx.hard_cuts(F.lit("x" * 50), 20)) == ["x" * 20, "x" * 20, "x" * 10]
    assert one(spark, tx.hard_cuts(F.lit(""), 20)) == [""]
    assert one(spark, tx.folder_scope(F.lit("a/b/c.md"))) == "a/b" and one(spark, tx.file_stem(F.lit("a/b/c.x.md"))) == "c.x"
    assert one(spark, tx.like_name(F.lit("dependsXon"), "Depends_on")) is True
    assert one(spark, tx.like_name(F.lit("dependsXon"), "Depends_on", literal=True)) is False
    assert one(spark, tx.like_name(F.lit("ÄPFEL"), "äpfel")) is False  # names are folded in ASCII only


def test_cosine_edges(spark):
    a = vector([1.0, 0.0])
    assert one(spark, cosine(a, vector([0.0, 0.0]))) == 0.0 and one(spark, cosine(a, vector([1.0]))) == 0.0
    assert one(spark, cosine(a, vector([2.0, 0.0]))) == pytest.approx(1.0)


def test_keyword_match_displaces_nearer_chunk(spark):
    rows = [(str(i), f"{i}.md", "plain" if i < 2 else "the rescan word", [s + 0.001 * j for j in range(8)]) for i, s in enumerate((1.0, 1.1, 5.0))]
    chunks = spark.createDataFrame(rows, "id string, file_path string, content string, embedding array<float>")
    got = search.hybrid(chunks, "rescan", [1.0 + 0.001 * j for j in range(8)], 2).collect()
    assert {r["id"] for r in got} == {"0", "2"} and all(r["score"] <= 2 / 61 for r in got)


def test_search_skips_unusable_vectors(spark):
    rows = [("a", [1.0, float("nan")]), ("b", None), ("c", [1.0]), ("d", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert [r["id"] for r in search.nearest(df, [0.0, 1.0], 5).collect()] == ["d"]


def test_registry(spark):
    old = spark.createDataFrame([("1", "kept")], "id string, name string")
    new = spark.createDataFrame([("2", "kept"), ("9", "new"), ("3", "new")], "id string, name string")
    assert {tuple(r) for r in registry.get_or_create(old, new, ["name"], [F.col("id")]).collect()} == {("1", "kept"), ("3", "new")}
    assert {tuple(r) for r in registry.upsert(old, spark.createDataFrame([("1", "x"), ("2", "y")], "id string, name string"), ["id"]).collect()} == {("1", "x"), ("2", "y")}
    types = spark.createDataFrame([("t", "mentions", None, "candidate", "0"), ("u", "rare", None, "candidate", "0"), ("c", "causes", "kept", "canonical", "0")], schemas.RELATION_TYPE)
    hits = spark.createDataFrame([("t", f"doc-{i}.md") for i in (0, 1, 2, 2)] + [("u", "doc-0.md")] * 5, schemas.HIT)
    assert {r["name"]: (r["status"], r["hits"]) for r in registry.promote(types, hits).collect()} == {"mentions": ("canonical", 3), "rare": ("candidate", 1), "causes": ("canonical", 0)}
    seeded = registry.seed_relation_types(types)
    again = registry.seed_relation_types(seeded)
    assert seeded.count() == again.count() == 2 + 8 and seeded.filter("name = 'causes'").first()["description"] == "kept"
    counts = registry.instance_counts(types.select("id", "name"), spark.createDataFrame([("t",), ("t",)], "type_id string")).collect()
    assert {r["name"]: r["instance_count"] for r in counts} == {"mentions": 2, "rare": 0, "causes": 0}


def test_retype(spark):
    e = spark.createDataFrame([("1", "ph", "TASK-1", "a.md", "0"), ("2", "ph", "other", "a.md", "0")], schemas.ENTITY)
    got = registry.retype(e, spark.createDataFrame([("task-1", "zeta", "a.md"), ("task-1", "task", "b.md")], "canonical_name string, type_id string, path string"))
    assert {(r["id"], r["type_id"], r["first_seen_file"]) for r in got.collect()} == {("1", "task", "a.md"), ("2", "ph", "a.md")}


def test_words_of_scripts_with_vowel_signs(spark):
    assert one(spark, tx.keywords(F.lit("हिन्दी भाषा, ที่นี่"))) != [] and "भाषा" in one(spark, tx.keywords(F.lit("हिन्दी भाषा")))
    assert search.query_keywords("भाषा depends_on") == ["भाषा", "depends"]
    assert one(spark, tx.mention_tokens(F.lit("what भाषा\u3000TASK-1?"))) == ["भाषा", "TASK-1"]


def test_null_hash_on_disk_is_no_deletion(spark):
    disk = spark.createDataFrame([("a", None), ("b", None)], "file_path string, content_hash string")
    known = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "file_path string, content_hash string")
    assert {(r["file_path"], r["status"]) for r in sync.diff(disk, known).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted")}


def test_no_yaml_is_an_error(monkeypatch):
    monkeypatch.setattr(frontmatter, "yaml", None)
    assert frontmatter.parse("no block") is None
    with pytest.raises(ImportError):
        frontmatter.parse("---\na: 1\n---\n")


def test_growing_vocabulary_is_that_of_the_fold(spark):
    from cairnmill.sources.providers import HashedEmbedder, RuleExtractor

    e, x = HashedEmbedder(32), RuleExtractor()
    rows = [(i, n, h) for i, (n, h) in enumerate([("RISK-1", "risk"), ("risk-item-2", None), ("RISK-1", "risk"), ("depends_on", None), ("PLAN-3", "plan"), ("77-1", None), ("PLAN-4", "plan"), ("type inferred from risk", None)])]
    types = {"task": "things to do", "plan": "a plan of things"}
    got = classify.classify_growing(
        spark.createDataFrame(rows, "i int, raw_name string, raw_type_hint string"), spark.createDataFrame(list(types.items()), "name string, description string"), spark.createDataFrame([("DEPENDS_ON",)], "name string"), e, x, ["i"])
    want, seen = [], set()
    for _, n, h in rows:
        if (n, h) not in seen:
            seen.add((n, h))
            want.append({"raw_name": n, "raw_type_hint": h})
    fold = classify.fold(want, {k: e.embed([v])[0] for k, v in types.items()}, lambda t: e.embed([t])[0], x.judge, {"DEPENDS_ON"})
    assert {(r["raw_name"], r["raw_type_hint"], r["outcome"], r["type"], r["judged"]) for r in got.collect()} == {(d["raw_name"], d["raw_type_hint"], d["outcome"], d["type"], d["judged"]) for d in fold}
    assert {d["outcome"] for d in fold} >= {"new", "reserved"}


def test_diff(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "3")], "file_path string, content_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("gone", "4")], "file_path string, content_hash string")
    d = sync.diff(disk, known)
    assert {r["file_path"]: r["status"] for r in d.collect()} == {"a": "unchanged", "b": "changed", "n": "new", "gone": "deleted"}
    assert sync.summary(d).first().asDict() == {"unchanged": 1, "changed": 2, "deleted": 1}
    assert sync.summary(d.limit(0)).first().asDict() == {"unchanged": 0, "changed": 0, "deleted": 0}


def ids(n):
    return [f"{i:08d}-0000-0000-0000-000000000000" for i in range(n)]


def test_graph(spark):
    x = ids(7)
    rows = [("r1", "t", x[0], x[1], 1.0, "c"), ("r2", "t", x[2], x[1], 1.0, "c"), ("r3", "t", x[2], x[3], 1.0, "c"), ("r0", "u", x[1], x[0], 1.0, "c"), ("r4", "t", x[3], x[3], 1.0, "c"), ("r5", "t", x[5], x[6], 1.0, "c"), ("r6", "t", "bad", x[6], 1.0, "c")]
    e = graph.edges(spark.createDataFrame(rows, schemas.RELATION))
    assert {(r["id"], r["depth"]) for r in graph.reach(e, x[0], 2).collect()} == {(x[1], 1), (x[2], 2)}
    assert {r["id"] for r in graph.reach(e, x[0], 0).collect()} == {x[1]}
    assert graph.reach(e, "nowhere", 3).count() == 0
    path = graph.shortest_path(e, x[0], x[3]).orderBy("step").collect()
    assert [p["id"] for p in path] == ["r0", "r2", "r3"] and path[1]["source_entity_id"] == x[2]
    assert graph.shortest_path(e, x[0], x[5]).count() == 0 and graph.shortest_path(e, x[0], x[0]).count() == 0
    assert graph.shortest_path(e, x[0], x[3], 2).count() == 0
    assert graph.direct_relations(e, x[3]).count() == 2


MD = "# A\ntext\n\n```\n# no heading\n\n\ncode\n```\n\nSetext\n---\n> ## quoted\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nend\n"


def test_sections():
    parts = [MD[a:b] for a, b in chunking.sections(MD)]
    assert "".join(parts) == MD and [p.splitlines()[0] for p in parts] == ["# A", "Setext", "## quoted"]
    _, spans = chunking.scan(MD)
    assert [MD[a:b].split("\n")[0] for a, b in spans] == ["```", "| a | b |"]
    assert chunking.sections("  \n") == [] and len(chunking.sections("no heading")) == 1


def test_budget():
    got = chunking.budgeted("x" * 500, 20)
    assert len(got) > 1 and all(chunking.tokens(c) <= 15 for c, _ in got) and sum(c.count("x") for c, _ in got) == 500
    code = "```\n" + "line\n" * 50 + "```\n"
    assert chunking.budgeted(code, 10) == [(code, "protected")]
    both = "First one here. Second one is here too.\n\n" + code
    assert [h for _, h in chunking.budgeted(both, 10)] == ["sentence", "sentence", "protected"] or "protected" in [h for _, h in chunking.budgeted(both, 10)]
    assert len(chunking.budgeted("a " * 30 + "\r\n\r\n" + "b " * 30, 20)) >= 2


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a", MD), ("b", None), ("c", ""), ("d", " \n")], "k string, t string")
    got = chunking.chunk(df, "k", "t").collect()
    assert [r["k"] for r in got] == ["a"] * 3 and "".join(r["content"] for r in sorted(got, key=lambda r: r["ordinal"])) == MD


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("---\nid: TASK-0042\nkind: task\ndepends_on: [TASK-1, TASK-2]\n---\n\n# b\n", {"id": ["TASK-0042"], "kind": ["task"], "depends_on": ["TASK-1", "TASK-2"]}),
        ("﻿---\na: 1\n---\n", {"a": ["1"]}),
        ("x\n---\na: 1\n---\n", None), ("---\na: 1\n", None), ("---\n---\n", None), ("---\n- a\n---\n", None), ("---\na: [\n---\n", None),
        ("---\nd: [A, 7, true, null]\ne: {a: b}\n---\n", {"d": ["A", "7"], "e": []}),
        ("---\non: 2024-01-01\nx: yes\no: 0123\nt: true\n---\n", {"on": ["2024-01-01"], "x": ["yes"], "o": ["0123"], "t": []}),
        ("---\na: 1\na: 2\n---\n", None), (None, None), ("", None),
    ],
)
def test_frontmatter(text, expected):
    got = frontmatter.parse(text)
    assert (None if got is None else {k: frontmatter.strings(v) for k, v in got.items()}) == expected


def test_frontmatter_ingest(spark):
    files = [("s/TASK-2.md", "---\nid: TASK-2\nkind: task\ndepends_on: [task-1, TASK-9999]\n---\n"), ("s/x.md", "---\nkind: plan\nimplements: TASK-2\n---\n"), ("z/TASK-1.md", "---\nid: TASK-1\nkind: task\n---\n"), ("n.md", "plain")]
    parsed = frontmatter.values(spark.createDataFrame(files, "path string, text string"), "path", "text")
    e, r = frontmatter.ingest(parsed, "path")
    assert {(x["canonical_name"], x["type"], x["first_seen_file"]) for x in e.collect()} == {("TASK-2", "task", "s/TASK-2.md"), ("task-1", "task", "s/TASK-2.md"), ("TASK-9999", "unresolved-reference", "s/TASK-2.md"), ("x", "plan", "s/x.md")}
    assert sorted(x["type"] for x in r.collect()) == ["depends_on", "depends_on", "implements"]


def test_classify(spark):
    types = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "name string, vector array<float>")
    cand = spark.createDataFrame([("x", [2.0, 0.0]), ("y", [1.0, 1.0])], "candidate_id string, vector array<float>")
    got = {r["candidate_id"]: (r["type_name"], round(r["distance"], 6)) for r in classify.nearest_type(cand, types).collect()}
    assert got == {"x": ("a", 0.0), "y": ("a", round(1 - 2**-0.5, 6))}
    assert classify.nearest_type(cand, types.limit(0)).first()["distance"] == 1.0
    z = spark.createDataFrame([(0.05,), (0.15,), (0.25,), (0.9,)], "d double").select(classify.zone(F.col("d")).alias("zone"))
    assert [r["zone"] for r in z.collect()] == ["merge", "merge", "judge", "new"]
    assert classify.fallback_rate(z).first()["fallback_rate"] == 0.25 and classify.fallback_rate(z.limit(0)).first()["fallback_rate"] == 0.0
    ok, no = classify.split_reserved(spark.createDataFrame([("Depends_ON",), ("x",)], "raw_name string"), spark.createDataFrame([("depends_on",)], "name string"))
    assert [r[0] for r in no.collect()] == ["Depends_ON"] and [r[0] for r in ok.collect()] == ["x"]


def test_fold_sees_types_made_before():
    calls = []

    def embed(text):
        calls.append(text)
        return np.array([1.0, 0.0]) if "service" in text else np.array([0.0, 1.0])

    rows = [{"raw_name": "one-service", "raw_type_hint": "service"}, {"raw_name": "two", "raw_type_hint": "service"}, {"raw_name": "causes"}]
    got = classify.fold(rows, {}, embed, lambda n, t: "merge", reserved={"Causes"})
    assert [g["outcome"] for g in got] == ["new", "merge", "reserved"] and got[1]["type"] == "service" and len(calls) == 2


def test_router(spark):
    e = spark.createDataFrame([("1", "TASK-010"), ("2", "TASK-010b"), ("3", "format-spec"), ("4", "long-name-ledger")], "id string, canonical_name string")
    q = spark.createDataFrame([(1, "what is the depends_on relation for task-010b?"), (2, "how does ledger matter"), (3, "for the and"), (4, "")], "question_id int, question string")
    got = {r["question_id"]: r["entity_id"] for r in router.mentions(q, e).collect()}
    assert got == {1: "2", 2: "4"}
    types = spark.createDataFrame([("t", "depends_on", [1.0, 0.0]), ("a", "causes", [1.0, 0.0])], "id string, name string, vector array<float>")
    asked = q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    assert {r["type_name"] for r in router.route(asked, types).collect()} == {"causes"}
    edges = spark.createDataFrame([("r", "a", "2", "3", 1.0, "c")], schemas.RELATION)
    modes = {r["question_id"]: (r["mode"], r["answer"]) for r in router.answers(q, router.mentions(q, e), router.route(asked, types), edges).collect()}
    assert modes[1] == ("graph_traversal", "TASK-010b has 1 relation(s) of type 'causes'") and modes[2][0] == "vector_fallback"


def test_static_classification_and_profiles(spark):
    from cairnmill.sources.providers import HashedEmbedder, RuleExtractor

    class Judge(RuleExtractor):
        def judge(self, name, type_name):
            return "merge"

    chunks = spark.createDataFrame([("a", "TASK-1 and the ledger-gateway-22 for TASK-1"), ("b", None), ("c", "")], "id string, content string")
    cand = classify.extract(chunks, RuleExtractor())
    assert [(r["raw_name"], r["raw_type_hint"]) for r in cand.orderBy("ordinal").collect()] == [("TASK-1", "task"), ("ledger-gateway-22", None)]
    types = spark.createDataFrame([("task", "task"), ("gateway", "one gateway")], "name string, description string")
    reserved = spark.createDataFrame([("Ledger-Gateway-22",)], "name string")
    got = {r["raw_name"]: (r["zone"], r["outcome"], r["type_name"]) for r in classify.classify_static(cand, types, reserved, HashedEmbedder(32), Judge()).collect()}
    assert got == {"TASK-1": ("merge", "merge", "task"), "ledger-gateway-22": ("reserved", "reject", None)}
    mid = classify.classify_static(cand.filter("ordinal = 0"), types, reserved, HashedEmbedder(32), Judge(), low=-1.0).first()
    assert (mid["zone"], mid["outcome"]) == ("judge", "merge")
    shapes = spark.createDataFrame([("s", "f1", ["Depends-On", "x"]), ("s", "f1", ["Depends-On", "x"]), ("s", "f2", ["id"])], "folder_scope string, key_fingerprint string, keys array<string>")
    known = spark.createDataFrame([("s", "f2")], "folder_scope string, key_fingerprint string")
    rows = frontmatter.learn_profiles(shapes, known, RuleExtractor()).collect()
    assert [(r["key_fingerprint"], r["field_mapping"]) for r in rows] == [("f1", '{"Depends-On": "depends_on", "x": null}')]


def test_provider_replies():
    from cairnmill.sources.providers import Unavailable, parse_decision, parse_reply

    assert parse_reply('{"a": 1}') == {"a": 1} and parse_decision('{"decision": "merge"}') == "merge"
    for bad in ("", "[1]", '{"decision": "maybe"}'):
        with pytest.raises(Unavailable):
            parse_decision(bad)
