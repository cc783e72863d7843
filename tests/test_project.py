"""A project end to end: incremental sync, tools, state."""

import numpy as np
import pytest

from cairnmill.api import Config, NotFound, Project
from cairnmill.sources.providers import HashedEmbedder, Rejected, RuleExtractor
from cairnmill.sources.state import Conflict, DimensionMismatch, Snapshots


class Fussy(HashedEmbedder):
    def embed(self, texts):
        if any("forbidden" in t for t in texts):
            raise Rejected("no")
        return super().embed(texts)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "tasks").mkdir()
    (root / "tasks" / "TASK-1.md").write_text("---\nid: TASK-1\nkind: task\ndepends_on: [TASK-2]\n---\n\n# Rescan\n\nThe nightly rescan.\n")
    (root / "tasks" / "TASK-2.md").write_text("---\nid: TASK-2\nkind: task\nimplements: PLAN-1\n---\n\n# Journal\n")
    (root / "b.md").write_text("# Bad\n\nforbidden words\n")
    (root / ".cairnmill").mkdir()
    (root / ".cairnmill" / "x.md").write_text("# state\n")
    (root / "c.txt").write_text("no")
    p = Project(spark, str(tmp_path_factory.mktemp("state")), Config(embedder=Fussy(16), embed_partitions=2))
    return p, root


def test_sync_and_tools(project):
    p, root = project
    first = p.sync(str(root))
    assert first["changed"] == 3 and first["skipped"] == 1 and first["indexed"] == p.chunks.count() > 2
    again = p.sync(str(root))
    assert (again["unchanged"], again["changed"], again["deleted"], again["indexed"]) == (3, 0, 0, 0)
    types, relations = p.get_ontology_schema()
    assert {r["name"]: r["instance_count"] for r in types.collect()} == {"task": 2, "unresolved-reference": 1} or {r["name"]: r["instance_count"] for r in types.collect()} == {"task": 2, "spec-item": 0, "unresolved-reference": 1}
    assert {r["name"]: r["instance_count"] for r in relations.collect() if r["instance_count"]} == {"depends_on": 1, "implements": 1}
    e, direct = p.query_by_concept("task-1")
    assert e["canonical_name"] == "TASK-1" and direct.count() == 1
    other = {r["canonical_name"]: r["id"] for r in p.get_related_entities(e["id"], 2).collect()}
    assert set(other) == {"TASK-2", "PLAN-1"}
    assert p.explain_relation(e["id"], other["PLAN-1"]).count() == 2
    with pytest.raises(ValueError, match="invalid entity id"):
        p.get_related_entities("nonsense")
    with pytest.raises(NotFound):
        p.query_by_concept("no such thing")
    assert p.search_hybrid("nightly rescan", 1).first()["content"].startswith("# Rescan")
    answer = p.query_ontological("seeded canonical type: depends_on of TASK-1?")
    assert answer["mode"] == "graph_traversal" and answer["answer"] == "TASK-1 has 1 relation(s) of type 'depends_on'"
    assert p.query_ontological("nothing known here")["mode"] == "vector_fallback"
    assert p.status()["canonical_types"] == 8

    (root / "tasks" / "TASK-1.md").write_text("# Changed\n")
    (root / "b.md").unlink()
    third = p.sync(str(root))
    assert (third["unchanged"], third["changed"], third["deleted"]) == (1, 1, 1)
    assert {r["file_path"].rsplit("/", 1)[1] for r in p.chunks.read().select("file_path").distinct().collect()} == {"TASK-1.md", "TASK-2.md"}


def test_dimension_is_pinned(project, spark):
    p, _ = project
    with pytest.raises(DimensionMismatch):
        p.chunks.ensure(17)
    assert p.chunks.dimension() == 16


def test_stream(project, spark, tmp_path):
    _, root = project
    p = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(8), embed_partitions=2))
    p.sync_stream(str(root), str(tmp_path / "ck"))
    n = p.chunks.count()
    assert n and p.status()["files"] >= 2
    p.sync_stream(str(root), str(tmp_path / "ck"))
    assert p.chunks.count() == n


def test_embedder_is_deterministic():
    a, b = HashedEmbedder(32).embed(["one two", "one two"])
    assert np.array_equal(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6


def test_keys_that_are_not_spelled_as_concepts(spark, tmp_path):
    """Profiles are learnt once for each folder and set of keys, stored, and applied as concept -> key -> value."""
    asked = []

    class Counting(RuleExtractor):
        def concepts(self, keys):
            with open(tmp_path / "asked", "a") as f:
                f.write("x")
            return super().concepts(keys)

    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("---\nidentifier: A\nsort: task\ndepends-on: [B]\n---\n\n# A\n")
    (root / "b.md").write_text("---\nidentifier: B\nsort: plan\ndepends-on: [C]\n---\n\n# B\n")
    p = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(8), extractor=Counting(synonyms={"identifier": "id", "sort": "kind"}), embed_partitions=1))
    p.sync(str(root))
    assert (tmp_path / "asked").read_text() == "x" and p._t("frontmatter_profiles").count() == 1
    names = {r["id"]: r["name"] for r in p._t("entity_types").collect()}
    assert {r["canonical_name"]: names[r["type_id"]] for r in p._t("entities").collect()} == {"A": "task", "B": "plan", "C": "unresolved-reference"}
    assert p._t("relations").count() == 2
    (root / "c.md").write_text("---\nidentifier: C\nsort: task\ndepends-on: []\n---\n\n# C\n")
    p.sync(str(root))
    assert (tmp_path / "asked").read_text() == "x" and asked == []
    names = {r["id"]: r["name"] for r in p._t("entity_types").collect()}
    assert {r["canonical_name"]: names[r["type_id"]] for r in p._t("entities").collect()} == {"A": "task", "B": "plan", "C": "task"}


def test_prose_is_classified(spark, tmp_path):
    """Chunks are searched for names; a type made by one candidate is there for the next; frontmatter's own chunk is left out."""
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("---\nid: X-1\nkind: task\n---\n\nSee TASK-9.\n\n# Prose\n\nRISK-1 and RISK-2 follow.\n")
    (root / "b.md").write_text("# Other\n\nRISK-2 again, and 12-3 is no name.\n")
    p = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(32), extractor=RuleExtractor(), embed_partitions=1, token_budget=8))
    p.sync(str(root))
    names = {r["id"]: r["name"] for r in p._t("entity_types").collect()}
    got = {(r["canonical_name"], names[r["type_id"]], r["first_seen_file"].rsplit("/", 1)[1]) for r in p._t("entities").collect()}
    assert {("RISK-1", "risk", "a.md"), ("RISK-2", "risk", "a.md"), ("X-1", "task", "a.md")} <= got
    assert p.metrics["total"] >= 2 and 0 <= p.fallback_rate() <= 1
    before = p._t("entities").count()
    (root / "b.md").write_text("# Other\n\nRISK-2 once more.\n")
    p.sync(str(root))
    assert p._t("entities").count() == before


def test_candidate_types_and_hits(spark, tmp_path):
    p = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(8)))
    p.register_candidate_type("touches", "one touches another")
    p.register_candidate_type("touches", "again")
    t = p._t("relation_types").filter("name = 'touches'").collect()
    assert len(t) == 1 and t[0]["status"] == "candidate" and t[0]["description"] == "one touches another"
    hits = lambda *files: spark.createDataFrame([(t[0]["id"], f) for f in files], "type_id string, file_path string")
    p.record_hits(hits("a.md", "a.md", "b.md"))
    assert p._t("relation_type_hits").count() == 2 and p._t("relation_types").filter("name = 'touches'").first()["status"] == "candidate"
    p.record_hits(hits("c.md"))
    assert p._t("relation_types").filter("name = 'touches'").first()["status"] == "canonical"


def test_an_edit_rewrites_only_its_buckets(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(30):
        (root / f"{i}.md").write_text(f"# {i}\n\ntext {i}\n")
    p = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(8), files_per_commit=20, embed_partitions=1))
    p.sync(str(root))
    assert p.chunks.count() >= 30 and p.status()["files"] == 30
    before = p.snapshots.manifest()["tables"]["chunks"]
    (root / "7.md").write_text("# 7\n\nother\n")
    p.sync(str(root))
    after = p.snapshots.manifest()["tables"]["chunks"]
    assert sum(before[b] != after[b] for b in after) == 1 and len([b for b in after.values() if b]) > 5


def test_a_crash_between_the_steps_leaves_the_commit_before(spark, tmp_path, monkeypatch):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("---\nid: A\n---\n\n# A\n")
    p = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(8), embed_partitions=1))
    p.sync(str(root))
    (root / "b.md").write_text("---\nid: B\n---\n\n# B\n")
    whole = p.snapshots.stage
    for broken in ("chunks", "entities", "indexed_files"):
        def stage(name, *a, broken=broken, **k):
            got = whole(name, *a, **k)
            if name == broken:
                raise RuntimeError("killed")
            return got

        monkeypatch.setattr(p.snapshots, "stage", stage)
        with pytest.raises(RuntimeError):
            p.sync(str(root))
        q = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(8)))
        assert q.status()["files"] == 1 and q._t("entities").count() == 1 and {r["file_path"].rsplit("/", 1)[1] for r in q.chunks.read().collect()} == {"a.md"}
    monkeypatch.setattr(p.snapshots, "stage", whole)
    assert p.sync(str(root))["changed"] == 1 and p.status()["files"] == 2


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    a, b = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    a.commit(dimension=3)
    old = b.manifest()
    a.commit(x=1)
    monkeypatch.setattr(b, "manifest", lambda: old)
    with pytest.raises(Conflict):
        b.commit(x=2)
    assert a.manifest()["facts"] == {"dimension": 3, "x": 1}
