from cairnmill.operators import orphans


def refs(spark, rows):
    return spark.createDataFrame(rows, "ref_field string, key binary, record_id string, period string")


def test_heavy_and_light_keys_agree(spark):
    rows = [("f", b"hot", f"r{i}", "2024-01") for i in range(3000)] + [("f", b"gone", f"g{i}", "2024-02") for i in range(2500)]
    rows += [("f", bytes([i]), f"l{i}", "2024-03") for i in range(200)] + [("f", None, "bad", "unknown"), ("g", b"hot", "other field", "2024-01")]
    live = spark.createDataFrame([("f", b"hot")] + [("f", bytes([i])) for i in range(0, 200, 2)], "ref_field string, key binary")
    got = {r["record_id"] for r in orphans.Orphans(refs(spark, rows), live, heavy_share=10).rows().collect()}
    assert got == {f"g{i}" for i in range(2500)} | {f"l{i}" for i in range(1, 200, 2)} | {"bad", "other field"}


def test_heavy_keys_at_small_scale_and_report(spark):
    rows = [("f", b"hot", f"r{i}", "2024-01") for i in range(30)] + [("f", b"gone", f"g{i}", f"2024-0{1 + i % 2}") for i in range(20)] + [("f", b"x", "l", "2024-01"), ("f", None, "bad", "2024-01")]
    o = orphans.Orphans(refs(spark, rows), spark.createDataFrame([("f", b"hot")], "ref_field string, key binary"), heavy_share=5)
    assert {bytes(r["key"]) for r in o.heavy.collect()} == {b"hot", b"gone"}
    assert {(r["period"], r["n_references"], r["n_missing_keys"]) for r in o.report().collect()} == {("2024-01", 12, 2), ("2024-02", 10, 1)}
    assert {r["record_id"] for r in o.rows().collect()} == {f"g{i}" for i in range(20)} | {"l", "bad"}


def test_empty(spark):
    live = spark.createDataFrame([], "ref_field string, key binary")
    assert orphans.Orphans(refs(spark, []), live).rows().count() == 0


def test_blank_null_repeated(spark):
    from datetime import datetime

    a = "00000000-0000-0000-0000-000000000001"
    rows = [("r1", " ", None, datetime(2024, 5, 1), 1), ("r1", " ", None, datetime(2024, 3, 1), 2), ("r2", "n/a", a, None, 3), ("r2", "n/a", a, None, 3), (None, "n/a", a, None, 3)]
    rel = spark.createDataFrame(rows, "id string, target_entity_id string, evidence_chunk_id string, recorded_at timestamp, ref_field int")
    got = sorted((r["ref_field"], r["record_id"], r["period"], r["key"] is None) for r in orphans.relation_refs(rel).collect())
    assert got == [("relations.evidence_chunk_id", "r2", "unknown", False), ("relations.target_entity_id", "r2", "unknown", True)]
