import json
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from cairnmill.operators.drift import Drift, found, json_type

REC = "record_id bigint, folder_scope string, file_path string, revision int, payload string, key_fingerprint string"
PRO = "folder_scope string, field_mapping string"


def drift(spark, rows, profiles=()):
    recs = [(i, "f", p, rev, x if x is None or isinstance(x, str) else json.dumps(x), "") for i, (p, rev, x) in enumerate(rows)]
    return Drift(spark.createDataFrame(recs, REC), spark.createDataFrame([("f", json.dumps(m)) for m in profiles], PRO))


def changes(d):
    return {(r["revision"], r["change"], r["old_field"], r["new_field"]) for r in d.changes().collect()}


def test_kinds_of_change(spark):
    rows = [(f"{i}.md", 1, {"a": f"v{i}", "b": i, "c": [1], "gone": f"g{i}", "id": f"X{i}"}) for i in range(4)]
    rows += [(f"{i}.md", 3, {"a2": f"v{i}", "b": str(i), "c": [1], "new": i, "key": f"@{i}"}) for i in range(4)]
    d = drift(spark, rows, [{"id": "id", "key": None}, {"key": "id", "a": None}])
    assert changes(d) == {(3, "renamed", "a", "a2"), (3, "retyped", "b", "b"), (3, "removed", "gone", ""), (3, "added", "", "new"), (3, "renamed", "id", "key")}
    fields = {(r["source_key"], r["field"], r["field_type"]) for r in d.table().collect()}
    assert ("a", "a2", "string") in fields and ("id", "id", "string") in fields and ("b", "b", "string") in fields
    assert {r["value"] for r in d.table().filter("source_key = 'b' and revision = 1").collect()} == {'"0"', '"1"', '"2"', '"3"'}


def test_dirt(spark):
    rows = [("a.md", 1, {"k": 1}), ("b.md", 1, None), ("c.md", 1, ""), ("d.md", 1, '{"k": 1'), ("e.md", 1, "[1]"), ("f.md", 1, '{"z": NaN}'), ("a.md", 2, {"k": None}), ("a.md", 2, '{"k": 2} x'), ("a.md", 4, {})]
    assert changes(drift(spark, rows)) == {(4, "removed", "k", "")}


def test_stray_keys_with_equal_values_are_no_rename(spark):
    rows = [(f"{i}.md", 1, {"k": i} | ({"k_": "x"} if i == 0 else {})) for i in range(5)] + [(f"{i}.md", 2, {"k": i} | ({"z2": "x"} if i == 0 else {})) for i in range(5)]
    assert changes(drift(spark, rows)) == {(2, "removed", "k_", ""), (2, "added", "", "z2")}


def test_empty(spark):
    assert changes(drift(spark, [])) == set()


def test_against_plain_counting(spark, sf):
    """Presence and types, recomputed in Python; renames only have to be consistent with both."""
    recs = {tuple(r.values()) for r in pq.read_table(f"{sf}/frontmatter_records.parquet", columns=["folder_scope", "revision", "record_id", "payload"]).to_pylist()}
    held, types = defaultdict(lambda: defaultdict(Counter)), defaultdict(set)
    for f, rev, _, p in recs:
        types[f].add(rev)
        try:
            o = json.loads(p)
        except (TypeError, ValueError):
            continue
        for k, v in o.items() if isinstance(o, dict) else ():
            held[f, rev][k][json_type(v)] += 1
    gone, new, retyped = set(), set(), set()
    for f, revs in types.items():
        order = sorted(revs)
        for a, b in zip(order, order[1:]):
            x, y = held[f, a], held[f, b]
            gone |= {(f, b, k) for k in x if k not in y}
            new |= {(f, b, k) for k in y if k not in x}
            for k in x.keys() & y.keys():
                m, n = ({t for t, c in z[k].items() if t != "null" and c == max(v for u, v in z[k].items() if u != "null")} for z in (x, y))
                if m and n and not m & n:
                    retyped.add((f, b, k))
    got = found(spark, sf).collect()
    assert len(got) == len(set(got))
    old = {(r["folder_scope"], r["revision"], r["old_field"]) for r in got if r["change"] in ("removed", "renamed")}
    fresh = {(r["folder_scope"], r["revision"], r["new_field"]) for r in got if r["change"] in ("added", "renamed")}
    assert old == gone and fresh == new
    assert {(r["folder_scope"], r["revision"], r["old_field"]) for r in got if r["change"] == "retyped"} == retyped
    assert any(r["change"] == "renamed" for r in got)


def test_one_record_shows_a_rename_and_a_new_type(spark):
    """Islands per folder, key and type at the smallest scale; a lone flag is no evidence of a rename."""
    rows = [(1, "f", "f/a.md", 1, '{"ref": "TASK-1", "n": 1, "on": true}'), (2, "f", "f/a.md", 2, '{"link": "TASK-1", "n": "1", "off": true}'), (3, "f", "f/a.md", 4, "{}"), (4, "f", "f/b.md", 4, "{cut")]
    r = spark.createDataFrame(rows, "record_id bigint, folder_scope string, file_path string, revision int, payload string").selectExpr("*", "cast(null as string) as key_fingerprint")
    p = spark.createDataFrame([], "folder_scope string, key_fingerprint string, field_mapping string, learned_at string")
    d = Drift(r, p)
    got = {(x["revision"], x["change"], x["old_field"], x["new_field"]) for x in d.changes().collect()}
    assert got == {(2, "renamed", "ref", "link"), (2, "retyped", "n", "n"), (2, "removed", "on", ""), (2, "added", "", "off"), (4, "removed", "link", ""), (4, "removed", "n", ""), (4, "removed", "off", "")}
    types = {(x["key"], x["type"], x["ord"], x["starts"], x["ends"]) for x in d.typed.collect() if x["key"] == "n"}
    assert types == {("n", "*", 1, False, False), ("n", "*", 2, False, True), ("n", "number", 1, False, True), ("n", "string", 2, True, True)}
    wide = {x["record_id"]: x for x in d.wide().collect()}
    assert set(wide) == {1, 2, 3, 4} and wide[1]["texts"]["link"] == wide[2]["texts"]["link"] == "TASK-1" and wide[4]["payload"] == "{cut" and wide[1]["booleans"]["on"] is True
    assert {x["record_id"]: x["cast"] for x in d.table().collect() if x["field"] is None} == {3: "empty", 4: "unreadable"}
