import random
import uuid
from datetime import datetime

import pytest

from cairnmill.operators.hierarchy import Hierarchy, hierarchy_links

SCHEMA = "type_id string, child binary, parent binary, first_seen timestamp"


def brute(links):
    """Parents picked as the operator says; cycles over all links."""
    first, every = {}, {}
    for t, c, p, at in links:
        if c is None or p is None:
            continue
        every.setdefault((t, c), set()).add(p)
        k = (at or datetime(9999, 12, 31, 23, 59, 59), p)
        first[t, c] = min(first.get((t, c), k), k)
    nodes = {(t, x) for t, c, p, _ in links if c and p for x in (c, p)}
    cyc = set()
    for n in nodes:
        seen, todo = set(), [(n[0], p) for p in every.get(n, ())]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [(x[0], p) for p in every.get(x, ())]
        if n in seen:
            cyc.add(n)
    path = {}
    for n in nodes:
        out, x = [n], n
        while x not in cyc and x in first:
            x = (x[0], first[x][1])
            out.append(x)
        path[n] = [y[1] for y in reversed(out)]
    return nodes, cyc, path


def run(spark, links):
    return Hierarchy(spark.createDataFrame(links, SCHEMA))


def check(spark, links):
    nodes, cyc, path = brute(links)
    h = run(spark, links)
    rows = {(r["type_id"], uuid.UUID(r["entity_id"]).bytes): r for r in h.paths().collect()}
    assert set(rows) == nodes
    below = {}
    for n, p in path.items():
        for x in p[:-1]:
            below.setdefault((n[0], x), set()).add(n[1])
    for n, r in rows.items():
        assert (r["status"] == "cycle") == (n in cyc)
        assert [uuid.UUID(x).bytes for x in r["path"]] == path[n]
        assert r["depth"] == len(path[n]) - 1 and uuid.UUID(r["root_id"]).bytes == path[n][0]
        assert (r["status"] == "below_cycle") == (n not in cyc and (n[0], path[n][0]) in cyc)
        assert r["n_descendants"] == len(below.get(n, ()))
    d = h.descendants().collect()
    place = {(r["type_id"], r["descendant_id"]): (r["chain_id"], r["chain_pos"]) for r in d if not r["hangs"]}
    got = {}
    for (t, e), (c, pos) in place.items():
        got[t, uuid.UUID(e).bytes] = {uuid.UUID(r["descendant_id"]).bytes for r in d if r["type_id"] == t and r["chain_id"] == c and (r["chain_pos"] > pos or r["hangs"] and r["chain_pos"] == pos)}
    assert got == {n: below.get(n, set()) for n in nodes}


def ids(n):
    return [uuid.UUID(int=i + 1).bytes for i in range(n)]


def test_forest_with_cycles(spark):
    rnd = random.Random(3)
    x = ids(60)
    links = [("a", x[i], x[rnd.randrange(max(1, i))], datetime(2024, 1, 1)) for i in range(1, 40)]
    links += [("a", x[40], x[41], None), ("a", x[41], x[42], None), ("a", x[42], x[40], None), ("a", x[43], x[41], None), ("a", x[44], x[43], None), ("a", x[45], x[45], None)]
    links += [("b", x[i + 1], x[i], None) for i in range(30)]  # one long chain
    check(spark, links + links[:9])  # repeated rows


def test_several_parents(spark):
    x = ids(12)
    at = datetime(2024, 1, 1)
    links = [("a", x[1], x[0], at), ("a", x[2], x[1], at), ("a", x[2], x[3], datetime(2023, 1, 1)), ("a", x[3], x[4], at), ("a", x[4], x[2], datetime(2025, 1, 1)), ("a", x[4], x[5], at), ("a", x[6], x[7], at), ("a", x[6], x[8], at)]
    check(spark, links)


def test_star_and_nulls(spark):
    x = ids(200)
    check(spark, [("a", c, x[0], None) for c in x[1:]] + [("a", None, x[0], None), ("a", x[0], None, None)])


def test_empty(spark):
    assert run(spark, []).paths().count() == 0


@pytest.mark.parametrize("spelling", ["{%s}", "urn:uuid:%s", " %s\n", "%s"])
def test_spellings(spark, tmp_path, spelling):
    a, b = str(uuid.UUID(int=1)), str(uuid.UUID(int=2))
    spark.createDataFrame([("t", "part_of", 1)], "id string, name string, extra int").write.parquet(str(tmp_path / "relation_types.parquet"))
    rows = [("t", spelling % a, b.upper(), None, None), ("t", b.replace("-", ""), spelling % a, None, None), ("t", a, "n/a", None, None), ("t", a, "", None, None)]
    spark.createDataFrame(rows, "type_id string, source_entity_id string, target_entity_id string, recorded_at timestamp, arrived_at timestamp").write.parquet(str(tmp_path / "relations.parquet"))
    nodes = Hierarchy(hierarchy_links(spark, str(tmp_path))).nodes.collect()
    assert {uuid.UUID(bytes=bytes(n["id"])).int for n in nodes} == {1, 2} and all(n["on_cycle"] for n in nodes)
