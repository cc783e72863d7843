"""Queries of the general data problems: hierarchies, orphan references, schema drift."""

from __future__ import annotations

from cairnmill.operators import drift, hierarchy, orphans


def queries():
    return {
        "p1_found": hierarchy.found,
        "p1_paths": hierarchy.paths,
        "p1_descendants": hierarchy.descendants,
        "p2_found": orphans.found,
        "p2_report": orphans.report,
        "p3_found": drift.found,
        "p3_table": drift.unified,
        "p3_records": drift.records,
        "p3_lifespans": drift.spans,
    }


def _hex(c: str) -> str:
    uuid = r"^\s*(?:urn:uuid:)?\{?([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})\}?\s*$"
    return f"nullif(replace(regexp_extract(lower({c}), '{uuid}', 1), '-', ''), '')"


def _dashed(c: str) -> str:
    return f"{c}[1:8] || '-' || {c}[9:12] || '-' || {c}[13:16] || '-' || {c}[17:20] || '-' || {c}[21:32]"


_LINKS = f"""
  links AS (
    SELECT type_id, child, arg_min(parent, (coalesce(seen, TIMESTAMP '9999-12-31'), parent)) AS parent
    FROM (SELECT type_id, {_hex("source_entity_id")} AS child, {_hex("target_entity_id")} AS parent, coalesce(recorded_at, arrived_at) AS seen
          FROM relations WHERE type_id IN (SELECT id FROM relation_types WHERE name IN ('part_of', 'implements', 'supersedes', 'refines')))
    WHERE child IS NOT NULL AND parent IS NOT NULL GROUP BY 1, 2),
  walk(type_id, start, node) AS (
    SELECT type_id, child, parent FROM links
    UNION
    SELECT w.type_id, w.start, l.parent FROM walk w JOIN links l ON l.type_id = w.type_id AND l.child = w.node),
  cyc AS (SELECT DISTINCT type_id, start AS id FROM walk WHERE start = node)
"""

_LIVE = """
  live AS (
    SELECT 'relations.target_entity_id' AS ref_field, replace(id, '-', '') AS key FROM (
      SELECT id, arg_max(deleted_at IS NULL, coalesce(try_cast(updated_at AS DOUBLE), -1e300)) AS ok FROM entities GROUP BY id) WHERE ok
    UNION SELECT 'relations.evidence_chunk_id', replace(id, '-', '') FROM (
      SELECT id, arg_max(deleted_at IS NULL, coalesce(try_cast(updated_at AS DOUBLE), -1e300)) AS ok FROM chunks GROUP BY id) WHERE ok
    UNION SELECT 'entities.type_id', replace(id, '-', '') FROM entity_types)
"""

_ORPHANS = f"""
WITH {_LIVE},
  now AS (
    SELECT id, r.type_id AS type_id, r.updated_at AS updated_at FROM (
      SELECT id, arg_max({{'type_id': type_id, 'updated_at': updated_at, 'ok': deleted_at IS NULL}}, coalesce(try_cast(updated_at AS DOUBLE), -1e300)) AS r
      FROM entities GROUP BY id) WHERE r.ok),
  rel AS (SELECT *, coalesce(strftime(min(recorded_at) OVER (PARTITION BY id), '%Y-%m'), 'unknown') AS period FROM relations),
  refs AS (
    SELECT 'relations.target_entity_id' AS ref_field, target_entity_id AS ref, id AS record_id, period FROM rel
    UNION ALL SELECT 'relations.evidence_chunk_id', evidence_chunk_id, id, period FROM rel
    UNION ALL SELECT 'entities.type_id', type_id, id, coalesce(strftime(make_timestamp(cast(try_cast(updated_at AS DOUBLE) * 1000000 AS BIGINT)), '%Y-%m'), 'unknown') FROM now),
  keyed AS (SELECT ref_field, record_id, period, {_hex("ref")} AS key FROM refs WHERE ref IS NOT NULL AND regexp_matches(ref, '\\S')),
  gone AS (SELECT k.* FROM keyed k LEFT JOIN live l ON l.ref_field = k.ref_field AND l.key = k.key WHERE l.key IS NULL)
"""


def oracle_sql():
    return {
        "p1_found": f"WITH RECURSIVE {_LINKS} SELECT type_id, {_dashed('id')} AS entity_id FROM cyc",
        "p1_paths": f"""
WITH RECURSIVE {_LINKS},
  tree AS (
    SELECT n.type_id, n.id, CASE WHEN c.id IS NULL THEN l.parent END AS parent, c.id IS NOT NULL AS on_cycle
    FROM (SELECT type_id, child AS id FROM links UNION SELECT type_id, parent FROM links) n
    LEFT JOIN links l ON l.type_id = n.type_id AND l.child = n.id LEFT JOIN cyc c ON c.type_id = n.type_id AND c.id = n.id),
  down(type_id, id, root, leads, on_cycle, path) AS (
    SELECT type_id, id, id, on_cycle, on_cycle, [{_dashed('id')}] FROM tree WHERE parent IS NULL
    UNION ALL
    SELECT t.type_id, t.id, d.root, d.leads, false, list_append(d.path, {_dashed('t.id')}) FROM down d JOIN tree t ON t.type_id = d.type_id AND t.parent = d.id),
  sizes AS (SELECT type_id, a AS entity_id, count(*) - 1 AS n FROM (SELECT type_id, unnest(path) AS a FROM down) GROUP BY 1, 2)
SELECT d.type_id, {_dashed('d.id')} AS entity_id, CASE WHEN on_cycle THEN 'cycle' WHEN leads THEN 'below_cycle' ELSE 'tree' END AS status,
  len(path) - 1 AS depth, {_dashed('root')} AS root_id, path, s.n AS n_descendants
FROM down d JOIN sizes s ON s.type_id = d.type_id AND s.entity_id = {_dashed('d.id')}""",
        "p3_lifespans": """
WITH r AS (SELECT DISTINCT folder_scope, revision, record_id, file_path, payload FROM frontmatter_records WHERE folder_scope IS NOT NULL AND revision IS NOT NULL),
  revs AS (SELECT folder_scope, revision, row_number() OVER (PARTITION BY folder_scope ORDER BY revision) AS ord FROM (SELECT DISTINCT folder_scope, revision FROM r)),
  k AS (SELECT folder_scope, revision, record_id, unnest(json_keys(payload)) AS key, payload FROM r WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  v AS (SELECT folder_scope, revision, key, count(*) FILTER (json_type(json_extract(payload, '$."' || key || '"')) <> 'NULL') AS n FROM k GROUP BY 1, 2, 3),
  i AS (SELECT v.*, ord - row_number() OVER (PARTITION BY v.folder_scope, key ORDER BY ord) AS island FROM v JOIN revs USING (folder_scope, revision))
SELECT folder_scope, key, min(revision) AS first_revision, max(revision) AS last_revision, CAST(sum(n) AS BIGINT) AS n_values FROM i GROUP BY folder_scope, key, island""",
        "p2_found": f"{_ORPHANS} SELECT DISTINCT ref_field, record_id, period FROM gone",
        "p2_report": f"{_ORPHANS} SELECT ref_field, period, count(*) AS n_references, count(DISTINCT key) AS n_missing_keys FROM (SELECT DISTINCT ref_field, record_id, period, key FROM gone) GROUP BY 1, 2",
    }
