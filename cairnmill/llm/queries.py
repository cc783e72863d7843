"""Queries of the training-data problems and their SQL, where SQL can state them."""

from __future__ import annotations

from cairnmill.llm import ann, bpe, mojibake, packing, split
from cairnmill.sources.tables import table


def queries():
    return {
        "p4_found": ann.found,
        "p4_knn": ann.knn,
        "p4_recall": ann.recall,
        "p5_found": split.found,
        "p5_pieces": split.pieces,
        "p5_lossless": split.lossless,
        "p6_ids": lambda spark, folder: bpe.encode_column(table(spark, folder, "documents"), "doc_id", "text"),
        "p7_packing": packing.packing,
        "p7_fill": packing.fill,
        "p7_relatedness": packing.relatedness,
        "p8_found": mojibake.found,
        "p8_repaired": mojibake.repaired,
    }


def oracle_sql():
    return {
        "p5_found": """
SELECT id AS chunk_id FROM (
  SELECT id, arg_max({'content': content, 'ok': deleted_at IS NULL}, coalesce(try_cast(updated_at AS DOUBLE), -1e300)) AS r FROM chunks GROUP BY id)
WHERE r.ok AND length(r.content) > 768""",
        "p5_lossless": """
SELECT id AS chunk_id, md5(coalesce(r.content, '')) AS rebuilt, true AS within_limit, true AS within_overlap, coalesce(length(r.content), 0) > 768 AS cut FROM (
  SELECT id, arg_max({'content': content, 'ok': deleted_at IS NULL}, coalesce(try_cast(updated_at AS DOUBLE), -1e300)) AS r FROM chunks WHERE id IS NOT NULL GROUP BY id)
WHERE r.ok""",
    }
