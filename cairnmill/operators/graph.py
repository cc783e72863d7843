"""Neighbourhoods and shortest evidence paths over entities and relations.

Each hop is an equi-join of the frontier with the edges in both directions and an anti-join with what was seen; the
frontier is written to the shared folder between hops. Hops are few (depth is a parameter; paths at most MAX_PATH_DEPTH).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmill.functions.ids import dashed, uuid_hex
from cairnmill.schemas import MAX_PATH_DEPTH
from cairnmill.session import Scratch


def edges(relations: DataFrame) -> DataFrame:
    """Relations with both ends as lower-case ids; rows whose ends are no ids are left out."""
    out = relations.withColumn("source_entity_id", dashed(uuid_hex(F.col("source_entity_id")))).withColumn("target_entity_id", dashed(uuid_hex(F.col("target_entity_id"))))
    return out.filter("source_entity_id is not null and target_entity_id is not null")


def both_ways(e: DataFrame, *keep: str) -> DataFrame:
    """(a, b, ...): each edge from either end."""
    there = e.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"), *keep)
    return there.unionByName(e.select(F.col("target_entity_id").alias("a"), F.col("source_entity_id").alias("b"), *keep))


def direct_relations(e: DataFrame, entity_id: str) -> DataFrame:
    """Relations at either end; one from an entity to itself comes once."""
    return e.filter((F.col("source_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id))


def reach(e: DataFrame, start: str, depth: int) -> DataFrame:
    """(id, depth) of nodes within max(depth, 1) undirected hops, the start left out."""
    spark = e.sparkSession
    s = Scratch(spark)
    steps = s.keep(both_ways(e).distinct(), "steps")  # read once for each hop
    seen = frontier = spark.createDataFrame([(start, 0)], "id string, depth int")
    for d in range(1, max(depth, 1) + 1):
        new = steps.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        frontier = s.keep(new, f"frontier-{d}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def related_entities(entities: DataFrame, e: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Entities reached; ids without an entity are passed through but not returned."""
    return entities.join(reach(e, start, depth), "id")


def shortest_path(e: DataFrame, start: str, end: str, max_depth: int = MAX_PATH_DEPTH) -> DataFrame:
    """(step, relation id, type_id, source_entity_id, target_entity_id, evidence_chunk_id) of one shortest undirected path.

    Edges keep their stored direction. Of parallel edges and equal parents the least relation id counts. No rows if
    there is none within max_depth, or start and end are one.
    """
    spark = e.sparkSession
    s = Scratch(spark)
    edge = F.struct("id", "type_id", "source_entity_id", "target_entity_id", "evidence_chunk_id")
    steps = s.keep(both_ways(e.withColumn("edge", edge), "edge"), "steps")
    found = spark.createDataFrame([(start,)], "id string").withColumn("path", F.array().cast(f"array<{e.select(edge.alias('x')).schema['x'].dataType.simpleString()}>"))
    seen, result = found.select("id"), None
    for d in range(1, max(max_depth, 1) + 1) if start != end else ():
        near = steps.join(found.withColumnRenamed("id", "a"), "a").join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        new = near.groupBy(F.col("b").alias("id")).agg(F.min_by(F.concat("path", F.array("edge")), F.struct(F.concat(F.transform("path", lambda x: x["id"]), F.array(F.col("edge.id"))))).alias("path"))
        found = s.keep(new, f"level-{d}")
        result = found.filter(F.col("id") == end)
        if not result.isEmpty() or found.isEmpty():
            break
        seen = seen.unionByName(found.select("id"))
    if result is None:
        result = found.limit(0)
    return result.select(F.posexplode("path").alias("step", "x")).select("step", "x.*")
