"""Types, entities, relations, profiles and file states as set-wise algebra over DataFrames.

Get-or-create is: first row per key among the new, minus keys that exist, united with the old. Aggregations that pick
a first row run map-side first, so a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmill.functions.ids import epoch
from cairnmill.functions.text import ascii_lower
from cairnmill.schemas import PROMOTION_THRESHOLD, SEED_RELATION_TYPES


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id from its parts, the same on every retry."""
    h = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The least row of each key by order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def get_or_create(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows stay as they are; of new keys the first row counts."""
    return old.unionByName(first_per(new, keys, order).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows are replaced, others added; new has each key once."""
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def delete_where(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def seed_relation_types(existing: DataFrame, created_at: str = "0") -> DataFrame:
    """The canonical vocabulary, added where a name is missing."""
    rows = [(n, f"seeded canonical type: {n}", "canonical", created_at) for n in SEED_RELATION_TYPES]
    seeds = existing.sparkSession.createDataFrame(rows, "name string, description string, status string, created_at string")
    seeds = seeds.withColumn("id", stable_id(F.lit("relation-type"), F.col("name")))
    return get_or_create(existing.select("id", "name", "description", "status", "created_at"), seeds, ["name"], [F.col("id")])


def instance_counts(types: DataFrame, instances: DataFrame) -> DataFrame:
    """Types with their live number of instances, zero included. Instances are counted per type before the join."""
    n = instances.groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("n"))
    return types.join(n, "id", "left").withColumn("instance_count", F.coalesce("n", F.lit(0))).drop("n")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """(type_id, hits): distinct files of each type."""
    return hits.filter("type_id is not null and file_path is not null").distinct().groupBy("type_id").agg(F.count("*").alias("hits"))


def promote(types: DataFrame, hits: DataFrame, threshold: int = PROMOTION_THRESHOLD) -> DataFrame:
    """Candidates seen in enough distinct files become canonical; canonical types stay so and record no hits."""
    counted = distinct_hits(hits).withColumnRenamed("type_id", "id")
    status = F.when((F.col("status") == "canonical") | (F.coalesce("hits", F.lit(0)) >= threshold), "canonical").otherwise(F.col("status"))
    return types.join(counted, "id", "left").select(*[status.alias("status") if c == "status" else F.col(c) for c in types.columns], F.coalesce("hits", F.lit(0)).alias("hits"))


def dedupe_relations(relations: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each (type, source, target): the first."""
    return first_per(relations, ["type_id", "source_entity_id", "target_entity_id"], order)


def retype(entities: DataFrame, owners: DataFrame) -> DataFrame:
    """Entities that an owner (canonical_name, type_id, path) of the same name (ASCII case apart) declares get the type of the last owner by path; nothing else changes."""
    own = owners.groupBy(ascii_lower(F.col("canonical_name")).alias("_k")).agg(F.max_by("type_id", F.struct("path", "type_id")).alias("_t"))
    return entities.withColumn("_k", ascii_lower(F.col("canonical_name"))).join(own, "_k", "left").withColumn("type_id", F.coalesce("_t", "type_id")).drop("_k", "_t")


def register_candidate_types(existing: DataFrame, new: DataFrame, created_at: str = "0") -> DataFrame:
    """Relation types (name, description) that aren't known yet, as candidates; known names stay as they are."""
    rows = new.select(stable_id(F.lit("relation-type"), F.col("name")).alias("id"), "name", "description", F.lit("candidate").alias("status"), F.lit(created_at).alias("created_at"))
    return get_or_create(existing.select("id", "name", "description", "status", "created_at"), rows, ["name"], [F.col("description")])


def file_states(indexed: DataFrame) -> DataFrame:
    """The last state of each file."""
    return latest_per(indexed.select("file_path", "content_hash", "indexed_at").filter("file_path is not null"), ["file_path"], [epoch(F.col("indexed_at")), F.col("content_hash")])


def profiles(learned: DataFrame) -> DataFrame:
    """The last profile of each folder and key fingerprint."""
    return latest_per(learned.select("folder_scope", "key_fingerprint", "field_mapping", "learned_at"), ["folder_scope", "key_fingerprint"], [epoch(F.col("learned_at")), F.col("field_mapping")])
