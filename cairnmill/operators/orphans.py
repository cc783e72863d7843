"""References to records that do not exist.

Skew-aware split: references are pre-aggregated per key and period before any shuffle on the key; the few keys that
hold a large share of all references are checked and joined by broadcast (their number is bounded by that share), all other
keys by a shuffled anti-join; the orphan counts of both halves are united. The report sums those counts; the rows
of orphans are the references that meet an orphan key.

Defined results: null and blank references are no references; text that isn't a UUID is an orphan; a record
that is repeated counts once, with the month of its earliest time ('unknown' if it has none); empty tables
give no rows; extra columns are ignored. Any repeated or tied row gives the same result as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.functions.ids import epoch, is_blank, uuid_key
from cairnmill.session import Scratch
from cairnmill.sources.tables import current_rows, live_ids, table

#: A key is heavy if it holds at least 1/HEAVY_SHARE of all references, so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 2000


def _ref(field: str, c: Column) -> Column:
    """A struct for a reference, null if the column refers to nothing."""
    return F.when(~is_blank(c), F.struct(F.lit(field).alias("ref_field"), uuid_key(c).alias("key")))


def month(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def relation_refs(relations: DataFrame) -> DataFrame:
    """(ref_field, key, record_id, period), once for each distinct reference of each relation id."""
    kinds = {"relations.target_entity_id": "target_entity_id", "relations.evidence_chunk_id": "evidence_chunk_id"}
    per_id = (
        relations.filter(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("record_id"))
        .agg(
            month(F.min("recorded_at")).alias("period"),
            *[F.collect_set(_ref(f, F.col(c))).alias(f"_{i}") for i, (f, c) in enumerate(kinds.items())],
        )
    )
    return per_id.select("record_id", "period", F.explode(F.concat("_0", "_1")).alias("_r")).select("_r.ref_field", "_r.key", "record_id", "period")


def entity_refs(entities: DataFrame) -> DataFrame:
    now = current_rows(entities, "type_id", "updated_at")
    ref = _ref("entities.type_id", F.col("type_id"))
    at = epoch(F.col("updated_at"))
    return now.select(ref.alias("_r"), F.col("id").alias("record_id"), month(F.when(at > float("-inf"), F.timestamp_seconds(at))).alias("period")).filter("_r is not null").select("_r.ref_field", "_r.key", "record_id", "period")


class Orphans:
    """refs: (ref_field, key, record_id, period), each reference of a record once; live: (ref_field, key). A null key is an orphan."""

    def __init__(self, refs: DataFrame, live: DataFrame, heavy_share: int = HEAVY_SHARE):
        keep, on = Scratch(refs.sparkSession).keep, ["ref_field", "key"]
        self.refs = refs = keep(refs, "refs")
        self.counts = counts = keep(refs.filter("key is not null").groupBy(*on, "period").agg(F.count("*").alias("n")), "counts")  # map side first
        per_key = counts.groupBy(*on).agg(F.sum("n").alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        least = max(1, -(-total // heavy_share))
        self.heavy = heavy = keep(per_key.filter(F.col("n") >= least).select(*on), "heavy")  # at most heavy_share rows
        heavy_live = live.join(F.broadcast(heavy), on, "left_semi").distinct()
        self.heavy_gone = keep(heavy.join(F.broadcast(heavy_live), on, "left_anti"), "heavy-gone")
        light = counts.join(F.broadcast(heavy), on, "left_anti")
        self.light_gone = keep(light.join(live, on, "left_anti"), "light-gone")  # counts per key and period

    def rows(self) -> DataFrame:
        on = ["ref_field", "key"]
        known = self.refs.filter("key is not null")
        light = known.join(F.broadcast(self.heavy), on, "left_anti").join(self.light_gone.select(*on, "period"), [*on, "period"], "left_semi")
        return self.refs.filter("key is null").unionByName(known.join(F.broadcast(self.heavy_gone), on, "left_semi")).unionByName(light)

    def report(self) -> DataFrame:
        """(ref_field, period, n_references, n_missing_keys) from the united counts; references that are no ids have no key."""
        heavy = self.counts.join(F.broadcast(self.heavy_gone), ["ref_field", "key"], "left_semi")
        unread = self.refs.filter("key is null").groupBy("ref_field", "period").agg(F.count("*").alias("n")).select("ref_field", F.lit(None).cast("binary").alias("key"), "period", "n")
        united = self.light_gone.select("ref_field", "key", "period", "n").unionByName(heavy.select("ref_field", "key", "period", "n")).unionByName(unread)
        # each (key, period) is one row of the counts, so keys need no distinct
        return united.groupBy("ref_field", "period").agg(F.sum("n").alias("n_references"), F.count("key").alias("n_missing_keys"))


def live_keys(entities: DataFrame, chunks: DataFrame, types: DataFrame) -> DataFrame:
    def of(ids: DataFrame, field: str) -> DataFrame:
        return ids.select(F.lit(field).alias("ref_field"), uuid_key(F.col("id")).alias("key")).filter("key is not null")

    return (
        of(live_ids(entities), "relations.target_entity_id")
        .unionByName(of(live_ids(chunks), "relations.evidence_chunk_id"))
        .unionByName(of(types, "entities.type_id"))
    )


def of_tables(spark: SparkSession, folder: str) -> Orphans:
    rel = table(spark, folder, "relations").select("id", "target_entity_id", "evidence_chunk_id", "recorded_at")
    ent = table(spark, folder, "entities").select("id", "type_id", "updated_at", "deleted_at")
    chunks = table(spark, folder, "chunks").select("id", "updated_at", "deleted_at")
    types = table(spark, folder, "entity_types").select("id").distinct()
    return Orphans(relation_refs(rel).unionByName(entity_refs(ent)), live_keys(ent, chunks, types))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return of_tables(spark, folder).rows().select("ref_field", "record_id", "period").distinct()


def report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per referring field and month: references and distinct missing keys."""
    return of_tables(spark, folder).report()
