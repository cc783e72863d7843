"""Schemas that drift: a catalogue of column lifespans, a report of every change, one consistent table.

A producer is a folder, its files are the revisions of that folder. Every payload is exploded into (key, JSON type,
value hash) once; the catalogue counts them per folder, revision, key and type before any window. Islands per folder, key
and type, over the folder's own numbering of its revisions, give the lifespans: lag and lead tell where one starts and
ends. The pseudo-type '*' stands for the key itself, so that its island starts and ends a column; a column is retyped
where all its types start anew inside its island.
Ends and starts at the same revision are paired as renames by an alias table (key -> concept, from the learned
profiles) and by equal values in the same files; only pairs that share a concept or a value are ever formed.

Defined results: a payload that isn't one complete JSON object (null, cut off, a list, duplicate or trailing text)
counts as absent, though its revision still exists; exact copies of a record count once; a key is present if any
record has it, null values included; types are compared by the most frequent type(s) of non-null values, and
retyped means that the two revisions have none of them in common; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnmill.session import Scratch
from cairnmill.sources.tables import table

#: A rename without a shared concept needs equal values in this share of the rarer key's values, and not all alike unless nearly every value agrees.
#: In a revision of few records a single value is evidence if nearly every record shows it, it is a text, list or object, and no other pair of keys shares it.
MIN_SUPPORT = 0.25
NEARLY_ALL = 0.8

_ROWS = "folder_scope string, revision int, record_id bigint, file_path string, key string, json_type string, value_hash bigint, value string"


def _no_constant(text: str):
    raise ValueError(text)


def _object(text: str | None) -> dict | None:
    try:
        got = json.loads(text, parse_constant=_no_constant)
    except (TypeError, ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def json_type(v: object) -> str:
    if v is None:
        return "null"
    for kind, name in ((bool, "boolean"), (str, "string"), ((int, float), "number"), (list, "array")):
        if isinstance(v, kind):
            return name
    return "object"


def _exploder(values: bool):
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, keys, kinds, hashes, texts = [], [], [], [], []
            for i, payload in enumerate(b["payload"]):
                for k, v in (_object(payload) or {}).items():
                    text = json.dumps(v, sort_keys=True, ensure_ascii=False)
                    at.append(i)
                    keys.append(k.encode("utf-8", "surrogatepass").decode("utf-8", "replace"))
                    kinds.append(json_type(v))
                    hashes.append(int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
                    texts.append(text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if values else None)
            if not at:
                continue
            out = b.drop(columns="payload").iloc[at].reset_index(drop=True)
            yield out.assign(key=keys, json_type=kinds, value_hash=pd.Series(hashes, dtype="int64"), value=pd.Series(texts, dtype=object))

    return explode


def keyed_rows(records: DataFrame, values: bool = False) -> DataFrame:
    """One row for each key of each distinct record."""
    use = records.select("folder_scope", "revision", "record_id", "file_path", "payload").filter("folder_scope is not null and revision is not null").distinct()
    return use.mapInPandas(_exploder(values), _ROWS)


def revisions(records: DataFrame) -> DataFrame:
    """(folder_scope, revision, ord): each folder's revisions in order. The window is over distinct revisions only."""
    w = Window.partitionBy("folder_scope").orderBy("revision")
    return records.select("folder_scope", "revision").filter("folder_scope is not null and revision is not null").distinct().withColumn("ord", F.row_number().over(w)).withColumn("last", F.lead("ord").over(w).isNull())


def catalogue(rows: DataFrame, revs: DataFrame) -> DataFrame:
    """(folder_scope, key, ord, revision, last, n_values, types): what each revision holds of each key."""
    by_type = rows.groupBy("folder_scope", "revision", "key", "json_type").agg(F.count("*").alias("n"))
    value = F.col("json_type") != "null"
    per_key = by_type.groupBy("folder_scope", "revision", "key").agg(
        F.coalesce(F.sum(F.when(value, F.col("n"))), F.lit(0)).alias("n_values"),
        F.max(F.when(value, F.col("n"))).alias("_most"),
        F.collect_list(F.when(value, F.struct("json_type", "n"))).alias("_by"),
    )
    modal = F.array_sort(F.transform(F.filter("_by", lambda x: x["n"] == F.col("_most")), lambda x: x["json_type"]))
    return per_key.withColumn("types", modal).drop("_by", "_most").join(revs, ["folder_scope", "revision"])


#: Stands for a key of any type.
ANY = "*"


def lifespans(cat: DataFrame) -> DataFrame:
    """One row for each revision of each (key, type) and each (key, '*'): its island, and whether it starts or ends one inside the folder's history.

    prev_types are those of the revision before, within the island of '*'.
    """
    typed = cat.withColumn("type", F.explode(F.concat(F.array(F.lit(ANY)), "types")))
    w = Window.partitionBy("folder_scope", "key", "type").orderBy("ord")
    before, after = F.lag("ord").over(w), F.lead("ord").over(w)
    return (
        typed.withColumn("island", F.col("ord") - F.row_number().over(w))
        .withColumn("goes_on", F.coalesce(before == F.col("ord") - 1, F.lit(False)))
        .withColumn("starts", (F.col("ord") > 1) & ~F.col("goes_on"))
        .withColumn("ends", ~F.col("last") & ~F.coalesce(after == F.col("ord") + 1, F.lit(False)))
        .withColumn("prev_types", F.when(F.col("goes_on"), F.lag("types").over(w)))
    )


def retyped(spans: DataFrame) -> DataFrame:
    """(folder_scope, ord, key) where the key goes on, had types and has types, and each of its types starts anew."""
    none_stays = spans.filter(F.col("type") != ANY).groupBy("folder_scope", "ord", "key").agg(F.bool_or("goes_on").alias("stays")).filter("not stays").drop("stays")
    return spans.filter((F.col("type") == ANY) & (F.size("prev_types") > 0)).select("folder_scope", "ord", "key").join(none_stays, ["folder_scope", "ord", "key"], "left_semi")


def _mapping(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"key": k, "concept": v} for k, v in (_object(t) or {}).items() if isinstance(v, str) and v])


def aliases(profiles: DataFrame) -> DataFrame:
    """(folder_scope, key, concept): the concept that most of the folder's profiles give the key (ties: the greatest name); null mappings are no evidence."""
    pairs = profiles.filter("folder_scope is not null").select("folder_scope", F.explode(F.pandas_udf(_mapping, "array<struct<key:string,concept:string>>")("field_mapping")).alias("m")).select("folder_scope", "m.*")
    counted = pairs.groupBy("folder_scope", "key", "concept").agg(F.count("*").alias("n"))
    return counted.groupBy("folder_scope", "key").agg(F.max_by("concept", F.struct("n", "concept")).alias("concept"))


def _match(candidates: pd.Series) -> pd.Series:
    """Best pairs first, each key in one pair."""

    def one(pairs) -> list[dict]:
        old, new, out = set(), set(), []
        for p in sorted(pairs, key=lambda p: (not p["same"], -p["support"], -p["eq"], p["old_field"], p["new_field"])):
            if p["old_field"] not in old and p["new_field"] not in new:
                old.add(p["old_field"])
                new.add(p["new_field"])
                out.append({"old_field": p["old_field"], "new_field": p["new_field"]})
        return out

    return candidates.map(one)


def renames(rows: DataFrame, spans: DataFrame, revs: DataFrame, alias: DataFrame) -> DataFrame:
    """(folder_scope, ord, old_field, new_field): ord is the revision that has the new name."""
    alias = alias.withColumnRenamed("concept", "_c")
    gone = spans.filter("ends").join(alias, ["folder_scope", "key"], "left").select("folder_scope", (F.col("ord") + 1).alias("ord"), F.col("key").alias("old_field"), "revision", F.col("n_values").alias("n_old"), F.col("_c").alias("c_old"))
    new = spans.filter("starts").join(alias, ["folder_scope", "key"], "left").select("folder_scope", "ord", F.col("key").alias("new_field"), "revision", F.col("n_values").alias("n_new"), F.col("_c").alias("c_new"))
    valued = rows.filter("json_type <> 'null'").select("folder_scope", "revision", "file_path", "key", "value_hash", F.col("json_type").isin("string", "array", "object").alias("telling"))
    old_values = valued.withColumnRenamed("key", "old_field").join(gone, ["folder_scope", "revision", "old_field"]).drop("revision")
    new_values = valued.drop("telling").withColumnRenamed("key", "new_field").join(new, ["folder_scope", "revision", "new_field"]).drop("revision")
    cols = ["folder_scope", "ord", "old_field", "new_field", "n_old", "n_new", "c_old", "c_new"]
    by_value = (
        old_values.join(new_values, ["folder_scope", "ord", "file_path", "value_hash"])
        .groupBy(*cols)
        .agg(F.count("*").alias("eq"), F.count_distinct("value_hash").alias("n_distinct"), F.bool_or("telling").alias("telling"))
    )
    by_concept = gone.drop("revision").join(new.drop("revision").withColumn("c_old", F.col("c_new")), ["folder_scope", "ord", "c_old"]).select(*cols, F.lit(0).alias("eq"), F.lit(0).alias("n_distinct"), F.lit(False).alias("telling"))
    pairs = by_value.unionByName(by_concept).groupBy(*cols).agg(F.max("eq").alias("eq"), F.max("n_distinct").alias("n_distinct"), F.bool_or("telling").alias("telling"))
    rivals = [F.sum((F.col("eq") > 0).cast("int")).over(Window.partitionBy("folder_scope", "ord", k)) for k in ("old_field", "new_field")]
    pairs = pairs.withColumn("alone", (rivals[0] == 1) & (rivals[1] == 1))
    support = F.col("eq") / F.greatest(F.lit(1), F.least("n_old", "n_new"))
    same = F.coalesce(F.col("c_old") == F.col("c_new"), F.lit(False))
    held = rows.select("folder_scope", "revision", "record_id", "file_path").distinct().groupBy("folder_scope", "revision").agg(F.count("*").alias("records"))
    held = held.join(revs, ["folder_scope", "revision"]).select("folder_scope", "ord", "records")
    most = held.join(held.select("folder_scope", (F.col("ord") + 1).alias("ord"), F.col("records").alias("_r")), ["folder_scope", "ord"]).select("folder_scope", "ord", F.greatest("records", "_r").alias("most"))
    pairs = pairs.join(most, ["folder_scope", "ord"], "left")
    single = (F.col("eq") >= NEARLY_ALL * F.col("most")) & F.col("telling") & F.col("alone")
    enough = single | (F.col("eq") >= 2) & (support >= MIN_SUPPORT) & ((F.col("n_distinct") >= 2) | (support >= NEARLY_ALL))
    other = F.col("c_old").isNotNull() & F.col("c_new").isNotNull() & ~same
    good = pairs.filter((same | enough) & ~other)
    listed = good.groupBy("folder_scope", "ord").agg(F.collect_list(F.struct("old_field", "new_field", "eq", support.alias("support"), same.alias("same"))).alias("c"))
    return listed.select("folder_scope", "ord", F.explode(F.pandas_udf(_match, "array<struct<old_field:string,new_field:string>>")("c")).alias("m")).select("folder_scope", "ord", "m.*")


class Drift:
    def __init__(self, records: DataFrame, profiles: DataFrame, values: bool = True):
        """values: also keep the values, which table() needs."""
        self.records = records
        keep = Scratch(records.sparkSession).keep
        self.rows = keep(keyed_rows(records, values), "rows")  # payloads are parsed once
        self.revs = keep(revisions(records), "revisions")
        self.typed = keep(lifespans(catalogue(self.rows, self.revs)), "lifespans")
        self.spans = self.typed.filter(F.col("type") == ANY)
        self.alias = keep(aliases(profiles), "aliases")
        self.renamed = keep(renames(self.rows, self.spans, self.revs, self.alias), "renamed")

    def changes(self) -> DataFrame:
        at = self.revs.select("folder_scope", "ord", "revision")
        gone = self.spans.filter("ends").select("folder_scope", (F.col("ord") + 1).alias("ord"), F.col("key").alias("old_field"))
        new = self.spans.filter("starts").select("folder_scope", "ord", F.col("key").alias("new_field"))
        on_old, on_new = ["folder_scope", "ord", "old_field"], ["folder_scope", "ord", "new_field"]
        every = (
            self.renamed.select("folder_scope", "ord", F.lit("renamed").alias("change"), "old_field", "new_field")
            .unionByName(gone.join(self.renamed, on_old, "left_anti").select("folder_scope", "ord", F.lit("removed").alias("change"), "old_field", F.lit("").alias("new_field")))
            .unionByName(new.join(self.renamed, on_new, "left_anti").select("folder_scope", "ord", F.lit("added").alias("change"), F.lit("").alias("old_field"), "new_field"))
            .unionByName(retyped(self.typed).select("folder_scope", "ord", F.lit("retyped").alias("change"), F.col("key").alias("old_field"), F.col("key").alias("new_field")))
        )
        return every.join(at, ["folder_scope", "ord"]).select("folder_scope", "revision", "change", "old_field", "new_field")

    def fields(self) -> DataFrame:
        """(folder_scope, key, island, field, target): the lineage each presence run belongs to, its concept or else its last name, and the type to cast to (that of its last revision)."""
        runs = self.spans.groupBy("folder_scope", "key", "island").agg(F.min("ord").alias("first"), F.max("ord").alias("end"), F.max_by(F.try_element_at("types", F.lit(1)), F.when(F.size("types") > 0, F.col("ord"))).alias("type"))
        runs = runs.join(self.alias, ["folder_scope", "key"], "left")
        listed = runs.groupBy("folder_scope").agg(F.collect_list(F.struct("key", "island", "first", "end", "type", "concept")).alias("runs"))
        links = self.renamed.groupBy("folder_scope").agg(F.collect_list(F.struct("ord", "old_field", "new_field")).alias("links"))
        both = listed.join(links, "folder_scope", "left")
        return both.select("folder_scope", F.explode(F.pandas_udf(_lineages, "array<struct<key:string,island:int,field:string,target:string>>")("runs", "links")).alias("f")).select("folder_scope", "f.*")

    def table(self) -> DataFrame:
        """One row for each key of each record: the lineage's field, its type, and the value cast to it; cast is 'as is', 'cast' or 'failed' (value null then, raw keeps it).

        A record without keys has one row without a field: cast is 'unreadable' or 'empty', and raw the payload.
        """
        where = self.spans.select("folder_scope", "revision", "key", "island").join(self.fields(), ["folder_scope", "key", "island"])
        rows = self.rows.join(where, ["folder_scope", "revision", "key"])
        raw, kind, to = F.col("value"), F.col("json_type"), F.coalesce("target", "json_type")
        scalar = kind.isin("string", "number", "boolean")
        text = F.when(kind == "string", F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)
        cast = (
            F.when(kind == to, raw)
            .when(kind == "null", F.lit(None))
            .when((to == "array"), F.concat(F.lit("["), raw, F.lit("]")))
            .when((to == "string") & scalar, F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2))
            .when((to == "string"), F.to_json(F.array(raw)).substr(F.lit(2), F.length(F.to_json(F.array(raw))) - 2))
            .when((to == "number") & (kind == "string") & text.try_cast("double").isNotNull(), F.trim(text))
            .when((to == "boolean") & (kind == "string") & F.lower(text).isin("true", "yes"), F.lit("true"))
            .when((to == "boolean") & (kind == "string") & F.lower(text).isin("false", "no"), F.lit("false"))
        )
        every = self.records.select("folder_scope", "revision", "record_id", "file_path", "payload").filter("folder_scope is not null and revision is not null").distinct()
        have = self.rows.select("folder_scope", "revision", "record_id", "file_path").distinct()
        same = [every[c].eqNullSafe(have[c]) for c in have.columns]
        without = every.join(have, same, "left_anti").select(
            "folder_scope", "revision", "record_id", "file_path", *[F.lit(None).cast("string").alias(c) for c in ("field", "source_key", "field_type", "value")], F.col("payload").alias("raw"),
            F.when(F.trim("payload").rlike(r"^\{\s*\}$"), "empty").otherwise("unreadable").alias("cast"),
        )
        return without.unionByName(rows.select(
            "folder_scope", "revision", "record_id", "file_path", "field", F.col("key").alias("source_key"), to.alias("field_type"),
            cast.alias("value"), raw.alias("raw"),
            F.when((kind == to) | (kind == "null"), "as is").when(cast.isNotNull(), "cast").otherwise("failed").alias("cast"),
        ))

    def wide(self) -> DataFrame:
        """One row for each record, with its fields by type: texts, numbers, booleans, and lists and objects as JSON; payload where it had no keys."""
        t = self.table()
        key = ["folder_scope", "revision", "record_id", "file_path"]

        def of(kind: str, cast: Column) -> Column:
            chosen = (F.col("field_type") == kind) & F.col("value").isNotNull()
            return F.map_from_entries(F.array_distinct(F.array_sort(F.collect_list(F.when(chosen, F.struct("field", cast.alias("v")))))))

        text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
        # two keys of a record may be one field (an old and a new name side by side): the first in order counts
        first = t.groupBy(*key, "field", "field_type").agg(F.min_by(F.struct("value", "raw"), F.struct("source_key", "raw")).alias("x"), F.min("cast").alias("cast")).select(*key, "field", "field_type", "x.*", "cast")
        return first.groupBy(*key).agg(
            of("string", text).alias("texts"), of("number", F.col("value").try_cast("double")).alias("numbers"), of("boolean", F.col("value").try_cast("boolean")).alias("booleans"),
            of("array", F.col("value")).alias("lists"), of("object", F.col("value")).alias("objects"), F.min(F.when(F.col("field").isNull(), F.col("raw"))).alias("payload"),
        )


def _lineages(runs: pd.Series, links: pd.Series) -> pd.Series:
    """Joins runs that a rename connects; bounded by the keys of one folder, not by its records."""

    def one(rs, ls) -> list[dict]:
        rs = sorted(rs, key=lambda r: (r["first"], r["key"]))
        begins = {(r["key"], r["first"]): i for i, r in enumerate(rs)}
        ends = {(r["key"], r["end"]): i for i, r in enumerate(rs)}
        nxt = {}
        for link in ls if ls is not None else ():
            a, b = ends.get((link["old_field"], link["ord"] - 1)), begins.get((link["new_field"], link["ord"]))
            if a is not None and b is not None:
                nxt[a] = b
        out = []
        for i, r in enumerate(rs):
            concept, j = r["concept"], i
            while j in nxt:
                j = nxt[j]
                concept = concept or rs[j]["concept"]
            out.append({"key": r["key"], "island": int(r["island"]), "field": concept or rs[j]["key"], "target": rs[j]["type"] or r["type"]})
        return out

    return pd.Series([one(r, l) for r, l in zip(runs, links)])


def _drift(spark: SparkSession, folder: str, values: bool = False) -> Drift:
    return Drift(table(spark, folder, "frontmatter_records"), table(spark, folder, "frontmatter_profiles"), values)


def found(spark: SparkSession, folder: str) -> DataFrame:
    return _drift(spark, folder).changes()


def unified(spark: SparkSession, folder: str) -> DataFrame:
    return _drift(spark, folder, True).table()


def records(spark: SparkSession, folder: str) -> DataFrame:
    return _drift(spark, folder, True).wide()


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue: each run of revisions in which a folder has a key."""
    s = _drift(spark, folder).spans
    return s.groupBy("folder_scope", "key", "island").agg(F.min("revision").alias("first_revision"), F.max("revision").alias("last_revision"), F.sum("n_values").alias("n_values")).drop("island")
