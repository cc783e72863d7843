"""YAML frontmatter: keys, values, fingerprints, and the relations it states, derived set-wise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmill.functions.text import ascii_lower, file_stem, folder_scope
from cairnmill.operators.registry import stable_id
from cairnmill.schemas import DEFAULT_KIND, PLACEHOLDER_TYPE, SEED_RELATION_TYPES

try:
    import yaml
except ImportError:  # reading frontmatter fails then; see parse
    yaml = None

_BLOCK = re.compile(r"﻿?---(.*?)\n---", re.S)


def _loader():
    """A loader that resolves only null, true, false, integers and floats (YAML 1.2 core), and rejects repeated keys."""

    class Core(yaml.SafeLoader):
        pass

    Core.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^[-+]?[0-9]+$", list("-+0123456789")),
        ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", list("-+.0123456789")),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)

    def mapping(loader, node, deep=True):
        keys = [k.value for k, _ in node.value if isinstance(k, yaml.ScalarNode)]
        if len(keys) != len(set(keys)):
            raise yaml.YAMLError("repeated key")
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Core.add_constructor("tag:yaml.org,2002:map", mapping)
    # numbers keep their spelling as text
    Core.add_constructor("tag:yaml.org,2002:int", lambda loader, node: _Number(node.value))
    Core.add_constructor("tag:yaml.org,2002:float", lambda loader, node: _Number(node.value))
    return Core


class _Number(str):
    """A number as it was written."""


_made: list = []


def parse(text: str | None) -> dict | None:
    """The mapping at the head of a file, None if there is none."""
    m = _BLOCK.match(text or "")
    if not m:
        return None
    if yaml is None:
        raise ImportError("frontmatter needs PyYAML")
    if not _made:
        _made.append(_loader())
    try:
        got = yaml.load(m[1], Loader=_made[0])  # noqa: S506 (a safe loader)
    except (yaml.YAMLError, ValueError, RecursionError, TypeError):
        return None
    return {k: v for k, v in got.items() if type(k) is str} if isinstance(got, dict) else None


def strings(value: object) -> list[str]:
    """A string or number as itself, a list's strings and numbers; nothing else."""
    if isinstance(value, str):
        return [str(value)]
    if isinstance(value, list):
        return [str(v) for v in value if isinstance(v, str)]
    return []


def _values(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> dict | None:
        got = parse(t)
        return None if got is None else {k: strings(v) for k, v in got.items()}

    return texts.map(one)


def values(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields map<string, array<string>>) of files that have frontmatter. The cheap test comes before the UDF."""
    some = files.filter(F.col(text).rlike(r"^\x{FEFF}?---"))
    parsed = F.pandas_udf(_values, "map<string,array<string>>")
    return some.select(F.col(key), parsed(F.col(text)).alias("fields")).filter("fields is not null")


def fingerprint(fields) -> F.Column:
    """Hash of the sorted keys, whatever the values."""
    return F.sha2(F.array_join(F.array_sort(F.map_keys(fields)), ","), 256)


def keys(files: DataFrame, key: str, text: str) -> DataFrame:
    return values(files, key, text).select(key, F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys"), fingerprint(F.col("fields")).alias("key_fingerprint"))


def shapes(parsed: DataFrame, path: str) -> DataFrame:
    """(folder_scope, key_fingerprint, keys) of the frontmatter of all files, each once."""
    one = parsed.select(folder_scope(F.col(path)).alias("folder_scope"), fingerprint(F.col("fields")).alias("key_fingerprint"), F.array_sort(F.map_keys("fields")).alias("keys"))
    return one.groupBy("folder_scope", "key_fingerprint").agg(F.min("keys").alias("keys"))


def by_concept(parsed: DataFrame, profiles: DataFrame, path: str) -> DataFrame:
    """(path, fields) with the concepts that the profile of a file's folder and keys gives, instead of the keys: concept -> key -> value.

    Of several keys with one concept the first in alphabetical order counts. Without a profile no key has a concept.
    """
    keyed = parsed.withColumn("folder_scope", folder_scope(F.col(path))).withColumn("key_fingerprint", fingerprint(F.col("fields")))
    known = profiles.select("folder_scope", "key_fingerprint", F.from_json("field_mapping", "map<string,string>").alias("_m"))
    both = keyed.join(known, ["folder_scope", "key_fingerprint"], "left")
    pairs = F.map_entries(F.map_filter(F.coalesce("_m", F.create_map().cast("map<string,string>")), lambda k, c: c.isNotNull() & F.map_contains_key("fields", k)))
    inverted = F.map_from_arrays(
        F.array_distinct(F.transform(pairs, lambda e: e["value"])),
        F.transform(F.array_distinct(F.transform(pairs, lambda e: e["value"])), lambda c: F.array_min(F.transform(F.filter(pairs, lambda e: e["value"] == c), lambda e: e["key"]))),
    )
    return both.withColumn("_i", inverted).select(path, F.transform_values("_i", lambda c, k: F.element_at("fields", k)).alias("fields"))


def statements(parsed: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(owners, links) of by_concept(): owners (path, name, kind), links (path, name, concept, target)."""
    one = lambda k: F.try_element_at(F.try_element_at("fields", F.lit(k)), F.lit(1))
    owners = parsed.select(F.col(path).alias("path"), F.coalesce(one("id"), file_stem(F.col(path))).alias("name"), F.coalesce(one("kind"), F.lit(DEFAULT_KIND)).alias("kind"), "fields")
    concepts = F.array(*[F.lit(c) for c in SEED_RELATION_TYPES])
    listed = F.flatten(F.transform(concepts, lambda c: F.transform(F.coalesce(F.try_element_at("fields", c), F.array().cast("array<string>")), lambda t: F.struct(c.alias("concept"), t.alias("target")))))
    links = owners.select("path", "name", F.explode(listed).alias("l")).select("path", "name", "l.*")
    return owners.drop("fields"), links


def ingest(parsed: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) that the frontmatter of all files states, as reading them in path order would leave them.

    Names equal but for ASCII case are one entity, spelled as first mentioned; its type is the kind of the last file that
    owns it, a placeholder's if none does; first_seen_file is the first file that owns or mentions it. Relations are
    kept once for each (type, source, target), with the first file as evidence.
    """
    owners, links = statements(parsed, path)
    mention = owners.select("path", F.lit(0).alias("o"), "name").unionByName(links.select("path", F.lit(1).alias("o"), F.col("target").alias("name")))
    seen = mention.groupBy(ascii_lower(F.col("name")).alias("k")).agg(F.min_by(F.struct("name", "path"), F.struct("path", "o", "name")).alias("f"))
    kinds = owners.groupBy(ascii_lower(F.col("name")).alias("k")).agg(F.max_by("kind", F.struct("path", "kind")).alias("kind"))
    entities = seen.join(kinds, "k", "left").select("k", stable_id(F.lit("entity"), F.col("k")).alias("id"), F.col("f.name").alias("canonical_name"), F.coalesce("kind", F.lit(PLACEHOLDER_TYPE)).alias("type"), F.col("f.path").alias("first_seen_file"))
    first = links.groupBy("concept", ascii_lower(F.col("name")).alias("s"), ascii_lower(F.col("target")).alias("t")).agg(F.min("path").alias("evidence_file"))
    ids = entities.select("k", "id")
    relations = first.join(ids.select(F.col("k").alias("s"), F.col("id").alias("source_entity_id")), "s").join(ids.select(F.col("k").alias("t"), F.col("id").alias("target_entity_id")), "t")
    relations = relations.select(stable_id(F.lit("relation"), F.col("concept"), F.col("source_entity_id"), F.col("target_entity_id")).alias("id"), F.col("concept").alias("type"), "source_entity_id", "target_entity_id", F.lit(1.0).cast("float").alias("confidence"), "evidence_file")
    return entities.drop("k"), relations


def learn_profiles(shapes: DataFrame, known: DataFrame, extractor, learned_at: str = "0") -> DataFrame:
    """Profiles of (folder_scope, key_fingerprint, keys array<string>) shapes that aren't known, each asked for once."""
    import json

    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: json.dumps(extractor.concepts([str(x) for x in k]), ensure_ascii=False))

    on = ["folder_scope", "key_fingerprint"]
    new = shapes.join(known.select(*on), on, "left_anti").groupBy(*on).agg(F.min("keys").alias("keys"))
    mapping = F.pandas_udf(run, "string")(F.col("keys"))
    return new.select(stable_id(F.lit("profile"), F.col("folder_scope"), F.col("key_fingerprint")).alias("id"), *on, mapping.alias("field_mapping"), F.lit(learned_at).alias("learned_at"))
