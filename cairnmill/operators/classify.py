"""Classification of candidate entities against entity types."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmill.functions.text import ascii_lower
from cairnmill.functions.vectors import cosine
from cairnmill.schemas import ZONE_HIGH, ZONE_LOW
from cairnmill.session import Scratch

#: More types than this are compared with the candidates in slices; see nearest_type.
MAX_TYPES = 1000


def vocabulary(rows: DataFrame, *columns: str) -> Column:
    """A small checked vocabulary as one constant array of structs, so that it needs no join."""
    got = [r.asDict() for r in rows.select(*columns).collect()]
    kinds = {c: "array<double>" if t.startswith("array") else t for c, t in rows.select(*columns).dtypes}
    plain = [{c: [float(x) for x in r[c]] if kinds[c] == "array<double>" else r[c] for c in columns} for r in got]
    return F.from_json(F.lit(json.dumps(plain)), "array<struct<" + ",".join(f"{c}:{t}" for c, t in kinds.items()) + ">>")


def split_reserved(candidates: DataFrame, relation_types: DataFrame, name: str = "raw_name") -> tuple[DataFrame, DataFrame]:
    """(allowed, reserved): candidates named like a relation type, ASCII case apart, are rejected before any embedding."""
    words = relation_types.select(ascii_lower(F.col("name")).alias("_k")).distinct()
    keyed = candidates.withColumn("_k", ascii_lower(F.col(name)))
    return keyed.join(words, "_k", "left_anti").drop("_k"), keyed.join(words, "_k", "left_semi").drop("_k")


def nearest_type(candidates: DataFrame, types: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, type_name, distance): the type of least cosine distance to each candidate, ties by name; (1.0, null) without types.

    types (name, vector) is a vocabulary; its size is checked, and it becomes one constant, so nothing is
    joined pair by pair. A vocabulary above MAX_TYPES is compared in slices.
    """
    n = types.count()
    if not n:
        return candidates.select(key, F.lit(None).cast("string").alias("type_name"), F.lit(1.0).alias("distance"))
    slices = -(-n // MAX_TYPES)
    out = None
    for k in range(slices):
        part = types.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == k)
        scored = F.transform(vocabulary(part, "name", "vector"), lambda t: F.struct((1 - cosine(F.col("vector"), t["vector"])).alias("distance"), t["name"].alias("type_name")))
        best = candidates.select(key, F.array_min(scored).alias("b"))
        out = best if out is None else out.unionByName(best)
    out = out.groupBy(key).agg(F.min("b").alias("b")) if slices > 1 else out
    return out.select(key, "b.type_name", "b.distance")


def zone(distance: Column, low: float = ZONE_LOW, high: float = ZONE_HIGH) -> Column:
    return F.when(distance <= low, "merge").when(distance >= high, "new").otherwise("judge")


def fallback_rate(decisions: DataFrame) -> DataFrame:
    """Share of decisions that needed the judge; 0.0 of none."""
    judged = (F.col("zone") == "judge").cast("int")
    return decisions.agg(F.count("*").alias("total"), F.coalesce(F.sum(judged), F.lit(0)).alias("judged"), F.coalesce(F.avg(judged), F.lit(0.0)).alias("fallback_rate"))


def fold(candidates: Iterable[dict], types: dict[str, np.ndarray], embed: Callable[[str], np.ndarray], judge: Callable[[str, str], str], reserved: set[str] = frozenset(), low: float = ZONE_LOW, high: float = ZONE_HIGH, grow: dict[str, np.ndarray] | None = None) -> list[dict]:
    """Order-dependent classification: a type made by one candidate is there for the next.

    A sequential fold by nature, so it takes an ordered iterable; each distinct probe text and description is embedded once.
    grow: the vocabulary itself, to be added to; a candidate may bring its own `vector`.
    """
    known, cache, out = dict(types) if grow is None else grow, {}, []
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    blocked = {lower(r) for r in reserved}

    def vector(text: str) -> np.ndarray:
        k = text.strip().lower()
        if k not in cache:
            cache[k] = np.asarray(embed(text), np.float64)
        return cache[k]

    for c in candidates:
        name, hint = c["raw_name"], c.get("raw_type_hint")
        if lower(name) in blocked:
            out.append(c | {"outcome": "reserved", "type": None, "distance": None, "judged": False})
            continue
        best, dist = None, 1.0
        if known:
            v = np.asarray(c["vector"], np.float64) if c.get("vector") is not None else vector(hint or name)
            for t in sorted(known):
                n = np.linalg.norm(v) * np.linalg.norm(known[t])
                d = 1 - (float(v @ known[t] / n) if n else 0.0)
                if best is None or d < dist:
                    best, dist = t, d
        judged = best is not None and low < dist < high
        outcome = "merge" if best is not None and dist <= low else judge(name, best) if judged else "new"
        if outcome == "new":
            best = hint or name
            if best not in known:
                known[best] = np.asarray(embed(f"type inferred from '{name}'"), np.float64)
        out.append(c | {"outcome": outcome, "type": best if outcome in ("merge", "new") else None, "distance": dist, "judged": judged})
    return out


def first_per_label(rows: DataFrame, label: str, key: str) -> DataFrame:
    """The row of least key of each label."""
    w = Window.partitionBy(label).orderBy(key)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def extract(chunks: DataFrame, extractor, key: str = "id", text: str = "content") -> DataFrame:
    """(key, ordinal, raw_name, raw_type_hint): candidates of each chunk. Null, empty and refused chunks have none; an outage of the extractor leaves a chunk without."""
    from cairnmill.sources.providers import Rejected, Unavailable

    def one(t: str | None) -> list[dict]:
        try:
            return [{"raw_name": c["raw_name"], "raw_type_hint": c.get("raw_type_hint")} for c in (extractor.extract(t) if t else [])]
        except (Rejected, Unavailable):
            return []

    found = F.pandas_udf(lambda texts: texts.map(one), "array<struct<raw_name:string,raw_type_hint:string>>")
    return chunks.select(F.col(key), F.posexplode(found(F.col(text))).alias("ordinal", "c")).select(key, "ordinal", "c.*")


#: Decisions of the fold that are written at a time.
WINDOW = 50_000


def classify_growing(candidates: DataFrame, types: DataFrame, relation_types: DataFrame, embedder, extractor, order: list[str], low: float = ZONE_LOW, high: float = ZONE_HIGH) -> DataFrame:
    """Classification against a vocabulary that grows with its own decisions, in the given order of candidates.

    (raw_name, raw_type_hint, outcome, type, distance, judged, description), once for each distinct name and hint, as at
    its first occurrence. The order makes it sequential: extraction, reserved names and embeddings of distinct probe texts are done by
    the executors, and the distinct candidates then stream through the driver, which holds the types only.
    """
    from cairnmill.sources.providers import embed_distinct

    allowed, reserved = split_reserved(candidates, relation_types)
    first = allowed.groupBy("raw_name", "raw_type_hint").agg(F.min(F.struct(*order)).alias("at"))
    probes = embed_distinct(first.withColumn("probe", F.coalesce("raw_type_hint", "raw_name")), "probe", embedder)
    scratch = Scratch(candidates.sparkSession)
    probes = scratch.keep(probes.select("raw_name", "raw_type_hint", "vector", "at").orderBy("at", "raw_name", "raw_type_hint"), "probes")
    described = embed_distinct(types.select("name", F.coalesce("description", F.lit("")).alias("description")), "description", embedder)
    known = {r["name"]: np.asarray(r["vector"], np.float64) for r in described.select("name", "vector").toLocalIterator()}
    one = lambda t: embedder.embed([t])[0]
    schema = "raw_name string, raw_type_hint string, outcome string, type string, distance double, judged boolean, description string"
    out, rows = None, []
    spark = candidates.sparkSession

    def write(n: int) -> None:
        nonlocal out, rows
        part = scratch.keep(spark.createDataFrame(rows, schema), f"decided-{n}")
        out, rows = part if out is None else out.unionByName(part), []

    n = 0
    for r in probes.orderBy("at", "raw_name", "raw_type_hint").toLocalIterator():
        c = {"raw_name": r["raw_name"], "raw_type_hint": r["raw_type_hint"], "vector": r["vector"]}
        d = fold([c], known, one, extractor.judge, low=low, high=high, grow=known)[0]
        made = f"type inferred from '{r['raw_name']}'" if d["outcome"] == "new" else None
        rows.append((r["raw_name"], r["raw_type_hint"], d["outcome"], d["type"], d["distance"], d["judged"], made))
        if len(rows) >= WINDOW:
            n += 1
            write(n)
    write(n + 1)
    rejected = reserved.select("raw_name", "raw_type_hint").distinct().select("raw_name", "raw_type_hint", F.lit("reserved").alias("outcome"), *[F.lit(None).cast(t).alias(c) for c, t in (("type", "string"), ("distance", "double"))], F.lit(False).alias("judged"), F.lit(None).cast("string").alias("description"))
    return out.unionByName(rejected)


def classify_static(candidates: DataFrame, types: DataFrame, relation_types: DataFrame, embedder, extractor, low: float = ZONE_LOW, high: float = ZONE_HIGH) -> DataFrame:
    """Set-wise classification against a vocabulary that doesn't grow meanwhile: (raw_name, raw_type_hint, type_name, distance, zone, outcome).

    types (name, description). Reserved names are rejected first; every distinct probe text and description is embedded
    once; only distinct names of the middle zone are judged.
    """
    from cairnmill.sources.providers import embed_distinct

    allowed, reserved = split_reserved(candidates, relation_types)
    names = allowed.select("raw_name", "raw_type_hint").distinct()
    probes = embed_distinct(names.withColumn("probe", F.coalesce("raw_type_hint", "raw_name")), "probe", embedder).withColumn("candidate_id", F.struct("raw_name", "raw_type_hint"))
    described = embed_distinct(types.select("name", F.coalesce("description", F.lit("")).alias("description")), "description", embedder)
    near = Scratch(candidates.sparkSession).keep(nearest_type(probes, described).withColumn("zone", zone(F.col("distance"), low, high)), "near")

    def run(names: pd.Series, nearest: pd.Series) -> pd.Series:
        return pd.Series([extractor.judge(n, t) for n, t in zip(names, nearest)], dtype=object)

    judged = near.filter("zone = 'judge'").withColumn("outcome", F.pandas_udf(run, "string")(F.col("candidate_id.raw_name"), F.col("type_name")))
    plain = near.filter("zone <> 'judge'").withColumn("outcome", F.col("zone"))
    done = judged.unionByName(plain).select("candidate_id.*", "type_name", "distance", "zone", "outcome")
    rejected = reserved.select("raw_name", "raw_type_hint").distinct().select("raw_name", "raw_type_hint", F.lit(None).cast("string").alias("type_name"), F.lit(None).cast("double").alias("distance"), F.lit("reserved").alias("zone"), F.lit("reject").alias("outcome"))
    return done.unionByName(rejected)
