"""A project: an index of chunks and a registry of types, entities and relations, with its six query tools."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill import schemas
from cairnmill.functions.text import content_hash, like_name
from cairnmill.operators import chunking, classify, frontmatter, graph, registry, router, search, sync
from cairnmill.session import Scratch
from cairnmill.sources import markdown
from cairnmill.sources.providers import Embedder, Extractor, HashedEmbedder, RuleExtractor, embed_distinct, embedding
from cairnmill.sources.state import ChunkStore, Snapshots
from cairnmill.streaming.catchup import catch_up


class NotFound(LookupError):
    pass


class State(Enum):
    STARTING, CATCH_UP_SCAN, READY, DRAINING, STOPPED = range(5)


@dataclass
class Config:
    """extractor: names the concepts of frontmatter keys and finds entities in prose; without one, keys are concepts if spelled alike, and prose is only searched."""

    token_budget: int = schemas.DEFAULT_TOKEN_BUDGET
    embedder: Embedder = field(default_factory=HashedEmbedder)
    extractor: Extractor | None = None
    #: Requests to the embedder at a time; None: by the number of files, at most what the embedder allows.
    embed_partitions: int | None = None
    #: Files whose results are committed together; what is committed isn't done again.
    files_per_commit: int = 100_000


TABLES = {
    "entity_types": (schemas.ENTITY_TYPE, "name"), "relation_types": (schemas.RELATION_TYPE, "name"), "entities": (schemas.ENTITY, "id"),
    "relations": (schemas.RELATION, "id"), "indexed_files": (schemas.INDEXED_FILE, "file_path"), "frontmatter_profiles": (schemas.PROFILE, "id"), "relation_type_hits": (schemas.HIT, "type_id"),
}


class Project:
    def __init__(self, spark: SparkSession, state: str, config: Config | None = None):
        self.state = State.STARTING
        self.spark, self.config = spark, config or Config()
        self.snapshots = Snapshots(spark, state)
        self.chunks = ChunkStore(self.snapshots)
        self.chunks.ensure(self.config.embedder.dimension)
        self.metrics = {"total": 0, "judged": 0}
        self.state = State.READY

    def _t(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self.snapshots.read(name, TABLES[name][0], buckets)

    def _stage(self, name: str, new: DataFrame, merge) -> dict:
        """Stages merge(old rows, new) of the buckets that the keys of new fall into."""
        key = TABLES[name][1]
        buckets = self.snapshots.touched(new, key)
        if not buckets:
            return {}
        old = self._t(name, buckets)
        return self.snapshots.stage(name, merge(old, new).select(*old.columns), key, buckets)

    # ---- ingestion

    def sync(self, root: str) -> dict:
        """Brings the index up to date with a folder; returns counts of indexed and skipped chunks and of files."""
        self.state = State.CATCH_UP_SCAN
        disk = markdown.read(self.spark, root)
        try:
            return self._apply(disk, whole=True)
        finally:
            self.state = State.READY

    def sync_stream(self, root: str, checkpoint: str) -> None:
        catch_up(self.spark, root, checkpoint, lambda df: self._apply(df, whole=False)).awaitTermination()

    def stop(self) -> None:
        self.state = State.DRAINING
        for q in self.spark.streams.active:
            q.awaitTermination(60)
        self.state = State.STOPPED

    def _apply(self, disk: DataFrame, whole: bool) -> dict:
        hashed = disk.withColumn("content_hash", content_hash(F.col("content")))
        known = self._t("indexed_files")
        if not whole:
            known = known.join(hashed.select("file_path"), "file_path", "left_semi")
        changes = Scratch(self.spark).keep(sync.diff(hashed, known), "changes")
        counts = sync.summary(changes).first().asDict()
        total = counts | {"indexed": 0, "skipped": 0}
        if not (counts["changed"] or counts["deleted"]):
            return total
        parts = max(1, -(-(counts["changed"] + counts["deleted"]) // self.config.files_per_commit))
        for k in range(parts):
            these = changes.filter(F.pmod(F.xxhash64("file_path", F.lit("commit")), F.lit(parts)) == k) if parts > 1 else changes
            done = self._commit(hashed, these, -(-counts["changed"] // parts))
            total = total | {n: total[n] + done[n] for n in done}
        return total

    def _commit(self, hashed: DataFrame, changes: DataFrame, n_files: int) -> dict:
        """Chunks, embeddings, frontmatter and prose of some files, and their states, in one commit."""
        now, keep = str(int(time.time())), Scratch(self.spark).keep
        embedder = self.config.embedder
        todo = hashed.join(changes.filter(F.col("status").isin("new", "changed")).select("file_path"), "file_path", "left_semi")
        todo = keep(todo, "todo")
        pieces = chunking.chunk(todo, "file_path", "content", self.config.token_budget)
        cores = self.spark.sparkContext.defaultParallelism
        tasks = self.config.embed_partitions or min(max(cores, n_files // 200), getattr(embedder, "concurrency", None) or 100_000)
        made = keep(pieces.repartition(tasks).withColumn("e", embedding(embedder, F.col("content"))), "made")
        by = {r["s"]: r["n"] for r in made.groupBy(F.col("e.status").alias("s")).agg(F.count("*").alias("n")).collect()}
        new = made.filter("e.status = 'ok'").select(
            registry.stable_id(F.lit("chunk"), F.col("file_path"), F.col("ordinal").cast("string"), content_hash(F.col("content"))).alias("id"),
            "file_path", "content", F.col("e.embedding").alias("embedding"), content_hash(F.col("content")).alias("content_hash"), F.lit(now).alias("updated_at"),
        )
        gone = changes.filter("status <> 'unchanged'").select("file_path")
        staged = [self.chunks.stage(new, gone)]
        parsed = keep(frontmatter.values(todo, "file_path", "content"), "parsed")
        types, entities, others = self._frontmatter(parsed, made, now)
        staged += others
        if self.config.extractor is not None:  # the chunk that holds the frontmatter states its entity already
            prose = made.filter("e.status = 'ok'").join(parsed.select("file_path", F.lit(0).alias("ordinal")), ["file_path", "ordinal"], "left_anti")
            types, entities = self._prose(prose, types, entities, now)
        staged.append(self._stage("entity_types", keep(types, "types"), lambda old, rows: registry.get_or_create(old, rows, ["name"], [F.col("id")])))
        staged.append(self._stage("entities", keep(entities, "entities"), _merge_entities))
        states = changes.filter("status <> 'unchanged'").select("file_path", F.when(F.col("status") != "deleted", F.col("content_hash")).alias("content_hash"), F.lit(now).alias("indexed_at"))
        staged.append(self._stage("indexed_files", states, lambda old, rows: registry.delete_where(old, rows, ["file_path"]).unionByName(rows.filter("content_hash is not null"))))
        self.snapshots.commit(*staged)
        return {"indexed": by.get("ok", 0), "skipped": by.get("rejected", 0)}

    def _frontmatter(self, parsed: DataFrame, made: DataFrame, now: str) -> tuple[DataFrame, DataFrame, list[dict]]:
        """Learned profiles, and what frontmatter states through them: new entity types, entities, and the staged rest."""
        keep, folders = Scratch(self.spark).keep, frontmatter.shapes(parsed, "file_path")
        profiles = self._t("frontmatter_profiles")
        learned = keep(frontmatter.learn_profiles(folders, profiles, self.config.extractor or RuleExtractor(), now), "learned")  # one question for each new shape
        staged = [self._stage("frontmatter_profiles", learned, lambda old, rows: old.unionByName(rows.select(*old.columns)))]
        meant = keep(frontmatter.by_concept(parsed, profiles.unionByName(learned.select(*profiles.columns)), "file_path"), "meant")
        entities, relations = frontmatter.ingest(meant, "file_path")
        types = registry.seed_relation_types(self._t("relation_types"), now)
        staged.append(self._stage("relation_types", types, lambda old, rows: rows))
        kinds = entities.select(F.col("type").alias("name")).distinct().select(registry.stable_id(F.lit("type"), F.col("name")).alias("id"), "name", F.concat(F.lit("frontmatter kind '"), "name", F.lit("'")).alias("description"), F.lit(now).alias("created_at"))
        entities = keep(entities.select("id", registry.stable_id(F.lit("type"), F.col("type")).alias("type_id"), "canonical_name", "first_seen_file", F.lit(now).alias("updated_at")), "stated")
        first = made.filter("ordinal = 0").select(F.col("file_path").alias("evidence_file"), registry.stable_id(F.lit("chunk"), F.col("file_path"), F.lit("0"), content_hash(F.col("content"))).alias("evidence_chunk_id"))
        named = types.select(F.col("name").alias("type"), F.col("id").alias("type_id"))
        rows = relations.join(named, "type").join(first, "evidence_file").select("id", "type_id", "source_entity_id", "target_entity_id", "confidence", "evidence_chunk_id")
        staged.append(self._stage("relations", keep(rows, "rows"), lambda old, new: old.unionByName(new.join(old.select("id"), "id", "left_anti"))))
        return kinds, entities, staged

    def _prose(self, prose: DataFrame, kinds: DataFrame, stated: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
        """Entities named in prose, each of a type that exists, or of one made for it."""
        keep, extractor = Scratch(self.spark).keep, self.config.extractor
        rows = prose.select(F.struct("file_path", F.col("ordinal").alias("chunk")).alias("id"), "content")
        candidates = keep(classify.extract(rows, extractor).select("id.*", "ordinal", "raw_name", "raw_type_hint"), "candidates")
        have = self._t("entity_types").select("name", "description").unionByName(kinds.select("name", "description")).dropDuplicates(["name"])
        names = registry.seed_relation_types(self._t("relation_types"), now).select("name")
        decided = keep(classify.classify_growing(candidates, have, names, self.config.embedder, extractor, ["file_path", "chunk", "ordinal"]), "decided")
        metric = decided.filter("outcome <> 'reserved'").agg(F.count("*").alias("n"), F.count_if("judged").alias("j")).first()
        self.metrics = {"total": self.metrics["total"] + metric["n"], "judged": self.metrics["judged"] + metric["j"]}
        made = decided.filter("description is not null").groupBy(F.col("type").alias("name")).agg(F.min("description").alias("description"))
        made = made.select(registry.stable_id(F.lit("type"), F.col("name")).alias("id"), "name", "description", F.lit(now).alias("created_at"))
        first = candidates.groupBy("raw_name", "raw_type_hint").agg(F.min("file_path").alias("first_seen_file"))
        hint = F.coalesce("raw_type_hint", F.lit("\x00")).alias("hint")
        typed = decided.filter("type is not null").select("raw_name", hint, "type").join(first.select("raw_name", hint, "first_seen_file"), ["raw_name", "hint"])
        found = typed.groupBy("type", "raw_name").agg(F.min("first_seen_file").alias("first_seen_file"))
        found = found.select(registry.stable_id(F.lit("entity"), F.lit("prose"), F.col("type"), F.col("raw_name")).alias("id"), registry.stable_id(F.lit("type"), F.col("type")).alias("type_id"), F.col("raw_name").alias("canonical_name"), "first_seen_file", F.lit(now).alias("updated_at"))
        old = self._t("entities").select("type_id", "canonical_name").unionByName(stated.select("type_id", "canonical_name"))
        found = found.join(old.distinct(), ["type_id", "canonical_name"], "left_anti")  # same type and name: the same entity
        return kinds.unionByName(made.join(kinds.select("name"), "name", "left_anti").select(*kinds.columns)), stated.unionByName(found.select(*stated.columns))

    def fallback_rate(self) -> float:
        """Share of this session's decisions on distinct names that needed the judge."""
        return self.metrics["judged"] / self.metrics["total"] if self.metrics["total"] else 0.0

    def register_candidate_type(self, name: str, description: str = "") -> None:
        new = self.spark.createDataFrame([(name, description)], "name string, description string")
        now = str(int(time.time()))
        rows = registry.register_candidate_types(self._t("relation_types"), new, now)
        self.snapshots.commit(self._stage("relation_types", rows, lambda old, got: got))

    def record_hits(self, hits: DataFrame) -> None:
        """(type_id, file_path): independent sightings; candidates seen in enough files become canonical. Canonical types record none."""
        candidates = self._t("relation_types").filter("status = 'candidate'").select(F.col("id").alias("type_id"))
        new = Scratch(self.spark).keep(hits.select("type_id", "file_path").join(candidates, "type_id", "left_semi").distinct(), "hits")
        if new.isEmpty():
            return
        every = self._t("relation_type_hits").unionByName(new).distinct()
        promoted = registry.promote(self._t("relation_types"), every).drop("hits")
        staged = self._stage("relation_type_hits", new, lambda old, rows: old.unionByName(rows).distinct())
        self.snapshots.commit(staged, self._stage("relation_types", promoted, lambda old, rows: rows))

    # ---- tools

    def search_hybrid(self, query: str, top_k: int = schemas.DEFAULT_TOP_K) -> DataFrame:
        vector = self.config.embedder.embed([query])[0].tolist()
        return search.hybrid(self.chunks.read(), query, vector, top_k).select(F.col("id").alias("chunk_id"), "file_path", "content", "score")

    def query_by_concept(self, concept: str) -> tuple[dict, DataFrame]:
        got = self._t("entities").filter(like_name(F.col("canonical_name"), concept)).orderBy("canonical_name", "id").limit(1).collect()
        if not got:
            raise NotFound("ONTOLOGY.CONCEPT_NOT_FOUND")
        return got[0].asDict(), graph.direct_relations(self._t("relations"), got[0]["id"])

    def get_related_entities(self, entity_id: str, depth: int = 1) -> DataFrame:
        return graph.related_entities(self._t("entities"), graph.edges(self._t("relations")), _uuid(entity_id), depth)

    def get_ontology_schema(self) -> tuple[DataFrame, DataFrame]:
        e = registry.instance_counts(self._t("entity_types"), self._t("entities")).select("name", "instance_count").orderBy("name")
        r = registry.instance_counts(self._t("relation_types"), self._t("relations")).select("name", "status", "instance_count").orderBy("name")
        return e, r

    def explain_relation(self, a: str, b: str) -> DataFrame:
        a, b = _uuid(a), _uuid(b)
        path = graph.shortest_path(graph.edges(self._t("relations")), a, b)
        if a != b and path.isEmpty():
            raise NotFound("ONTOLOGY.PATH_NOT_FOUND")
        return path

    def query_ontological(self, question: str) -> dict:
        q = self.spark.createDataFrame([("q", question)], "question_id string, question string")
        types = embed_distinct(self._t("relation_types"), "description", self.config.embedder)
        asked = q.withColumn("vector", embedding(self.config.embedder, F.col("question"))["embedding"])
        mentioned = router.mentions(q, self._t("entities")).persist()
        routed = router.route(asked, types).persist()
        got = router.answers(q, mentioned, routed, self._t("relations")).first().asDict()
        if got["mode"] == "graph_traversal":
            m, r = mentioned.first(), routed.first()
            rows = graph.direct_relations(self._t("relations"), m["entity_id"]).filter(F.col("type_id") == r["type_id"])
            texts = self.chunks.read().select(F.col("id").alias("evidence_chunk_id"), "content")
            rows = rows.select("evidence_chunk_id").distinct().join(texts, "evidence_chunk_id", "left").orderBy("evidence_chunk_id").limit(MAX_EVIDENCE)
            evidence = [{"chunk_id": x["evidence_chunk_id"], "excerpt": x["content"] or ""} for x in rows.collect()]
            return {"mode": got["mode"], "answer": got["answer"], "evidence": evidence}
        top = self.search_hybrid(question, schemas.FALLBACK_TOP_K).collect()
        return {"mode": "vector_fallback", "answer": top[0]["content"] if top else "no results found", "evidence": [{"chunk_id": t["chunk_id"], "excerpt": t["content"]} for t in top]}

    def status(self) -> dict:
        return {"chunks": self.chunks.count(), "files": self._t("indexed_files").count(), "canonical_types": self._t("relation_types").filter("status = 'canonical'").count(), "dimension": self.chunks.dimension()}


#: Evidence that one answer cites, at most; the number of relations in the answer counts all.
MAX_EVIDENCE = 100


def _merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entities are added; of known ones only the type changes, and only to a real one."""
    placeholder = registry.stable_id(F.lit("type"), F.lit(schemas.PLACEHOLDER_TYPE))
    update = new.filter(F.col("type_id") != placeholder).select("id", F.col("type_id").alias("_t"))
    kept = old.join(update, "id", "left").withColumn("type_id", F.coalesce("_t", "type_id")).drop("_t")
    return kept.unionByName(new.select(*old.columns).join(old.select("id"), "id", "left_anti"))


def to_json(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]


def _uuid(text: str) -> str:
    h = re.sub(r"^\s*(urn:uuid:)?\{?|\}?\s*$", "", text.lower()).replace("-", "")
    if not re.fullmatch(r"[0-9a-f]{32}", h):
        raise ValueError(f"invalid entity id: {text}")
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
