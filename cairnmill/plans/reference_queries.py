"""Queries over the index and the registry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.functions import text as tx
from cairnmill.functions.ids import dashed, epoch, uuid_hex
from cairnmill.functions.vectors import usable
from cairnmill.operators import chunking, classify, frontmatter, graph, registry, router, search, sync
from cairnmill.plans.stream_query import STREAM_KNOWN
from cairnmill.schemas import FRONTMATTER_CONCEPTS, STOPWORDS
from cairnmill.session import Scratch
from cairnmill.sources.tables import current_rows, live_ids, table

DIM = 96
QUERY_TEXT = "Which nightly rescan of the type registry reads the evidence excerpt?"
HIT_WORDS = ("registry", "rescan", "evidence", "excerpt", "registry")


def live_chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, folder, "chunks"), *columns)


def live_entities(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "entities"), "type_id", "canonical_name", "first_seen_file", "updated_at")


def the_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each relation id: the first to arrive, ends as ids."""
    rel = table(spark, folder, "relations").select("id", "type_id", "source_entity_id", "target_entity_id", "confidence", "evidence_chunk_id", "arrived_at")
    return graph.edges(registry.first_per(rel, ["id"], [F.col("arrived_at"), F.col("source_entity_id"), F.col("target_entity_id")]))


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The embedding of the first usable chunk."""
    got = live_chunks(spark, folder, "embedding").filter(usable(F.col("embedding"), DIM)).orderBy("id").limit(1).collect()
    return [float(x) for x in got[0]["embedding"]] if got else [0.0] * DIM


def start_entity(spark: SparkSession, folder: str) -> str:
    """The entity with the least id that something refers to by part_of."""
    t = [r[0] for r in table(spark, folder, "relation_types").filter("name = 'part_of'").select("id").collect()]
    got = the_edges(spark, folder).filter(F.col("type_id").isin(t)).agg(F.min("target_entity_id")).first()[0]
    return got or ""


def hybrid_search_top10(spark, folder):
    rows = live_chunks(spark, folder, "file_path", "content", "embedding").withColumn("content", F.coalesce("content", F.lit("")))
    got = search.hybrid(rows, QUERY_TEXT, query_vector(spark, folder), 10)
    return got.select(F.col("id").alias("chunk_id"), "file_path", "hits", "vr", "kr", F.round("score", 9).alias("score"))


def knn(metric: str):
    def run(spark, folder):
        e = table(spark, folder, "embeddings")
        q = [float(x) for x in e.filter("vec_id = 7").first()["embedding"]]
        return search.nearest(e, q, 20, "vec_id", "embedding", metric).select("vec_id", "label", F.round("distance", 6).alias("distance"))

    return run


def keyword_tokens(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", tx.keywords(F.coalesce("text", F.lit(""))).alias("k"))
    return d.select("doc_id", F.size("k").alias("n_words"), F.size(F.array_distinct("k")).alias("n_distinct"), F.md5(F.encode(F.array_join("k", " "), "UTF-8")).alias("words_md5"))


def keyword_hits(spark, folder):
    c = live_chunks(spark, folder, "content")
    return c.select(F.col("id").alias("chunk_id"), tx.hit_count(F.coalesce("content", F.lit("")), list(HIT_WORDS)).alias("hits")).filter("hits > 0")


def token_budget(spark, folder):
    c = live_chunks(spark, folder, "file_path", "content").withColumn("tokens", tx.estimated_tokens(F.coalesce("content", F.lit(""))))
    return c.groupBy("file_path").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("tokens") > 192).cast("int")).alias("over_budget"), F.max("tokens").alias("most"))


def pieces(cut, size=None):
    def run(spark, folder):
        d = table(spark, folder, "documents").filter("text is not null and text <> ''")
        p = d.select("doc_id", cut(F.col("text")).alias("p"))
        return p.select("doc_id", F.size("p").alias("n_pieces"), F.array_max(F.transform("p", F.length)).alias("longest"))

    return run


def markdown_chunks(budget):
    def run(spark, folder):
        d = table(spark, folder, "documents").select("doc_id", "text")
        return chunking.chunk(d, "doc_id", "text", budget).select("doc_id", "ordinal", "how", "tokens", tx.content_hash(F.col("content")).alias("content_hash"))

    return run


#: Keys that the rule extractor is told the meaning of, besides those spelled as concepts.
SYNONYMS = {"owner": "owned_by"}


def parsed(spark, folder):
    """Frontmatter of all documents through learned profiles: concepts instead of keys."""
    keep = Scratch(spark).keep  # parsed once, used several times
    values = keep(frontmatter.values(table(spark, folder, "documents").filter("file_path is not null").select("file_path", "text"), "file_path", "text"), "values")
    return keep(frontmatter.by_concept(values, learned(values), "file_path"), "meant")


def learned(values):
    from cairnmill.sources.providers import RuleExtractor

    none = values.sparkSession.createDataFrame([], "folder_scope string, key_fingerprint string")
    return frontmatter.learn_profiles(frontmatter.shapes(values, "file_path"), none, RuleExtractor(synonyms=SYNONYMS))


def profile_learning(spark, folder):
    """What is learnt from the documents' frontmatter: key=concept pairs of each folder and set of keys."""
    values = frontmatter.values(table(spark, folder, "documents").filter("file_path is not null").select("file_path", "text"), "file_path", "text")
    pairs = F.map_entries(F.map_filter(F.from_json("field_mapping", "map<string,string>"), lambda k, v: v.isNotNull()))
    meant = F.array_join(F.array_sort(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return learned(values).select("folder_scope", "key_fingerprint", meant.alias("meant"))


def frontmatter_keys(spark, folder):
    return frontmatter.keys(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def frontmatter_values(spark, folder):
    v = frontmatter.values(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    return v.select("doc_id", F.explode("fields").alias("key", "v")).select("doc_id", "key", F.array_join("v", "|").alias("field_values"))


def frontmatter_entities(spark, folder):
    return frontmatter.ingest(parsed(spark, folder), "file_path")[0]


def frontmatter_relations(spark, folder):
    return frontmatter.ingest(parsed(spark, folder), "file_path")[1]


KNOWN_AT = 1735689600  # states before are the known ones


def disk(spark, folder):
    """The last states of files that have a live chunk of more than 2,000 characters: the others stand for deleted files."""
    c = live_chunks(spark, folder, "file_path", "content").filter(F.length("content") > 2000).select("file_path").distinct()
    return registry.file_states(table(spark, folder, "indexed_files")).join(c, "file_path", "left_semi")


def known_files(spark, folder):
    return registry.file_states(table(spark, folder, "indexed_files").filter(epoch(F.col("indexed_at")) < KNOWN_AT))


def file_diff(spark, folder):
    return sync.diff(disk(spark, folder), known_files(spark, folder))


def sync_summary(spark, folder):
    return sync.summary(file_diff(spark, folder))


def deleted_files(spark, folder):
    return registry.delete_where(known_files(spark, folder), disk(spark, folder), ["file_path"]).select("file_path")


UPSERT_AT = 1735689600  # later rows are the new ones


def upsert_merge(spark, folder):
    c = table(spark, folder, "chunks").filter("id is not null").select("id", "file_path", "content_hash", "updated_at")
    new = epoch(F.col("updated_at")) >= UPSERT_AT
    order = [epoch(F.col("updated_at"))]
    return registry.upsert(registry.latest_per(c.filter(~new), ["id"], order), registry.latest_per(c.filter(new), ["id"], order), ["id"]).select("id", "file_path", "content_hash")


def delete_by_file(spark, folder):
    gone = file_diff(spark, folder).filter("status in ('changed', 'new')")
    return registry.delete_where(live_chunks(spark, folder, "file_path"), gone, ["file_path"]).groupBy("file_path").agg(F.count("*").alias("n_chunks"))


def relation_dedupe(spark, folder):
    e = the_edges(spark, folder)
    return registry.dedupe_relations(e, [F.col("arrived_at"), F.col("id")]).select("type_id", "source_entity_id", "target_entity_id", "id")


def first_seen_entity(spark, folder):
    e = table(spark, folder, "entities").filter("canonical_name is not null and type_id is not null")
    return registry.first_per(e.select("type_id", "canonical_name", "first_seen_file", "updated_at", "id"), ["type_id", "canonical_name"], [epoch(F.col("updated_at")), F.col("id"), F.col("first_seen_file")]).select("type_id", "canonical_name", "id", "first_seen_file")


def file_states(spark, folder):
    return registry.file_states(table(spark, folder, "indexed_files")).select("file_path", "content_hash")


def profile_lookup(spark, folder):
    p = registry.profiles(table(spark, folder, "frontmatter_profiles"))
    r = table(spark, folder, "frontmatter_records").groupBy("folder_scope", "key_fingerprint").agg(F.count("*").alias("n_records"))
    return r.join(p, ["folder_scope", "key_fingerprint"], "left").groupBy("folder_scope").agg(F.sum("n_records").alias("n_records"), F.sum(F.when(F.col("field_mapping").isNull(), F.col("n_records")).otherwise(0)).alias("n_unknown"))


def type_counts(spark, folder):
    e = live_entities(spark, folder).select(dashed(uuid_hex(F.col("type_id"))).alias("type_id"))
    return registry.instance_counts(table(spark, folder, "entity_types"), e).select("name", "instance_count")


def relation_type_counts(spark, folder):
    return registry.instance_counts(table(spark, folder, "relation_types"), the_edges(spark, folder)).select("name", "status", "instance_count")


def type_hits(spark, folder):
    """(type_id, file_path): files whose chunks are evidence for relations of the type."""
    e = the_edges(spark, folder).select("type_id", uuid_hex(F.col("evidence_chunk_id")).alias("c")).filter("c is not null").distinct()
    c = live_chunks(spark, folder, "file_path").select(F.regexp_replace("id", "-", "").alias("c"), "file_path")
    return e.join(c, "c").select("type_id", "file_path")


def promotion(spark, folder):
    return registry.promote(table(spark, folder, "relation_types").select("id", "name", "status"), type_hits(spark, folder)).select("name", "status", "hits")


def seed_vocabulary(spark, folder):
    t = table(spark, folder, "relation_types").filter("name <> 'causes'")
    return registry.seed_relation_types(t).select("name", "description", "status")


def ontology_schema(spark, folder):
    e = type_counts(spark, folder).select(F.lit("entity").alias("kind"), "name", F.lit("").alias("status"), "instance_count")
    return e.unionByName(relation_type_counts(spark, folder).withColumn("kind", F.lit("relation")).select("kind", "name", "status", "instance_count"))


def entity_name_search(spark, folder):
    return live_entities(spark, folder).filter(tx.like_name(F.col("canonical_name"), "Plan_0")).select("id", "canonical_name").orderBy("canonical_name", "id")


def concept_lookup(spark, folder):
    first = live_entities(spark, folder).filter(tx.like_name(F.col("canonical_name"), "ledger")).orderBy("canonical_name", "id").select(F.col("id").alias("entity_id")).limit(1)
    e = the_edges(spark, folder)
    ends = e.withColumn("entity_id", F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))))
    return ends.join(F.broadcast(first), "entity_id").select("id", "type_id", "source_entity_id", "target_entity_id")  # one row


def neighbourhood(depth):
    def run(spark, folder):
        got = graph.reach(the_edges(spark, folder), start_entity(spark, folder), depth)
        return live_ids(table(spark, folder, "entities")).join(got, "id")

    return run


def path_ends(spark, folder):
    """The start, and the greatest id three hops away."""
    a = start_entity(spark, folder)
    r = graph.reach(the_edges(spark, folder), a, 3)
    return a, r.filter("depth = 3").agg(F.max("id")).first()[0] or a


def shortest_path(spark, folder):
    a, b = path_ends(spark, folder)
    return graph.shortest_path(the_edges(spark, folder), a, b)


def shortest_path_length(spark, folder):
    return shortest_path(spark, folder).agg(F.count("*").alias("n_steps"))


def direct_relations(spark, folder):
    return graph.direct_relations(the_edges(spark, folder), start_entity(spark, folder)).select("id", "type_id", "source_entity_id", "target_entity_id")


def label_types(spark, folder):
    e = table(spark, folder, "embeddings")
    return classify.first_per_label(e, "label", "vec_id").select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("name"), F.col("embedding").alias("vector"))


def nearest_type(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector"))
    return classify.nearest_type(e, label_types(spark, folder)).select("candidate_id", "type_name", F.round("distance", 6).alias("distance"))


def zones(spark, folder):
    """Zones at the default thresholds. Candidates are vectors drawn towards the first of their label, by 0 to 3 times its length."""
    e, first = table(spark, folder, "embeddings"), label_types(spark, folder).withColumnRenamed("vector", "l")
    pull = F.zip_with("embedding", "l", lambda x, y: x.cast("double") + y.cast("double") * (F.col("vec_id") % 4))
    c = e.join(first, F.col("name") == F.concat(F.lit("label-"), F.col("label").cast("string"))).select(F.col("vec_id").alias("candidate_id"), pull.alias("vector"))
    n = classify.nearest_type(c, label_types(spark, folder))
    return n.select("candidate_id", classify.zone(F.round("distance", 9)).alias("zone"))


def zone_counts(spark, folder):
    return zones(spark, folder).groupBy("zone").agg(F.count("*").alias("n"))


def fallback_rate(spark, folder):
    return classify.fallback_rate(zones(spark, folder))


def reserved_reject(spark, folder):
    e = live_entities(spark, folder).select("id", F.col("canonical_name").alias("raw_name"))
    extra = table(spark, folder, "relation_types").select("id", F.upper("name").alias("raw_name"))
    ok, no = classify.split_reserved(e.unionByName(extra), table(spark, folder, "relation_types"))
    return no.select("id", "raw_name", F.lit(True).alias("reserved")).unionByName(ok.filter("raw_name is not null").select("id", "raw_name", F.lit(False).alias("reserved"))).groupBy("reserved").agg(F.count("*").alias("n"), F.min("raw_name").alias("least"), F.max("raw_name").alias("greatest"))


def questions(spark, folder):
    """A question for each relation type and one of the entities, by equal ranks."""
    t = table(spark, folder, "relation_types").select(F.col("name").alias("type_name"))
    names = [r[0] for r in live_entities(spark, folder).filter("canonical_name is not null").select("canonical_name").distinct().orderBy("canonical_name").limit(64).collect()]
    rows = [(i, f"What is the {r[0]} relation for {names[3 * i % len(names)]}, and how does it matter?") for i, r in enumerate(t.orderBy("type_name").collect())] if names else []
    return spark.createDataFrame(rows, "question_id int, question string")


def mention_resolution(spark, folder):
    return router.mentions(questions(spark, folder), live_entities(spark, folder))


def route_question(spark, folder):
    from cairnmill.sources.providers import HashedEmbedder, embed_distinct

    e = HashedEmbedder()
    types = embed_distinct(table(spark, folder, "relation_types").select("id", "name", F.coalesce("description", F.lit("")).alias("description")), "description", e)
    asked = embed_distinct(questions(spark, folder), "question", e)
    return router.route(asked, types).select("question_id", "type_name", F.round("score", 6).alias("score"))


def query_ontological(spark, folder):
    from cairnmill.sources.providers import HashedEmbedder, embed_distinct

    e = HashedEmbedder()
    q = questions(spark, folder)
    types = embed_distinct(table(spark, folder, "relation_types").select("id", "name", F.coalesce("description", F.lit("")).alias("description")), "description", e)
    routed = router.route(embed_distinct(q, "question", e), types)
    return router.answers(q, router.mentions(q, live_entities(spark, folder)), routed, the_edges(spark, folder))


def placeholder_retype(spark, folder):
    """Entities typed anew where frontmatter of a document owns their name."""
    owners, _ = frontmatter.statements(parsed(spark, folder), "file_path")
    types = table(spark, folder, "entity_types").select(F.col("name").alias("kind"), F.col("id").alias("type_id"))
    own = owners.join(types, "kind").select(F.col("name").alias("canonical_name"), "type_id", "path")
    return registry.retype(live_entities(spark, folder).filter("canonical_name is not null"), own).groupBy("type_id").agg(F.count("*").alias("n"))


def classify_candidates(spark, folder):
    """Candidates of all live chunks against the entity types, offline providers."""
    from cairnmill.sources.providers import HashedEmbedder, RuleExtractor

    c = classify.extract(live_chunks(spark, folder, "content"), RuleExtractor())
    got = classify.classify_static(c, table(spark, folder, "entity_types").select("name", "description"), table(spark, folder, "relation_types"), HashedEmbedder(), RuleExtractor())
    return got.groupBy("zone", "outcome").agg(F.count("*").alias("n"))


def learn_profiles(spark, folder):
    """Profiles for the shapes of records that have none."""
    from cairnmill.operators.drift import keyed_rows
    from cairnmill.sources.providers import RuleExtractor

    r = table(spark, folder, "frontmatter_records").filter("key_fingerprint is not null")
    keys = keyed_rows(r).groupBy("record_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    shapes = r.select("record_id", "folder_scope", "key_fingerprint").distinct().join(keys, "record_id").drop("record_id")
    return frontmatter.learn_profiles(shapes, registry.profiles(table(spark, folder, "frontmatter_profiles")), RuleExtractor()).select("folder_scope", "key_fingerprint", "field_mapping")


def stream_catchup(spark, folder):
    """Documents that have a path, written as files by the executors, read by the stream, indexed, and counted."""
    from cairnmill.plans.stream_query import run

    return run(spark, folder)


def queries():
    return {
        "hybrid_search_top10": hybrid_search_top10,
        "knn_l2_top20": knn("l2"),
        "knn_cosine_top20": knn("cosine"),
        "keyword_tokens": keyword_tokens,
        "keyword_hits": keyword_hits,
        "token_budget": token_budget,
        "paragraph_split": pieces(tx.paragraphs),
        "sentence_split": pieces(tx.sentences),
        "hard_cut": pieces(lambda c: tx.hard_cuts(c, 768)),
        "markdown_chunks": markdown_chunks(None),
        "budget_chunks": markdown_chunks(256),
        "frontmatter_keys": frontmatter_keys,
        "frontmatter_values": frontmatter_values,
        "frontmatter_entities": frontmatter_entities,
        "frontmatter_relations": frontmatter_relations,
        "file_diff": file_diff,
        "sync_summary": sync_summary,
        "deleted_files": deleted_files,
        "upsert_merge": upsert_merge,
        "delete_by_file": delete_by_file,
        "relation_dedupe": relation_dedupe,
        "first_seen_entity": first_seen_entity,
        "file_states": file_states,
        "profile_lookup": profile_lookup,
        "profile_learning": profile_learning,
        "type_counts": type_counts,
        "relation_type_counts": relation_type_counts,
        "promotion": promotion,
        "seed_vocabulary": seed_vocabulary,
        "ontology_schema": ontology_schema,
        "entity_name_search": entity_name_search,
        "concept_lookup": concept_lookup,
        "neighbourhood_d1": neighbourhood(1),
        "neighbourhood_d2": neighbourhood(2),
        "neighbourhood_d3": neighbourhood(3),
        "direct_relations": direct_relations,
        "shortest_path": shortest_path,
        "shortest_path_length": shortest_path_length,
        "nearest_type": nearest_type,
        "zone_counts": zone_counts,
        "fallback_rate": fallback_rate,
        "reserved_reject": reserved_reject,
        "mention_resolution": mention_resolution,
        "route_question": route_question,
        "query_ontological": query_ontological,
        "placeholder_retype": placeholder_retype,
        "classify_candidates": classify_candidates,
        "learn_profiles": learn_profiles,
        "stream_catchup": stream_catchup,
    }


_AT = "coalesce(try_cast(updated_at AS DOUBLE), -1e300)"


def _hex(c: str) -> str:
    uuid = r"^\s*(?:urn:uuid:)?\{?([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})\}?\s*$"
    return f"nullif(replace(regexp_extract(lower({c}), '{uuid}', 1), '-', ''), '')"


def _id(c: str) -> str:
    return f"({c}[1:8] || '-' || {c}[9:12] || '-' || {c}[13:16] || '-' || {c}[17:20] || '-' || {c}[21:32])"


_CHUNKS = f"""live_chunks AS (SELECT id, r.* FROM (SELECT id, arg_max({{'file_path': file_path, 'content': content, 'embedding': embedding, 'content_hash': content_hash, 'ok': deleted_at IS NULL}}, {_AT}) AS r FROM chunks WHERE id IS NOT NULL GROUP BY id) WHERE r.ok)"""
_ENTITIES = f"""live_entities AS (SELECT id, r.* FROM (SELECT id, arg_max({{'type_id': type_id, 'canonical_name': canonical_name, 'first_seen_file': first_seen_file, 'ok': deleted_at IS NULL}}, {_AT}) AS r FROM entities WHERE id IS NOT NULL GROUP BY id) WHERE r.ok)"""
_EDGES = f"""edges AS (SELECT id, type_id, arrived_at, evidence_chunk_id, {_id('s')} AS source_entity_id, {_id('t')} AS target_entity_id FROM (
  SELECT *, {_hex('source_entity_id')} AS s, {_hex('target_entity_id')} AS t FROM (
    SELECT * FROM relations QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at, source_entity_id NULLS FIRST, target_entity_id NULLS FIRST) = 1))
  WHERE s IS NOT NULL AND t IS NOT NULL)"""
_START = "start_at AS (SELECT min(target_entity_id) AS id FROM edges WHERE type_id IN (SELECT id FROM relation_types WHERE name = 'part_of'))"
_STATES = "states AS (SELECT file_path, arg_max(content_hash, {'a': coalesce(try_cast(indexed_at AS DOUBLE), -1e300), 'h': content_hash}) AS content_hash FROM indexed_files WHERE file_path IS NOT NULL GROUP BY 1)"
_DISK = "disk AS (SELECT * FROM states WHERE file_path IN (SELECT file_path FROM live_chunks WHERE length(content) > 2000))"
_KNOWN = _STATES.replace("states AS", "known AS").replace("IS NOT NULL", "IS NOT NULL AND try_cast(indexed_at AS DOUBLE) < 1735689600")
_DIFF = f"""{_CHUNKS}, {_STATES}, {_DISK}, {_KNOWN}, diff AS (
  SELECT coalesce(d.file_path, s.file_path) AS file_path, CASE WHEN d.content_hash IS NULL THEN 'deleted' WHEN s.file_path IS NULL THEN 'new' WHEN d.content_hash IS NOT DISTINCT FROM s.content_hash THEN 'unchanged' ELSE 'changed' END AS status, coalesce(d.content_hash, s.content_hash) AS content_hash
  FROM disk d FULL JOIN known s ON d.file_path = s.file_path)"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OK = f"(len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
_D = "CAST({} AS DOUBLE[])"


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({_D.format(a)}, {_D.format(b)}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({_D.format(a)}, {_D.format(b)})"


# vowel signs of Thai are alphabetic; RE2 has no class for that, and the tables hold no other such marks
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}\x{0E31}\x{0E34}-\x{0E3A}\x{0E4D}]'), lambda x: strlen(x) >= 3)"
_NEAREST = f"""label_types AS (SELECT 'label-' || label AS name, embedding AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
  nearest AS (SELECT vec_id AS candidate_id, arg_min(name, {{'d': round(d, 12), 'n': name}}) AS type_name, min(d) AS distance FROM (SELECT e.vec_id, t.name, 1 - {_cos('e.embedding', 't.v')} AS d FROM embeddings e, label_types t) GROUP BY 1),
  pulled AS (SELECT vec_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), lambda p: p[1] + p[2] * (vec_id % 4)) AS w FROM embeddings JOIN label_types ON name = 'label-' || label),
  near AS (SELECT vec_id, min(1 - list_cosine_similarity(w, CAST(t.v AS DOUBLE[]))) AS distance FROM pulled, label_types t GROUP BY 1),
  zoned AS (SELECT vec_id AS candidate_id, CASE WHEN round(distance, 9) <= 0.15 THEN 'merge' WHEN round(distance, 9) >= 0.35 THEN 'new' ELSE 'judge' END AS zone FROM near)"""
_TYPE_COUNTS = f"SELECT t.name, count(e.id) AS instance_count FROM entity_types t LEFT JOIN (SELECT id, {_id(_hex('type_id'))} AS type_id FROM live_entities) e ON e.type_id = t.id GROUP BY t.id, t.name"
_RELATION_COUNTS = "SELECT t.name, t.status, count(e.id) AS instance_count FROM relation_types t LEFT JOIN edges e ON e.type_id = t.id GROUP BY t.id, t.name, t.status"


def _reach(depth: int) -> str:
    return f"""WITH RECURSIVE {_EDGES}, {_START}, both_ways AS (SELECT source_entity_id AS a, target_entity_id AS b FROM edges UNION SELECT target_entity_id, source_entity_id FROM edges),
  walk(id, depth) AS (SELECT id, 0 FROM start_at UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = id WHERE depth < {depth}),
  reach AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0)"""


def _split_count(marked: str) -> str:
    return f"SELECT doc_id, len(p) AS n_pieces, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id, {marked} AS p FROM documents WHERE text IS NOT NULL AND text <> '')"


_BLOCK = r"""blocks AS (SELECT doc_id, regexp_extract(text, '(?s)^\x{FEFF}?---(.*?)\n---', 1) AS block FROM documents WHERE regexp_matches(text, '(?s)^\x{FEFF}?---.*?\n---')),
  fields AS (SELECT doc_id, unnest(regexp_extract_all(block, '(?m)^([A-Za-z_][A-Za-z_-]*):(?:[ ]+.*|\r?)$', 1)) AS key, trim(unnest(regexp_extract_all(block, '(?m)^[A-Za-z_][A-Za-z_-]*:(.*)$', 1)), chr(32) || chr(13)) AS v FROM blocks)"""


def _stable(*parts: str) -> str:
    h = "sha256(" + " || chr(1) || ".join(parts) + ")"
    return f"({h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32])"


_MEANT = _BLOCK.replace("SELECT doc_id, regexp_extract", "SELECT doc_id, file_path, regexp_extract").replace("SELECT doc_id, unnest", "SELECT doc_id, file_path, unnest").replace("WHERE regexp_matches", "WHERE file_path IS NOT NULL AND regexp_matches") + f""",
  meant AS (SELECT *, CASE WHEN c IN ({", ".join(f"'{x}'" for x in FRONTMATTER_CONCEPTS)}) THEN c END AS concept FROM (SELECT *, CASE WHEN key = 'owner' THEN 'owned_by' ELSE trim(regexp_replace(lower(key), '[^a-z]', '_', 'g'), '_') END AS c FROM fields))"""
_INGEST = f"""{_MEANT},
  said AS (SELECT doc_id, file_path AS path, concept, arg_min(v, key) AS v FROM meant WHERE concept IS NOT NULL GROUP BY 1, 2, 3),
  listed AS (SELECT *, CASE WHEN v IN ('true', 'false', 'null', '~', '') OR v = '[]' THEN [] WHEN v LIKE '[%]' THEN string_split(v[2:-2], ', ') ELSE [v] END AS vs FROM said),
  files AS (SELECT DISTINCT doc_id, file_path AS path FROM fields),
  owners AS (SELECT f.doc_id, f.path, coalesce(i.vs[1], regexp_extract(regexp_extract(f.path, '[^/]*$'), '^(.+)\\.[^.]*$', 1)) AS name, coalesce(k.vs[1], 'spec-item') AS kind FROM files f LEFT JOIN listed i ON i.doc_id = f.doc_id AND i.concept = 'id' LEFT JOIN listed k ON k.doc_id = f.doc_id AND k.concept = 'kind'),
  links AS (SELECT o.path, o.name, l.concept, unnest(l.vs) AS target FROM listed l JOIN owners o ON o.doc_id = l.doc_id WHERE l.concept NOT IN ('id', 'kind', 'status')),
  mentions AS (SELECT path, 0 AS o, name FROM owners UNION ALL SELECT path, 1, target FROM links),
  entities_now AS (SELECT m.k, {_stable("'entity'", "m.k")} AS id, f.name AS canonical_name, coalesce(kind, 'unresolved-reference') AS type, f.path AS first_seen_file
    FROM (SELECT {_FOLD.format('name')} AS k, min({{'path': path, 'o': o, 'name': name}}) AS f FROM mentions GROUP BY 1) m
    LEFT JOIN (SELECT {_FOLD.format('name')} AS k, arg_max(kind, {{'p': path, 'k': kind}}) AS kind FROM owners GROUP BY 1) o ON o.k = m.k)"""


def _path() -> str:
    """One shortest path from the start to the greatest id three hops away (itself, if there is none): the least list of relation ids, walked back from the end."""
    return f"""{_reach(3)}, finish AS (SELECT max(id) AS id FROM reach WHERE depth = 3),
  ends AS (SELECT id, source_entity_id AS a, target_entity_id AS b FROM edges UNION ALL SELECT id, target_entity_id, source_entity_id FROM edges),
  levels AS (SELECT id, depth FROM reach UNION ALL SELECT id, 0 FROM start_at),
  back(node, ids, depth) AS (SELECT id, CAST([] AS VARCHAR[]), 3 FROM finish WHERE id IS NOT NULL UNION ALL
    SELECT e.b, list_prepend(e.id, back.ids), back.depth - 1 FROM back JOIN ends e ON e.a = back.node JOIN levels l ON l.id = e.b AND l.depth = back.depth - 1),
  best AS (SELECT min(ids) AS ids FROM back WHERE depth = 0),
  steps AS (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS step FROM best)"""


def oracle_sql():
    hits = " + ".join(f"CAST(contains(lower(coalesce(content, '')), '{w}') AS INT)" for w in HIT_WORDS)
    words = search.query_keywords(QUERY_TEXT)
    query_hits = " + ".join(f"CAST(contains(lower(coalesce(content, '')), '{w}') AS INT)" for w in words)
    return {
        "hybrid_search_top10": f"""WITH {_CHUNKS}, ok AS (SELECT * FROM live_chunks WHERE {_OK}), q AS (SELECT embedding AS v FROM ok ORDER BY id LIMIT 1),
  pool AS (SELECT id, file_path, {query_hits} AS hits, {_l2('embedding', 'v')} AS distance FROM ok, q ORDER BY distance, id LIMIT 40),
  v AS (SELECT *, row_number() OVER (ORDER BY distance, id) - 1 AS vr FROM pool), k AS (SELECT *, row_number() OVER (ORDER BY hits DESC, vr) - 1 AS kr FROM v)
SELECT id AS chunk_id, file_path, hits, vr, kr, round(1 / (61.0 + vr) + 1 / (61.0 + kr), 9) AS score FROM k ORDER BY 1 / (61.0 + vr) + 1 / (61.0 + kr) DESC, vr LIMIT 10""",
        "knn_l2_top20": f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT e.vec_id, e.label, {_l2('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) ORDER BY d, vec_id LIMIT 20",
        "knn_cosine_top20": f"SELECT vec_id, label, round(d, 6) + 0.0 AS distance FROM (SELECT e.vec_id, e.label, 1 - {_cos('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) ORDER BY d, vec_id LIMIT 20",
        "keyword_tokens": f"SELECT doc_id, len(k) AS n_words, len(list_distinct(k)) AS n_distinct, md5(array_to_string(k, ' ')) AS words_md5 FROM (SELECT doc_id, list_transform({_WORDS}, lambda x: lower(x)) AS k FROM documents)",
        "keyword_hits": f"WITH {_CHUNKS} SELECT id AS chunk_id, {hits} AS hits FROM live_chunks WHERE {hits} > 0",
        "token_budget": f"WITH {_CHUNKS}, t AS (SELECT file_path, CAST(ceil(length(coalesce(content, '')) / 4.0) AS BIGINT) AS n FROM live_chunks) SELECT file_path, CAST(sum(n) AS BIGINT) AS tokens, CAST(count(*) FILTER (n > 192) AS BIGINT) AS over_budget, max(n) AS most FROM t GROUP BY 1",
        "paragraph_split": _split_count(r"""(SELECT list_transform(list_zip(c, list_append(c[2:], length(text) + 1)), lambda q: substr(text, q[1], q[2] - q[1])) FROM (SELECT list_prepend(1, list_filter(list_transform(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = chr(10) || chr(10)), lambda i: i + 2), lambda i: i <= length(text))) AS c))"""),
        "sentence_split": _split_count(r"string_split(regexp_replace(text, '([.!?])([ \t\n\r\f])', '\1' || chr(57344) || '\2', 'g'), chr(57344))"),
        "hard_cut": _split_count("list_transform(range(0, greatest(1, CAST(ceil(length(text) / 768.0) AS BIGINT))), lambda i: substr(text, i * 768 + 1, 768))"),
        "frontmatter_keys": f"WITH {_BLOCK} SELECT doc_id, string_agg(key, ',' ORDER BY key) AS keys, sha256(string_agg(key, ',' ORDER BY key)) AS key_fingerprint FROM fields GROUP BY 1",
        "frontmatter_values": f"WITH {_BLOCK} SELECT doc_id, key, CASE WHEN v LIKE '[%]' THEN replace(v[2:-2], ', ', '|') WHEN v IN ('true', 'false', 'null', '~') THEN '' ELSE v END AS field_values FROM fields",
        "file_diff": f"WITH {_DIFF} SELECT * FROM diff",
        "sync_summary": f"WITH {_DIFF} SELECT count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status IN ('changed', 'new')) AS changed, count(*) FILTER (status = 'deleted') AS deleted FROM diff",
        "deleted_files": f"WITH {_DIFF} SELECT file_path FROM diff WHERE status = 'deleted'",
        "upsert_merge": f"""WITH n AS (SELECT id, arg_max({{'f': file_path, 'h': content_hash}}, {_AT}) AS r FROM chunks WHERE id IS NOT NULL AND {_AT} >= {UPSERT_AT} GROUP BY 1), o AS (SELECT id, arg_max({{'f': file_path, 'h': content_hash}}, {_AT}) AS r FROM chunks WHERE id IS NOT NULL AND {_AT} < {UPSERT_AT} GROUP BY 1)
SELECT id, r.f AS file_path, r.h AS content_hash FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n))""",
        "delete_by_file": f"WITH {_DIFF} SELECT file_path, count(*) AS n_chunks FROM live_chunks c WHERE NOT EXISTS (SELECT 1 FROM diff d WHERE d.file_path = c.file_path AND d.status IN ('changed', 'new')) GROUP BY 1",
        "relation_dedupe": f"WITH {_EDGES} SELECT type_id, source_entity_id, target_entity_id, id FROM edges QUALIFY row_number() OVER (PARTITION BY type_id, source_entity_id, target_entity_id ORDER BY arrived_at, id) = 1",
        "first_seen_entity": f"SELECT type_id, canonical_name, id, first_seen_file FROM (SELECT *, {_AT} AS at_ FROM entities WHERE canonical_name IS NOT NULL AND type_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY type_id, canonical_name ORDER BY at_, id, first_seen_file NULLS FIRST) = 1",
        "file_states": f"WITH {_STATES} SELECT * FROM states",
        "profile_lookup": """WITH p AS (SELECT folder_scope, key_fingerprint, arg_max(field_mapping, {'a': coalesce(try_cast(learned_at AS DOUBLE), -1e300), 'm': field_mapping}) AS m FROM frontmatter_profiles GROUP BY 1, 2),
  r AS (SELECT folder_scope, key_fingerprint, count(*) AS n FROM frontmatter_records GROUP BY 1, 2)
SELECT r.folder_scope, CAST(sum(n) AS BIGINT) AS n_records, CAST(coalesce(sum(n) FILTER (m IS NULL), 0) AS BIGINT) AS n_unknown FROM r LEFT JOIN p ON p.folder_scope = r.folder_scope AND p.key_fingerprint = r.key_fingerprint GROUP BY 1""",
        "type_counts": f"WITH {_ENTITIES} {_TYPE_COUNTS}",
        "relation_type_counts": f"WITH {_EDGES} {_RELATION_COUNTS}",
        "promotion": f"""WITH {_EDGES}, {_CHUNKS}, h AS (SELECT type_id, count(DISTINCT file_path) AS hits FROM edges JOIN live_chunks c ON replace(c.id, '-', '') = {_hex('evidence_chunk_id')} GROUP BY 1)
SELECT name, CASE WHEN status = 'canonical' OR coalesce(hits, 0) >= 3 THEN 'canonical' ELSE status END AS status, coalesce(hits, 0) AS hits FROM relation_types t LEFT JOIN h ON h.type_id = t.id""",
        "seed_vocabulary": "SELECT name, description, status FROM relation_types WHERE name <> 'causes' UNION ALL SELECT 'causes', 'seeded canonical type: causes', 'canonical'",
        "ontology_schema": f"WITH {_ENTITIES}, {_EDGES} SELECT 'entity' AS kind, name, '' AS status, instance_count FROM ({_TYPE_COUNTS}) UNION ALL SELECT 'relation', name, status, instance_count FROM ({_RELATION_COUNTS})",
        "entity_name_search": f"WITH {_ENTITIES} SELECT id, canonical_name FROM live_entities WHERE {_FOLD.format('canonical_name')} LIKE '%plan_0%'",
        "concept_lookup": f"""WITH {_ENTITIES}, {_EDGES}, c AS (SELECT id FROM live_entities WHERE {_FOLD.format('canonical_name')} LIKE '%ledger%' ORDER BY canonical_name, id LIMIT 1)
SELECT e.id, e.type_id, e.source_entity_id, e.target_entity_id FROM edges e, c WHERE e.source_entity_id = c.id OR e.target_entity_id = c.id""",
        **{f"neighbourhood_d{d}": f"{_reach(d)}, {_ENTITIES} SELECT r.id, r.depth FROM reach r JOIN live_entities e ON e.id = r.id" for d in (1, 2, 3)},
        "direct_relations": f"WITH {_EDGES}, {_START} SELECT e.id, e.type_id, e.source_entity_id, e.target_entity_id FROM edges e, start_at s WHERE e.source_entity_id = s.id OR e.target_entity_id = s.id",
        "shortest_path_length": f"{_path()} SELECT count(*) AS n_steps FROM steps",
        "shortest_path": f"{_path()} SELECT step, e.id, e.type_id, e.source_entity_id, e.target_entity_id, e.evidence_chunk_id FROM steps JOIN edges e ON e.id = steps.id",
        "profile_learning": f"""WITH {_MEANT} SELECT folder_scope, key_fingerprint, min(meant) AS meant FROM (
  SELECT doc_id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder_scope, sha256(string_agg(key, ',' ORDER BY key)) AS key_fingerprint, coalesce(string_agg(key || '=' || concept, ',' ORDER BY key || '=' || concept) FILTER (concept IS NOT NULL), '') AS meant
  FROM meant GROUP BY doc_id, file_path) GROUP BY 1, 2""",
        "frontmatter_entities": f"WITH {_INGEST} SELECT id, canonical_name, type, first_seen_file FROM entities_now",
        "frontmatter_relations": f"""WITH {_INGEST} SELECT {_stable("'relation'", "concept", "a.id", "b.id")} AS id, concept AS type, a.id AS source_entity_id, b.id AS target_entity_id, CAST(1.0 AS FLOAT) AS confidence, evidence_file
  FROM (SELECT concept, {_FOLD.format('name')} AS s, {_FOLD.format('target')} AS t, min(path) AS evidence_file FROM links GROUP BY 1, 2, 3) f JOIN entities_now a ON a.k = s JOIN entities_now b ON b.k = t""",
        "placeholder_retype": f"""WITH {_INGEST}, {_ENTITIES}, own AS (SELECT {_FOLD.format('o.name')} AS k, arg_max(t.id, {{'p': path, 't': t.id}}) AS t FROM owners o JOIN entity_types t ON t.name = o.kind GROUP BY 1)
SELECT coalesce(own.t, e.type_id) AS type_id, count(*) AS n FROM live_entities e LEFT JOIN own ON own.k = {_FOLD.format('e.canonical_name')} WHERE e.canonical_name IS NOT NULL GROUP BY 1""",
        "mention_resolution": f"""WITH {_ENTITIES}, few AS (SELECT canonical_name, row_number() OVER (ORDER BY canonical_name) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT canonical_name FROM live_entities WHERE canonical_name IS NOT NULL ORDER BY 1 LIMIT 64)),
  q AS (SELECT i AS question_id, 'What is the ' || t.name || ' relation for ' || f.canonical_name || ', and how does it matter?' AS question FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM relation_types) t JOIN few f ON f.r = (3 * t.i) % f.n),
  words AS (SELECT question_id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM (SELECT question_id, regexp_split_to_array(question, '\\s+') AS w FROM q)),
  tokens AS (SELECT question_id, token, pos, {_FOLD.format('lower(token)')} AS k FROM (SELECT question_id, pos, regexp_replace(raw, '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS token FROM words) WHERE strlen(token) >= 3 AND lower(token) NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})),
  names AS (SELECT id, canonical_name, {_FOLD.format('canonical_name')} AS nk FROM live_entities WHERE canonical_name IS NOT NULL),
  hits AS (SELECT t.question_id, t.token, t.pos, (SELECT min({{'canonical_name': canonical_name, 'id': id}}) FROM names WHERE nk = t.k) AS e, (SELECT min({{'canonical_name': canonical_name, 'id': id}}) FROM names WHERE nk LIKE '%' || t.k || '%') AS p FROM tokens t)
SELECT question_id, token, coalesce(e, p).id AS entity_id, coalesce(e, p).canonical_name AS canonical_name FROM hits WHERE e IS NOT NULL OR p IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY e IS NOT NULL DESC, CASE WHEN e IS NOT NULL THEN pos END NULLS FIRST, strlen(token) DESC, pos) = 1""",
        "stream_catchup": f"""WITH d AS (SELECT file_path, arg_max({{'t': text}}, doc_id).t AS content FROM documents WHERE file_path IS NOT NULL GROUP BY 1),
  k AS (SELECT file_path, arg_min({{'t': text}}, doc_id).t AS content FROM documents WHERE file_path IS NOT NULL AND updated_at < TIMESTAMP '{STREAM_KNOWN}' GROUP BY 1),
  s AS (SELECT * FROM d WHERE regexp_matches(content, '[^\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]'))
SELECT CASE WHEN s.file_path IS NULL THEN 'deleted' WHEN k.file_path IS NULL THEN 'new' WHEN s.content IS NOT DISTINCT FROM k.content THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n_files FROM s FULL JOIN k ON s.file_path = k.file_path GROUP BY 1""",
        "nearest_type": f"WITH {_NEAREST} SELECT candidate_id, type_name, round(distance, 6) + 0.0 AS distance FROM nearest",
        "zone_counts": f"WITH {_NEAREST} SELECT zone, count(*) AS n FROM zoned GROUP BY 1",
        "fallback_rate": f"WITH {_NEAREST} SELECT count(*) AS total, count(*) FILTER (zone = 'judge') AS judged, count(*) FILTER (zone = 'judge') / count(*) AS fallback_rate FROM zoned",
        "reserved_reject": f"""WITH {_ENTITIES}, c AS (SELECT id, canonical_name AS raw_name FROM live_entities UNION ALL SELECT id, upper(name) FROM relation_types)
SELECT {_FOLD.format('raw_name')} IN (SELECT {_FOLD.format('name')} FROM relation_types) AS reserved, count(*) AS n, min(raw_name) AS least, max(raw_name) AS greatest FROM c WHERE raw_name IS NOT NULL GROUP BY 1""",
    }
