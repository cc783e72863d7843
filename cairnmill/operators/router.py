"""Which entity a question mentions, which relation type it asks for, and whether the graph or search answers it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmill.functions.text import ascii_lower, mention_tokens
from cairnmill.functions.vectors import cosine
from cairnmill.operators.classify import vocabulary
from cairnmill.schemas import ROUTING_THRESHOLD


#: Distinct question words that are sent to the names at a time.
MAX_WORDS = 10_000


def mentions(questions: DataFrame, entities: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """(key, token, entity_id, canonical_name) of the entity each question mentions.

    The first token that is an entity's exact name (ASCII case apart) wins; else the longest token that is part of a name,
    earlier tokens first among equals, with its alphabetically first entity. Exact names are an equi-join. A token as
    a part of a name has no equi-join, so the distinct tokens (the small side: a batch of questions) are
    sent to the names, of which each yields at most one row per token, reduced to the first name in every task.
    """
    tokens = questions.select(key, F.posexplode(mention_tokens(F.col(text))).alias("pos", "token")).withColumn("k", ascii_lower(F.lower("token")))
    names = entities.select(F.col("id").alias("entity_id"), "canonical_name", ascii_lower(F.col("canonical_name")).alias("name_k"))
    words = tokens.select("k").distinct()
    exact = names.join(words, F.col("name_k") == F.col("k")).groupBy("k").agg(F.min(F.struct("canonical_name", "entity_id")).alias("e"))
    pattern = F.concat(F.lit("%"), F.replace(F.col("k"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    slices, part = -(-words.count() // MAX_WORDS), None
    for i in range(max(1, slices)):  # each slice is small enough to be sent
        few = words.filter(F.pmod(F.xxhash64("k"), F.lit(max(1, slices))) == i)
        got = names.join(F.broadcast(few), F.like("name_k", pattern)).groupBy("k").agg(F.min(F.struct("canonical_name", "entity_id")).alias("p"))
        part = got if part is None else part.unionByName(got)
    hit = tokens.join(exact, "k", "left").join(part, "k", "left").filter("e is not null or p is not null")
    is_exact = F.col("e").isNotNull()
    w = Window.partitionBy(key).orderBy(F.desc(is_exact), F.when(is_exact, F.col("pos")), F.desc(F.octet_length("token")), "pos")
    best = hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return best.select(key, "token", F.coalesce("e", "p").alias("x")).select(key, "token", "x.entity_id", "x.canonical_name")


def route(questions: DataFrame, relation_types: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, type_id, type_name, score): the relation type whose description is most like the question, ties by name.

    relation_types (id, name, vector) is a vocabulary of a few rows, one constant.
    """
    scored = F.transform(vocabulary(relation_types, "name", "id", "vector"), lambda t: F.struct((-cosine(F.col("vector"), t["vector"])).alias("s"), t["name"].alias("type_name"), t["id"].alias("type_id")))
    best = questions.select(key, F.array_min(scored).alias("b"))
    return best.select(key, "b.type_id", "b.type_name", (-F.col("b.s")).alias("score"))


def answers(questions: DataFrame, mentioned: DataFrame, routed: DataFrame, edges: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, mode, answer, n_relations): graph_traversal if type and entity fit and there are such relations, else vector_fallback."""
    both = questions.select(key).join(mentioned, key, "left").join(routed, key, "left")
    ends = edges.select("id", "type_id", F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("entity_id"))
    n = ends.groupBy("entity_id", "type_id").agg(F.count("*").alias("n"))
    got = both.join(n, ["entity_id", "type_id"], "left")
    ok = (F.col("score") >= ROUTING_THRESHOLD) & F.col("entity_id").isNotNull() & (F.coalesce("n", F.lit(0)) > 0)
    ok = F.coalesce(ok, F.lit(False))
    text = F.concat("canonical_name", F.lit(" has "), F.col("n").cast("string"), F.lit(" relation(s) of type '"), "type_name", F.lit("'"))
    return got.select(key, F.when(ok, "graph_traversal").otherwise("vector_fallback").alias("mode"), F.when(ok, text).alias("answer"), F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("n_relations"))
