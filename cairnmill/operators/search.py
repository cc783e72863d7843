"""Nearest chunks and hybrid search: vector rank and keyword rank fused by reciprocal ranks."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmill.functions.text import hit_count
from cairnmill.functions.vectors import cosine, l2, usable, vector
from cairnmill.schemas import DEFAULT_TOP_K, MIN_WORD_BYTES, RRF_K, candidate_pool


def nearest(rows: DataFrame, query: list[float], k: int, key: str = "id", column: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k nearest rows with `distance` (ties by key). Exact: one scan, a top-k in each task, a merge of k rows."""
    q = vector(query)
    d = l2(F.col(column), q) if metric == "l2" else 1 - cosine(F.col(column), q)
    return rows.filter(usable(F.col(column), len(query))).withColumn("distance", d).drop(column).orderBy("distance", key).limit(k)


def query_keywords(text: str) -> list[str]:
    """The keywords of a query, as functions.text.keywords gives them for a column."""
    return [w.lower() for w in regex.split(r"[^\p{Alphabetic}\p{N}]", text) if len(w.encode()) >= MIN_WORD_BYTES]


def hybrid(chunks: DataFrame, query_text: str, query_vector: list[float], top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """chunks (id, file_path, content, embedding) -> the top_k by fused score.

    Windows run over the candidate pool only, max(4 top_k, 20) rows.
    """
    pool = nearest(chunks, query_vector, candidate_pool(top_k))
    words = query_keywords(query_text)
    ranked = pool.withColumn("hits", hit_count(F.col("content"), words)).withColumn("vr", F.row_number().over(Window.orderBy("distance", "id")) - 1)
    ranked = ranked.withColumn("kr", F.row_number().over(Window.orderBy(F.desc("hits"), "vr")) - 1)
    score = 1 / (RRF_K + F.col("vr") + 1) + 1 / (RRF_K + F.col("kr") + 1)
    return ranked.withColumn("score", score).orderBy(F.desc("score"), "vr").limit(top_k)
