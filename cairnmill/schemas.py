"""Schemas and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CHUNK = _struct(("id", _S, False), ("file_path", _S, False), ("content", _S, False), ("embedding", T.ArrayType(T.FloatType()), True), ("content_hash", _S, False), ("updated_at", _S, False))
ENTITY_TYPE = _struct(("id", _S, False), ("name", _S, False), ("description", _S, True), ("created_at", _S, False))
RELATION_TYPE = _struct(("id", _S, False), ("name", _S, False), ("description", _S, True), ("status", _S, False), ("created_at", _S, False))
HIT = _struct(("type_id", _S, False), ("file_path", _S, False))
ENTITY = _struct(("id", _S, False), ("type_id", _S, False), ("canonical_name", _S, False), ("first_seen_file", _S, True), ("updated_at", _S, False))
RELATION = _struct(("id", _S, False), ("type_id", _S, False), ("source_entity_id", _S, False), ("target_entity_id", _S, False), ("confidence", T.FloatType(), False), ("evidence_chunk_id", _S, False))
PROFILE = _struct(("id", _S, False), ("folder_scope", _S, False), ("key_fingerprint", _S, False), ("field_mapping", _S, False), ("learned_at", _S, False))
INDEXED_FILE = _struct(("file_path", _S, False), ("content_hash", _S, False), ("indexed_at", _S, False))

# Results depend on them.
PROMOTION_THRESHOLD = 3
SEED_RELATION_TYPES = ("depends_on", "supersedes", "implements", "causes", "owned_by", "conflicts_with", "documents", "configures")
FRONTMATTER_CONCEPTS = ("id", "kind", "status", *SEED_RELATION_TYPES)
ZONE_LOW, ZONE_HIGH = 0.15, 0.35
RRF_K = 60.0
DEFAULT_TOP_K, FALLBACK_TOP_K = 10, 3
ROUTING_THRESHOLD = 0.3
MAX_PATH_DEPTH = 6
BUDGET_MARGIN = 0.75
DEFAULT_TOKEN_BUDGET = 256
CHARS_PER_TOKEN = 4
MIN_WORD_BYTES = 3
PLACEHOLDER_TYPE = "unresolved-reference"
DEFAULT_KIND = "spec-item"
STOPWORDS = (
    "the", "for", "and", "are", "was", "were", "has", "have", "had", "not", "but", "you", "your",
    "with", "this", "that", "from", "what", "how", "does", "did", "who", "when", "where", "which",
)


def candidate_pool(top_k: int) -> int:
    return max(4 * top_k, 20)
