"""Providers of embeddings and extractions, with deterministic offline ones."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rejected(ValueError):
    """The provider refuses one text; the chunk is skipped and the file still counts as indexed."""


class Embedder(Protocol):
    """May have `concurrency`, the most requests at a time that the backend takes."""

    dimension: int

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


class Extractor(Protocol):
    def extract(self, text: str) -> list[dict]: ...

    def judge(self, name: str, type_name: str) -> str: ...

    def concepts(self, keys: list[str]) -> dict[str, str | None]: ...


class HashedEmbedder:
    """Word hashes with signs, unit length: similar words give similar vectors, everywhere the same."""

    def __init__(self, dimension: int = 96):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension, np.float64)
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return out


class RuleExtractor:
    """Deterministic: candidates are names like AB-12 and hyphenated words with a number, hinted by their prefix; keys are concepts if
    spelled like one, or like one of the given synonyms. A middle candidate is merged if its name shares a word with the type's,
    rejected if it has no letters of its own, and a new type otherwise."""

    def __init__(self, concepts: tuple[str, ...] = (), synonyms: dict[str, str] | None = None):
        from cairnmill.schemas import FRONTMATTER_CONCEPTS

        self.known = set(concepts or FRONTMATTER_CONCEPTS)
        self.synonyms = synonyms or {}

    def extract(self, text: str) -> list[dict]:
        names = dict.fromkeys(re.findall(r"\b[A-Z]{2,}-\d+\b|\b[a-z]+(?:-[a-z]+)+-\d+\b", text))
        return [{"raw_name": n, "raw_type_hint": n.split("-")[0].lower() if n[0].isupper() else None} for n in names]

    def judge(self, name: str, type_name: str) -> str:
        mine, theirs = (set(re.findall(r"[^\W\d_]+", x.lower())) for x in (name, type_name or ""))
        return "reject" if not mine else "merge" if mine & theirs else "new"

    def concepts(self, keys: list[str]) -> dict[str, str | None]:
        fold = {k: re.sub(r"[^a-z]", "_", k.lower()).strip("_") for k in keys}
        named = {k: self.synonyms.get(f, f) for k, f in fold.items()}
        return {k: f if f in self.known else None for k, f in named.items()}


#: Texts of one request to an embedding backend.
BATCH = 64


def embedding(embedder: Embedder, text: Column) -> Column:
    """struct<embedding, status>: 'ok' or 'rejected'; any other failure of the provider fails the job."""

    def run(texts: pd.Series) -> pd.DataFrame:
        vectors, status = [], []
        given = [t or "" for t in texts]
        for at in range(0, len(given), BATCH):
            part = given[at : at + BATCH]
            try:
                vectors += [v.tolist() for v in embedder.embed(part)]
                status += ["ok"] * len(part)
            except Rejected:  # one of them is refused: ask one by one
                for t in part:
                    try:
                        vectors.append(embedder.embed([t])[0].tolist())
                        status.append("ok")
                    except Rejected:
                        vectors.append(None)
                        status.append("rejected")
        return pd.DataFrame({"embedding": vectors, "status": status})

    return F.pandas_udf(run, "embedding array<float>, status string")(text)


def embed_distinct(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """rows with `vector`; each distinct text, trimmed and in lower case, is embedded once."""
    keyed = rows.withColumn("_t", F.lower(F.trim(F.col(text))))
    once = keyed.select("_t").distinct().withColumn("vector", embedding(embedder, F.col("_t"))["embedding"])
    return keyed.join(once, "_t").drop("_t")


class Unavailable(RuntimeError):
    """The provider can't be reached or fails; the job stops and the files stay unindexed."""


class HttpEmbedder:
    """A JSON endpoint. 4xx answers reject the text, anything else is an outage. Two shapes of backend:

    batch: POST {"model", "input": [texts]} gives {"embeddings": [[...]]}.
    single: POST {"content": text} gives {"embedding": [...]}, or a list of one such object; one request a text.
    """

    def __init__(self, url: str, model: str, dimension: int | None = None, timeout: float = 60.0, shape: str = "batch", concurrency: int | None = None):
        if shape not in ("batch", "single"):
            raise ValueError(f"unknown shape: {shape}")
        self.url, self.model, self.timeout, self.shape, self.concurrency = url, model, timeout, shape, concurrency
        self.dimension = dimension or len(self.embed(["capability probe"])[0])

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        if self.shape == "single":
            return [self._one(t) for t in texts]
        got = post_json(self.url, {"model": self.model, "input": texts}, self.timeout).get("embeddings")
        if not isinstance(got, list) or len(got) != len(texts):
            raise Unavailable("malformed reply")
        return [np.asarray(v, np.float32) for v in got]

    def _one(self, text: str) -> np.ndarray:
        got = post_json(self.url, {"content": text}, self.timeout, many=True)
        got = got[0] if isinstance(got, list) and got else got
        v = got.get("embedding") if isinstance(got, dict) else None
        v = v[0] if isinstance(v, list) and v and isinstance(v[0], list) else v
        if not isinstance(v, list):
            raise Unavailable("malformed reply")
        return np.asarray(v, np.float32)


def discover(base: str, timeout: float = 10.0) -> list[dict]:
    """Models that a backend offers: name, context (num_ctx before any *.context_length) and capabilities; one list request and one for each model."""
    names = [m["name"] for m in get_json(f"{base}/api/tags", timeout).get("models", []) if isinstance(m, dict) and m.get("name")]
    out = []
    for n in names:
        shown = post_json(f"{base}/api/show", {"model": n}, timeout)
        out.append({"name": n, "context": context_length(shown), "capabilities": list(shown.get("capabilities") or [])})
    return out


def context_length(shown: dict) -> int | None:
    """The context of a model as it runs: num_ctx among its parameters, else the length that the model itself states."""
    for line in str(shown.get("parameters") or "").splitlines():
        word = line.split()
        if len(word) == 2 and word[0] == "num_ctx" and word[1].isdigit():
            return int(word[1])
    lengths = [v for k, v in (shown.get("model_info") or {}).items() if k.endswith(".context_length") and isinstance(v, int)]
    return lengths[0] if lengths else None


def supporting(models: list[dict], capability: str) -> list[dict]:
    """Models that can do 'embedding' or 'completion'."""
    return [m for m in models if capability in m["capabilities"]]


def get_json(url: str, timeout: float) -> dict:
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310 (the caller configures the address)
            return parse_reply(reply.read().decode())
    except OSError as e:
        raise Unavailable(str(e)) from e


def post_json(url: str, body: dict, timeout: float, many: bool = False):
    import json
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310 (the caller configures the address)
            text = reply.read().decode()
            return json.loads(text) if many else parse_reply(text)
    except urllib.error.HTTPError as e:
        raise (Rejected if 400 <= e.code < 500 else Unavailable)(f"{e.code}") from e
    except (OSError, ValueError) as e:
        raise Unavailable(str(e)) from e


DECISIONS = ("merge", "new", "reject")


def parse_reply(text: str) -> dict:
    """A reply's JSON object; anything else is an error, never a guess."""
    import json

    try:
        got = json.loads(text)
    except ValueError as e:
        raise Unavailable("malformed reply") from e
    if not isinstance(got, dict):
        raise Unavailable("malformed reply")
    return got


def parse_decision(text: str) -> str:
    got = parse_reply(text).get("decision")
    if got not in DECISIONS:
        raise Unavailable(f"unknown decision: {got}")
    return got


class HttpExtractor:
    """Candidates, judgements and key meanings from a completion endpoint that answers in JSON."""

    def __init__(self, url: str, model: str, timeout: float = 120.0):
        self.url, self.model, self.timeout = url, model, timeout

    def _ask(self, task: str, **given) -> str:
        return str(post_json(self.url, {"model": self.model, "task": task, "input": given, "format": "json"}, self.timeout).get("response", ""))

    def extract(self, text: str) -> list[dict]:
        rows = parse_reply(self._ask("List the entities that this text names, each with raw_name and raw_type_hint or null, under 'candidates'.", text=text)).get("candidates", [])
        return [{"raw_name": str(r["raw_name"]), "raw_type_hint": r.get("raw_type_hint")} for r in rows if isinstance(r, dict) and r.get("raw_name")]

    def judge(self, name: str, type_name: str) -> str:
        return parse_decision(self._ask("Is the entity an instance of the type (merge), of a new type (new) or none (reject)? Answer under 'decision'.", name=name, type=type_name))

    def concepts(self, keys: list[str]) -> dict[str, str | None]:
        got = parse_reply(self._ask("Which of the known concepts does each key mean, or null?", keys=keys))
        return {k: got.get(k) if isinstance(got.get(k), str) else None for k in keys}
