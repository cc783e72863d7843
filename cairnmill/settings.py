"""A project's settings as TOML: which backends embed and extract."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from cairnmill.api import Config
from cairnmill.sources.providers import HashedEmbedder, HttpEmbedder, HttpExtractor, RuleExtractor

PROVIDERS = ("offline", "batch", "single")


@dataclass
class Embedding:
    provider: str = "offline"
    model: str = "hashed"
    url: str = ""
    dimension: int = 96
    concurrency: int = 4


@dataclass
class Extraction:
    provider: str = "offline"
    model: str = "rules"
    url: str = ""


@dataclass
class Settings:
    embedding: Embedding
    extraction: Extraction | None = None
    token_budget: int = 256

    def config(self) -> Config:
        """The providers that the settings name."""
        e = self.embedding
        if e.provider not in PROVIDERS:
            raise ValueError(f"unknown provider: {e.provider}")
        embedder = HashedEmbedder(e.dimension) if e.provider == "offline" else HttpEmbedder(e.url, e.model, e.dimension, shape=e.provider, concurrency=e.concurrency)
        x = self.extraction
        extractor = None if x is None else RuleExtractor() if x.provider == "offline" else HttpExtractor(x.url, x.model)
        return Config(token_budget=self.token_budget, embedder=embedder, extractor=extractor)


def path(root: str) -> Path:
    return Path(root) / ".cairnmill" / "config.toml"


def load(root: str) -> Settings | None:
    """None if the project has no settings; broken TOML and unknown keys are errors."""
    p = path(root)
    if not p.exists():
        return None
    got = tomllib.loads(p.read_text())
    extraction = got.pop("extraction", None)
    unknown = set(got) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**got | {"embedding": Embedding(**got.get("embedding", {})), "extraction": Extraction(**extraction) if extraction is not None else None})


def save(root: str, settings: Settings) -> None:
    p = path(root)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(dump(settings))


def dump(settings: Settings) -> str:
    out = [f"token_budget = {settings.token_budget}"]
    for name in ("embedding", "extraction"):
        part = getattr(settings, name)
        if part is not None:  # strings of TOML are those of JSON
            out += ["", f"[{name}]", *[f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in asdict(part).items()]]
    return "\n".join(out) + "\n"
