"""Settings of a build: strict, frozen, with the defaults of the catalogue pipeline."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TextSettings:
    lowercase: bool = True
    remove_stopwords: bool = True
    stemmer: str = "porter"
    max_terms: int = 5_000
    min_df: int = 2
    max_tokens: int = 128
    overlap: int = 16

    def __post_init__(self):
        if self.stemmer not in ("porter", "none"):
            raise ValueError(f"unknown stemmer {self.stemmer!r}")
        if min(self.max_terms, self.min_df, self.max_tokens) <= 0 or not 0 <= self.overlap < self.max_tokens:
            raise ValueError("sizes must be positive and the overlap smaller than a chunk")


@dataclass(frozen=True)
class VisionSettings:
    max_width: int = 1080
    max_height: int = 1440
    max_keypoints: int = 500
    sample_size: int = 250_000
    codebook_size: int = 512
    seed: int = 42

    def __post_init__(self):
        if min(self.max_width, self.max_height, self.max_keypoints, self.sample_size, self.codebook_size) <= 0:
            raise ValueError("vision sizes must be positive")


@dataclass(frozen=True)
class SearchSettings:
    top_k: int = 10
    candidate_multiplier: int = 5
    weights: Mapping[str, float] = field(default_factory=lambda: {"text": 0.45, "image": 0.55})

    def __post_init__(self):
        if self.top_k <= 0 or self.candidate_multiplier <= 0:
            raise ValueError("top_k and candidate_multiplier must be positive")
        if min(self.weights.values()) < 0 or abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("weights must not be negative and must sum to 1")


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    active_scale: str = "1k"
    scales: Mapping[str, int | None] = field(default_factory=lambda: {"1k": 1_000, "10k": 10_000, "full": None})
    split_ratios: Mapping[str, float] = field(default_factory=lambda: {"train": 0.8, "validation": 0.1, "test": 0.1})
    text: TextSettings = field(default_factory=TextSettings)
    vision: VisionSettings = field(default_factory=VisionSettings)
    search: SearchSettings = field(default_factory=SearchSettings)

    def __post_init__(self):
        if self.seed < 0:
            raise ValueError("the seed must not be negative")
        if self.active_scale not in self.scales:
            raise ValueError(f"unknown scale {self.active_scale!r}")
        if any(n is None and name != "full" or n is not None and n <= 0 for name, n in self.scales.items()):
            raise ValueError("only the scale 'full' may have no size; others must be positive")
        if min(self.split_ratios.values()) <= 0 or abs(sum(self.split_ratios.values()) - 1) > 1e-9:
            raise ValueError("split ratios must be positive and sum to 1")


def from_mapping(values: Mapping[str, Any], into: type = Settings):
    """Settings from nested mappings; a key that isn't known is refused."""
    known = {f.name: f for f in dataclasses.fields(into)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    nested = {"text": TextSettings, "vision": VisionSettings, "search": SearchSettings}
    return into(**{k: from_mapping(v, nested[k]) if into is Settings and k in nested and isinstance(v, Mapping) else v for k, v in values.items()})


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Nested mappings laid over each other in order; the last one wins."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(*paths: str) -> Settings:
    """Settings from YAML files, deep-merged in order."""
    import yaml

    layers = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            layers.append(yaml.safe_load(f) or {})
    return from_mapping(merged(*layers))
