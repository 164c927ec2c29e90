"""Limits, weights and thresholds of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the decision policy."""

    matched: float = 0.82
    ambiguous: float = 0.56
    minimum_margin: float = 0.08


@dataclass(frozen=True)
class Weights:
    """Fixed values of the score."""

    number: float = 0.58
    name: float = 0.42
    text: float = 0.62
    artwork: float = 0.38
    base: float = 0.85
    ocr: float = 0.15


@dataclass(frozen=True)
class Options:
    """Limits, whose defaults are fixed values that results depend on, and the policy."""

    candidate_limit: int = 8
    priced_limit: int = 3
    max_upload_bytes: int = 12 * 1024 * 1024
    max_image_pixels: int = 24_000_000
    min_image_side: int = 320
    min_blur_variance: float = 34.0
    rate_limit: int = 30
    rate_window_seconds: float = 60.0
    price_ttl_days: int | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Weights = field(default_factory=Weights)

    @staticmethod
    def from_env(prefix: str = "MATCHLOOM_", environ: dict[str, str] | None = None) -> Options:
        """Options with whole-number and float fields taken from prefixed variables; others are ignored."""
        given = os.environ if environ is None else environ
        kinds = {"int": int, "float": float, "int | None": int}
        found = {f.name: kinds[str(f.type)](given[k]) for f in fields(Options) if str(f.type) in kinds and (k := prefix + f.name.upper()) in given}
        return Options(**found)
