"""Thresholds and vocabularies of the signals; one object describes one study."""

from __future__ import annotations

from dataclasses import dataclass, field

from respondex.functions import lexicons as L


@dataclass(frozen=True)
class SignalConfig:
    low_words: int = 3
    long_words: int = 45
    low_unique_ratio: float = 0.55
    fast_seconds: float = 240.0
    slow_fast_seconds: float = 300.0
    min_duplicate_chars: int = 16
    min_signature_chars: int = 24
    matrix_min_items: int = 4
    matrix_modal_share: float = 0.90
    high_missing: float = 0.55
    generic_pattern: str = L.GENERIC_PATTERN
    placeholder_pattern: str = L.PLACEHOLDER_PATTERN
    polished_pattern: str = L.POLISHED_PATTERN
    meta_pattern: str = L.SURVEY_META_PATTERN
    grounded_pattern: str = L.GROUNDED_PATTERN
    hostile_pattern: str = L.HOSTILE_PATTERN
    topic_pattern: str = r"(^|[^a-z])(survey|product|brand)([^a-z]|$)"
    domain_terms: tuple[str, ...] = ()
    topic_keywords: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)
