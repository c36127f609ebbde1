"""Engine settings with their defaults, presets and precedence.

Precedence: defaults, then a preset, then overrides, then ``ENGRAMQL_*``
environment variables (numbers and booleans as text).
"""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field

DAY_MS = 86_400_000

# Results depend on them.
ROLE_WEIGHTS = {"user": 0.8, "assistant": 0.6, "tool": 0.2}
SOURCE_WEIGHTS = {"claude-code": 1.0, "obsidian": 0.9, "granola": 0.5, "gmail": 0.35, "gcal": 0.45}
SKIP_THRESHOLDS = {"claude-code": 0.5, "gmail": 0.4, "granola": 0.25, "obsidian": 0.2, "conversation": 0.2, "gcal": 0.3}
DIRECTIVES = (r"\balways\b", r"\bnever\b", r"\bdon't\b", r"\bremember\b", r"\bi prefer\b", r"\bplease don't\b")
CORRECTIONS = (r"\bactually\b", r"\bno,\b", r"\bthat's wrong\b", r"\bincorrect\b", r"\bnot correct\b")


@dataclass(frozen=True)
class Settings:
    decay_per_day: float = 0.05
    strength_gain: float = 0.1
    confidence_gain: float = 0.05
    contradiction_sessions: int = 3
    evict_strength: float = 0.05
    evict_age_ms: int = 30 * DAY_MS
    training_confidence: float = 0.6
    max_content_bytes: int = 8_000
    w_role: float = 0.30
    w_length: float = 0.20
    w_directive: float = 0.35
    w_correction: float = 0.15
    length_words: int = 100
    candidate_k: int = 5
    anchor_k: int = 5
    skip_default: float = 0.2
    skip_assistant: float = 0.5
    unrelated_below: float = 0.3
    band_low: float = 0.8
    band_high: float = 2.0
    append_resistance: float = 0.3
    rank_w_strength: float = 1.0
    rank_w_recency: float = 0.0
    fuse_strength: float = 0.0
    gloss_threshold: float = 0.35
    injection_tokens: int = 500
    spread_decay: float = 0.5
    spread_seeds: int = 10
    deleted_similarity: float = 0.7
    ranked_k: int = 10
    ranked_floor: float = 0.3
    schema_support: int = 3
    schema_cohesion: float = 0.7
    schema_join: float = 0.75
    recall_budget: int = 20
    sideways_budget: int = 3
    echo_similarity: float = 0.85
    echo_window_ms: int = DAY_MS
    snapshot_match: float = 0.85
    schema_rel_similarity: float = 0.8
    cluster_cut: float = 0.35
    mass_high: int = 10
    mass_low: int = 7
    noise_cap: float = 0.5
    drift_threshold: int = 3
    entity_merge_similarity: float = 0.88
    rrf_k: int = 60
    trace_ring: int = 50
    role_weights: dict = field(default_factory=lambda: dict(ROLE_WEIGHTS))
    source_weights: dict = field(default_factory=lambda: dict(SOURCE_WEIGHTS))
    skip_thresholds: dict = field(default_factory=lambda: dict(SKIP_THRESHOLDS))


PRESETS = {"lite": {"recall_budget": 10, "ranked_k": 5}, "standard": {}, "full": {"recall_budget": 40, "candidate_k": 8}}


def settings(preset: str = "standard", overrides: dict | None = None, env: dict[str, str] | None = None) -> Settings:
    values = {**PRESETS[preset], **(overrides or {})}
    for f in dataclasses.fields(Settings):
        raw = (os.environ if env is None else env).get(f"ENGRAMQL_{f.name.upper()}")
        if raw is not None and f.type in ("float", "int"):
            values[f.name] = (float if f.type == "float" else int)(raw)
    return Settings(**values)


DEFAULT = Settings()
