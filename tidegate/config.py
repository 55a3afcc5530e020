"""Default thresholds of the moderation funnel."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    """Results depend on them."""

    semantic_threshold: float = 0.67
    margin_w: float = 0.05
    black_white_gap: float = 0.02
    confidence_low: float = 0.35
    confidence_high: float = 0.75
    whitelist_distance: int = 5
    dedup_distance: int = 3
    top_k: int = 5
    margin_norm: float = 0.3
    w_top: float = 0.6
    w_margin: float = 0.4
    rerank_top_k: int = 5
    rerank_w_top: float = 0.5
    rerank_w_margin: float = 0.3
    rerank_w_rerank: float = 0.2
    fuse_text: float = 0.4
    fuse_image: float = 0.6
    llm_weight: float = 0.6
    short_text: int = 20
    regex_window: int = 8
    frames: int = 5
    review_agree_high: float = 0.9
    review_agree_low: float = 0.5
    review_step: float = 0.05
    share_high: float = 0.7
    share_low: float = 0.3
    rate_limit: int = 60
    rate_window_s: float = 60.0
    breaker_failures: int = 3
    breaker_cooldown_s: float = 30.0


DEFAULTS = Defaults()
