"""Settings: environment over given values over defaults; one immutable object."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields, replace

from ctxloom.errors import MemoryError_
from ctxloom.functions.text import FAMILIES, PROFILES

PREFIX = "CTXLOOM_"


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    recent_n: int = 3
    min_score: float = 0.65
    dynamic_window: bool = True
    min_top_k: int = 5
    max_top_k: int = 50
    hybrid: bool = True
    bm25_weight: float = 0.4
    cosine_weight: float = 0.6
    prefilter: bool = True
    prefilter_top: int = 50
    query_expansion: bool = False
    expansion_count: int = 3
    fusion: str = "rrf"
    rrf_k: int = 60
    rerank: bool = False
    rerank_weight: float = 0.7
    threads: bool = False
    thread_similarity: float = 0.7
    thread_gap: int = 5
    memory: bool = True
    memory_top_k: int = 10
    memory_min_score: float = 0.75
    memory_scan: int = 1000
    summaries: bool = True
    summary_top_k: int = 5
    summary_min_score: float = 0.3
    summary_threshold: float = 0.85
    summary_max_length: int = 1000
    storage_mode: str = "hybrid"
    extraction: bool = True
    extraction_batch: int = 5
    extraction_interval_s: int = 30
    min_confidence: float = 0.5
    conflict_strategy: str = "keep_highest_confidence"
    conflict_similarity: float = 0.8
    result_store: bool = True
    result_ttl_hours: int = 24
    result_max: int = 1000
    chunk_tokens: int = 500
    chunk_overlap: int = 50
    cache_max: int = 10_000
    tool_index_max: int = 5000
    session_ttl_hours: int = 24
    user_fact_max: int = 10_000

    def problems(self) -> list[str]:
        """Everything that is out of range."""
        checks = {
            "top_k must be 1 or more": self.top_k >= 1,
            "recent_n must be 0 or more": self.recent_n >= 0,
            "min_score must be within 0 and 1": 0 <= self.min_score <= 1,
            "min_top_k must not exceed max_top_k": 0 < self.min_top_k <= self.max_top_k,
            "weights must add up to 1": abs(self.bm25_weight + self.cosine_weight - 1) < 1e-9,
            "fusion must be rrf or round_robin": self.fusion in ("rrf", "round_robin"),
            "rrf_k must be 1 or more": self.rrf_k >= 1,
            "rerank_weight must be within 0 and 1": 0 <= self.rerank_weight <= 1,
            "thread_similarity must be within 0 and 1": 0 <= self.thread_similarity <= 1,
            "summary_threshold must be within 0 and 1": 0 <= self.summary_threshold <= 1,
            "storage_mode must be facts, semantic or hybrid": self.storage_mode in ("facts", "semantic", "hybrid"),
            "extraction_batch must be 1 or more": self.extraction_batch >= 1,
            "chunk_overlap must be under half of chunk_tokens": 0 <= 2 * self.chunk_overlap < self.chunk_tokens,
        }
        return [m for m, good in checks.items() if not good]

    def checked(self) -> Config:
        if found := self.problems():
            raise MemoryError_("INVALID_CONFIG", "; ".join(found))
        return self

    def for_model(self, model: str | None) -> Config:
        low = (model or "").lower()
        family = next((f for part, f in FAMILIES if part in low), "default")
        k, recent, score = PROFILES[family]
        return replace(self, top_k=k, recent_n=recent, min_score=score)


def load(given: dict | None = None, env: dict | None = None, model: str | None = None) -> Config:
    """The effective settings. A model's profile stands under given values."""
    env = os.environ if env is None else env
    base = Config().for_model(model) if model else Config()
    values = asdict(base) | {k: v for k, v in (given or {}).items() if k in asdict(base)}
    for f in fields(Config):
        raw = env.get(PREFIX + f.name.upper())
        if raw is not None:
            kind = type(getattr(base, f.name))
            values[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return Config(**values).checked()
