"""Defaults for every pipeline stage, in one place.

The values mirror the reference's constructor defaults; ``demo()`` returns the
configuration its published demo run used (smaller windows, exact index,
looser thresholds).
"""
from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # chunking
    chunk_size: int = 512
    chunk_overlap: int = 50
    # embedding (the built-in hashed embedder; a user model may replace it)
    embedding_dim: int = 256
    # index
    index_type: str = "IVFFlat"  # "Flat" = exact, "IVFFlat" = cell-pruned
    nlist: int = 100
    nprobe: int = 10
    kmeans_seed: int = 42
    kmeans_max_iter: int = 20
    # query
    top_k: int = 5
    max_top_k: int = 20
    max_question_chars: int = 2000
    similarity_threshold: float = 0.65
    max_context_tokens: int = 2048
    # generation
    temperature: float = 0.2
    max_response_tokens: int = 512
    # evaluation
    relevance_threshold: float = 0.7
    groundedness_threshold: float = 0.6
    reliability_runs: int = 3
    enable_safety: bool = True
    # quality score weights (relevance, groundedness, reliability, safety)
    w_relevance: float = 0.3
    w_groundedness: float = 0.3
    w_reliability: float = 0.2
    w_safety: float = 0.2
    pass_threshold: float = 0.5
    # physical knobs
    broadcast_limit_bytes: int = 64 * 1024 * 1024

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)

    def validate(self) -> "Config":
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if self.chunk_overlap < 0 or self.chunk_overlap >= self.chunk_size:
            # the reference loops forever when overlap >= size; we refuse
            raise ValueError("chunk_overlap must be in [0, chunk_size)")
        if self.embedding_dim <= 0:
            raise ValueError("embedding_dim must be positive")
        return self


DEFAULT = Config()


def demo() -> Config:
    """Configuration of the reference's published demo/benchmark runs."""
    return DEFAULT.with_(
        chunk_size=256,
        chunk_overlap=30,
        index_type="Flat",
        similarity_threshold=0.3,
        max_context_tokens=1024,
        relevance_threshold=0.5,
        groundedness_threshold=0.4,
        reliability_runs=2,
    )
