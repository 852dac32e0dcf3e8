"""One frozen configuration object with the reference defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # fixed values (defaults of the reference system)
    # lexical scoring: BM25 Okapi
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    # chunking (max tokens / overlap)
    chunk_max_tokens: int = 512
    chunk_stride: int = 80
    # mining
    bm25_top_k: int = 100
    teacher_top_k: int = 10
    teacher_confidence: float = 0.6
    ance_margin: float = 0.1
    ance_top_k: int = 5
    denoise_teacher_max: float = 0.7
    denoise_overlap_max: float = 0.8
    negatives_per_query: int = 7
    # losses
    margin_mse_weight: float = 0.6
    listwise_weight: float = 0.2
    contrastive_weight: float = 0.2
    temperature_start: float = 4.0
    temperature_end: float = 2.0
    contrastive_temperature: float = 0.05
    # search service
    rerank_threshold: float = 0.6
    rrf_k: int = 60
    hybrid_weights: tuple = (0.3, 0.7)
    # rate limit
    requests_per_minute: int = 100
    burst: int = 20
    bucket_idle_seconds: int = 600
    # evaluation
    metric_ks: tuple = (10, 50, 100)
    eval_ks: tuple = (1, 5, 10, 20)
    recall_gate: float = 0.97
    # size bounds for broadcasts (rows)
    max_broadcast_rows: int = 2_000_000
    max_query_matrix_bytes: int = 64 * 1024 * 1024
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        total = self.margin_mse_weight + self.listwise_weight + self.contrastive_weight
        if abs(total - 1.0) > 0.01:
            raise ValueError(f"loss weights must sum to 1 (got {total})")
        if self.chunk_stride >= self.chunk_max_tokens:
            raise ValueError("chunk stride (overlap) must be smaller than max tokens")


# the engine-wide defaults used by operator signatures
DEFAULTS = EngineConfig()
