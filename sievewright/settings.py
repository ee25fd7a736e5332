"""All tunables of the engine, in one frozen record."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    corpus_dir: str = "data/corpus"
    private_corpus_dir: str = ""
    index_dir: str = "data/index"
    eval_dir: str = "data/eval"
    chunk_strategy: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 64
    top_k_dense: int = 20
    top_k_sparse: int = 20
    rrf_k: int = 60
    use_reranker: bool = True
    top_k_rerank: int = 5
    rerank_pool_factor: int = 4
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    embedding_dim: int = 256
    embedding_model: str = "hashing"
    llm_model: str = "offline"
    n_questions: int = 3
    max_query_rewrites: int = 2
    max_regenerations: int = 1
    min_relevant_docs: int = 1
    min_attribution_rate: float = 1.0
    seed: int = 12345
    resamples: int = 10_000

    @classmethod
    def from_env(cls, prefix: str = "SIEVEWRIGHT_", env: dict[str, str] | None = None) -> Settings:
        """Defaults overridden by environment variables; unknown ones are ignored."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"{prefix}{f.name.upper()}")
            if raw is not None:
                kind = type(getattr(cls, f.name))
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**found)

    def but(self, **changes) -> Settings:
        return replace(self, **changes)

    @property
    def recursion_limit(self) -> int:
        """Steps that a corrective run may take: three for each retrieval and each generation round, and slack."""
        return (self.max_query_rewrites + 1) * 3 + (self.max_regenerations + 1) * 3 + 5
