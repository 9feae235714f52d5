"""Settings of the engine, and presets of them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from .errors import TesseraError


@dataclass(frozen=True)
class Config:
    use_reranker: bool = True
    use_lexicon: bool = True
    use_reputation: bool = True
    use_adaptive_concurrency: bool = True
    use_quality_evaluator: bool = True
    use_query_intelligence: bool = True
    use_dedup: bool = True
    use_recency_ranking: bool = True
    max_results: int = 12
    max_chars: int = 2000
    rerank_top_k: int = 5
    chunk_size: int = 256
    semantic_threshold: float = 0.75
    dedupe_threshold: float = 0.85
    recency_weight: float = 0.4
    recency_decay_days: int = 365
    ingest_max_pages: int = 500
    ingest_max_rows: int = 10_000
    trace_timing: bool = False
    session_timeout: float = 45.0
    path: str = "./tessera_db"

    def __post_init__(self):
        if not (1 <= self.max_results <= 50 and self.chunk_size > 0 and 0 <= self.recency_weight <= 1 and self.recency_decay_days > 0):
            raise TesseraError("a setting is out of range", "config")

    @classmethod
    def preset(cls, name: str, **changes) -> Config:
        presets = {
            "lightweight": {"use_reranker": False, "use_lexicon": False, "use_adaptive_concurrency": False, "use_quality_evaluator": False, "use_query_intelligence": False},
            "fast": {"use_reranker": False, "max_results": 6, "rerank_top_k": 3},
            "full": {},
        }
        if name not in presets:
            raise TesseraError(f"presets are {sorted(presets)}", "config")
        return cls().with_(**presets[name] | changes)

    def with_(self, **changes) -> Config:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TesseraError(f"unknown settings: {sorted(unknown)}", "config")
        return replace(self, **changes)
