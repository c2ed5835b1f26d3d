"""Limits, weights and thresholds used by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # Ingest limits.
    max_chunk_tokens: int = 512
    overlap_tokens: int = 50
    tokens_per_word: float = 1.3
    max_chunks_per_document: int = 500
    max_document_bytes: int = 2_000_000
    max_metadata_bytes: int = 64_000
    max_external_id_length: int = 1024
    max_path_length: int = 2048
    max_documents_per_batch: int = 100
    max_batch_bytes: int = 10_000_000
    max_sync_diagnostics_bytes: int = 64_000
    supported_extensions: tuple[str, ...] = (
        ".md", ".txt", ".log", ".json", ".yaml", ".yml", ".toml", ".ini", ".py", ".js",
        ".ts", ".jsx", ".tsx", ".go", ".java", ".proto", ".patch", ".diff",
    )

    # Log chunking.
    log_window_lines: int = 30
    burst_min_errors: int = 2
    burst_max_lines: int = 24

    # Entries of a config or API file that get a chunk of their own.
    config_keys: int = 50
    openapi_entries: int = 100

    # Retrieval.
    embedding_dim: int = 384
    index_version: str = "current"
    vector_weight: float = 0.40
    lexical_weight: float = 0.30
    metadata_weight: float = 0.20
    graph_weight: float = 0.10
    rrf_k: int = 60
    candidate_multiplier: int = 3
    incident_multiplier: int = 4
    min_fetch: int = 30
    top_k: int = 10
    max_top_k: int = 20
    max_query_length: int = 4096
    rerank_max_candidates: int = 20
    boost_cap: float = 0.45

    # Evidence and answers.
    pack_chars_per_chunk: int = 1600
    pack_total_chars: int = 10_000
    answer_max_chunks: int = 8
    direct_chars_per_chunk: int = 900
    direct_total_chars: int = 4500
    preview_chars: int = 300

    # Observer and job thresholds.
    observer_sync_window: int = 20
    observer_parser_error_rate: float = 0.10
    observer_min_recall: float = 0.60
    observer_max_wrong_rate: float = 0.25
    observer_p95_ms: int = 1500
    logging_event_limit: int = 500
    index_max_retries: int = 3
    dispatch_batch: int = 50
    reclaim_idle_ms: int = 60_000
    request_limit: int = 30
    request_window_seconds: int = 60
    deploy_before_minutes: int = 15
    deploy_after_minutes: int = 120

    @property
    def window_words(self) -> int:
        return int(self.max_chunk_tokens / self.tokens_per_word)

    @property
    def overlap_words(self) -> int:
        return int(self.overlap_tokens / self.tokens_per_word)

    @property
    def stride_words(self) -> int:
        return self.window_words - self.overlap_words


DEFAULTS = Defaults()
