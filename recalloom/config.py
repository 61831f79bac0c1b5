"""Defaults shared by every operator.

The values under "fixed values" decide results and are kept together so they
can be compared with the documentation at a glance.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
TOP_K = 5
RECALL_TOP_KS = (5, 10)
RRF_K = 60
PREFETCH_FACTOR = 2
BM25_K1 = 1.5
BM25_B = 0.75
COVERAGE_THRESHOLD = 0.7
MIN_SECTION_CHARS = 50
DEFAULT_SECTION_TITLE = "正文"
SUMMARY_MAX_CHARS = 3000
SUMMARY_WINDOW_CHARS = 2000
SUMMARY_FALLBACK_CHARS = 80
HEADER_SPLIT_CHARS = 1500
HEADER_SPLIT_OVERLAP = 150
FALLBACK_SPLIT_CHARS = 3000
REWRITES_PER_QUESTION = 3
REWRITE_MIN_CHARS = 4
INDEX_LINE_MIN_CHARS = 3
RERANK_MIN = 0.0
RERANK_MAX = 10.0
RERANK_ON_FAILURE = 5.0
RERANK_TOP_N = 5
SCORE_REQUIRED = 70
SCORE_OPTIONAL = 20
SCORE_REFERENCE = 10
SURPLUS_PENALTY = 5
SURPLUS_CAP = 30
EXPORT_CELL_CHARS = 30000
FUSION_WEIGHTS = (0.5, 0.5)
EMBED_DIM_LOCAL = 512
EMBED_DIM_REMOTE = 1024
NAME_SEPARATOR = "__"
# ----------------------------------------------------------------------------

SCORE_DECIMALS = 6
DEFAULT_KB = os.getenv("DEFAULT_KB", "demo")

# A side may be broadcast up to this size; above it the join shuffles.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Question text whose tokens may be broadcast.
QUERY_TEXT_MAX_BYTES = 4 * 1024 * 1024


@dataclass
class RecallConfig:
    """A recall experiment: one dimension varies, the others stay fixed."""

    name: str = "recall"
    kb: str = DEFAULT_KB
    variable: str = "chunker"
    values: list[str] = field(default_factory=list)
    chunker: str = "fixed_1100"
    retriever: str = "hybrid"
    reranker: str = "direct"
    top_k_values: list[int] = field(default_factory=lambda: list(RECALL_TOP_KS))
    section_mode: str = "presplit"
    with_meta: bool = False
    threshold: float = COVERAGE_THRESHOLD
    charset: str = "cjk"


@dataclass
class FullConfig(RecallConfig):
    """A full experiment adds answer generation and rubric scoring."""

    name: str = "full"
    top_k: int = TOP_K
    score_mode: str = "rubric"
    runs: int = 1
