"""Named chunkers, retrievers and rerankers.

A name stands for a function, never for a class path to import, so a configuration cannot
run code of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.models import Model
from ..operators import chunkers
from ..operators.search import RETRIEVERS

Chunk = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Chunker:
    """How sections become chunks. ``source`` tells which sections it wants."""

    build: Callable[..., DataFrame]
    description: str
    source: str = "sections"
    needs_model: bool = False
    allows_meta: bool = True


def _recursive(size: int, overlap: int = 0) -> Callable[..., DataFrame]:
    return lambda sections, model=None: chunkers.recursive(sections, size, overlap)


def _tokens(size: int, overlap: int = 0) -> Callable[..., DataFrame]:
    return lambda sections, model=None: chunkers.token_windows(sections, size, overlap)


def _family(overlap: int) -> Callable[..., DataFrame]:
    return lambda sections, model=None: chunkers.recursive_parent_child(
        sections, 1100, 150, overlap)


# --- fixed values: strategy names and their sizes ----------------------------
CHUNKERS: dict[str, Chunker] = {
    "fixed_1100": Chunker(_recursive(1100), "1100 characters, no overlap"),
    "fixed_1100_ovl150": Chunker(_recursive(1100, 150), "1100 characters, 150 overlap"),
    "fixed_1100_ovl150_pure": Chunker(_recursive(1100, 150), "1100 characters, 150 overlap, "
                                      "never with metadata", allows_meta=False),
    "fixed_1500": Chunker(_recursive(1500), "1500 characters, no overlap"),
    "fixed_1500_ovl150": Chunker(_recursive(1500, 150), "1500 characters, 150 overlap"),
    "fixed_1500_ovl200": Chunker(_recursive(1500, 200), "1500 characters, 200 overlap"),
    "token_1024": Chunker(_tokens(1024), "1024 tokens, no overlap"),
    "token_1024_ovl100": Chunker(_tokens(1024, 100), "1024 tokens, 100 overlap"),
    "token_1536": Chunker(_tokens(1536), "1536 tokens, no overlap"),
    "token_1536_ovl150": Chunker(_tokens(1536, 150), "1536 tokens, 150 overlap"),
    "header_aware_h6": Chunker(lambda sections, model=None: chunkers.header_aware(sections),
                               "cut at headings of level 1 to 6", source="headers"),
    "llm_index": Chunker(lambda sections, model=None: chunkers.paragraph_indexes(sections, model),
                         "paragraphs with index texts written by a model", needs_model=True),
    "parent_child_v1": Chunker(_family(0), "search 150-character children, return 1100-character parents"),
    "parent_child_v2": Chunker(_family(150), "the same with parents overlapping by 150"),
}
# ----------------------------------------------------------------------------

RERANKERS = {
    "direct": "keep the retrieved order",
    "llm_rerank": "order by a score from 0 to 10 given by a model",
    "bge_reranker": "order by a cross-encoder score and keep the best",
}


def chunker(name: str) -> Chunker:
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; one of {', '.join(CHUNKERS)}")
    return CHUNKERS[name]


def register_chunker(name: str, entry: Chunker) -> None:
    """Add a strategy of one's own, for example around ``guarded_chunks``."""
    if name in CHUNKERS:
        raise ValueError(f"chunker {name!r} exists")
    CHUNKERS[name] = entry


def names(kind: str = "chunker") -> list[str]:
    kinds = {"chunker": list(CHUNKERS), "retriever": list(RETRIEVERS), "reranker": list(RERANKERS)}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(kinds)}")
    return kinds[kind]


__all__ = ["CHUNKERS", "Chunker", "Model", "RERANKERS", "chunker", "names", "register_chunker"]
