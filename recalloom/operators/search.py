"""Batch search over one index: vector, bm25, hybrid and multi-query retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import BROADCAST_MAX_ROWS
from ..functions.text import Tokenizer, word_tokens
from ..scale import is_small, top_k
from . import fusion
from .bm25 import SparseIndex, sparse_topk
from .dense import dense_topk

RETRIEVERS = ("vector", "bm25", "hybrid", "hybrid_rrf", "weighted", "rrf_max")

# Fields of a hit, in the order they are shown.
HIT_FIELDS = ("content_text", "index_text", "source", "file_id", "section_id", "chunk_id",
              "file_name", "file_type", "file_summary", "section_summary", "section_title")


@dataclass(frozen=True)
class Index:
    """What one search runs on. ``vectors`` may be absent for a pure keyword index."""

    chunks: DataFrame
    sparse: SparseIndex | None = None
    vectors: DataFrame | None = None
    tokenizer: Tokenizer = word_tokens


def retrieve(index: Index, queries: DataFrame, retriever: str = "hybrid",
             k: int = config.TOP_K, rrf_k: int = config.RRF_K,
             weights=config.FUSION_WEIGHTS) -> DataFrame:
    """``query_id, chunk_id, score, rank`` for a batch of queries.

    ``queries`` has ``query_id, question`` and, for the vector route, ``embedding``. A
    hybrid search fetches ``2k`` per route; a query or index without a sparse side
    contributes nothing there and so falls back to the vector route by itself.
    """
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}; one of {', '.join(RETRIEVERS)}")

    def sparse(n):
        return sparse_topk(index.sparse, queries, n, tokenizer=index.tokenizer)

    def dense(n):
        return dense_topk(index.vectors, queries, n)

    if retriever == "bm25":
        if index.sparse is None:
            raise ValueError("the index has no sparse side for a bm25 search")
        return sparse(k)
    if retriever == "vector" or index.sparse is None:
        return dense(k)
    wide = k * config.PREFETCH_FACTOR
    lists = [dense(wide), sparse(wide)] if index.vectors is not None else [sparse(wide)]
    routes = fusion.union_routes(*lists)
    if retriever == "weighted":
        fused = fusion.weighted_max(routes, weights, k)
    else:
        fused = fusion.rrf(routes, k, rrf_k, mode="max" if retriever == "rrf_max" else "sum")
    return fused.select("query_id", "chunk_id", F.col("fusion_score").alias("score"), "rank")


def with_payload(hits: DataFrame, chunks: DataFrame, queries: DataFrame | None = None,
                 k: int = config.TOP_K) -> DataFrame:
    """Attach the stored fields of each hit.

    There are at most ``k`` hits per query, so counting the queries tells whether the hits
    may be broadcast; the chunks never are. Without ``queries`` the hits are left to
    shuffle with the chunks.
    """
    small = queries is not None and is_small(queries, BROADCAST_MAX_ROWS // k)
    return chunks.join(F.broadcast(hits) if small else hits, "chunk_id")


def normalise_hits(hits: DataFrame) -> DataFrame:
    """The thirteen fields of a hit; absent ones are empty, with the usual stand-ins."""
    have = set(hits.columns)

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(""))

    stand_ins = {"content_text": ("content_text", "page_content"),
                 "index_text": ("page_content", "index_text"),
                 "source": ("source", "file_id")}
    lead = [c for c in ("query_id", "rank") if c in have]
    ident = F.col("id" if "id" in have else "chunk_id").alias("id")
    return hits.select(*lead, ident, "score",
                       *[pick(*stand_ins.get(f, (f,))).alias(f) for f in HIT_FIELDS])


def search(index: Index, queries: DataFrame, retriever: str = "hybrid",
           k: int = config.TOP_K) -> DataFrame:
    """Search and return full hits."""
    return normalise_hits(with_payload(
        retrieve(index, queries, retriever, k), index.chunks, queries, k))


def multi_query(index: Index, queries: DataFrame, rewrites: DataFrame, retriever: str = "hybrid",
                k: int = config.TOP_K, key: str = "chunk_id") -> DataFrame:
    """Each question and its rewrites searched as one batch, fused per question.

    ``rewrites`` has ``query_id, route`` (from 1) and ``question`` (plus ``embedding``).
    ``key="content_text"`` merges chunks of equal text.
    """
    cols = ["query_id", "route", *[c for c in queries.columns if c != "query_id"]]
    batch = queries.withColumn("route", F.lit(0)).select(*cols).unionByName(rewrites.select(*cols))
    routed = batch.withColumn("query_id", F.struct("query_id", "route"))
    hits = retrieve(index, routed.drop("route"), retriever, k).select(
        F.col("query_id.query_id").alias("query_id"), F.col("query_id.route").alias("route"),
        "chunk_id", "score", "rank")
    if key != "chunk_id":
        hits = with_payload(hits, index.chunks.select("chunk_id", key), batch, k)
    fused = fusion.rrf(hits, k, key=key)
    return fused.select("query_id", "chunk_id", F.col("fusion_score").alias("score"), "rank")


def relevance_order(hits: DataFrame, score: Column, top_n: int | None = None,
                    query: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rerank hits by a new score; equal scores keep their former order."""
    scored = hits.withColumn("rerank_score", score).withColumnRenamed("rank", "old_rank")
    return top_k(scored, query, [F.desc("rerank_score"), F.asc("old_rank")], top_n)


def overlap_score(question: Column, text: Column, tokenizer: Tokenizer = word_tokens) -> Column:
    """Share of distinct question tokens found in a text: the offline stand-in of a cross-encoder."""
    asked = F.array_distinct(tokenizer(question))
    shared = F.size(F.array_intersect(asked, tokenizer(text)))
    return F.round(shared / F.greatest(F.size(asked), F.lit(1)), config.SCORE_DECIMALS)
