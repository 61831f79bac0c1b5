"""Rank fusion of several retrieval routes.

Every function takes one long table ``query..., route, rank, score, <key>`` and returns
one ranked list per query. Groups hold at most (routes x prefetch) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..scale import top_k


def _ranked(fused: DataFrame, query: Sequence[str], key: str, k: int | None) -> DataFrame:
    order = [F.desc("fusion_score"), F.asc("first_route"), F.asc("first_rank"), F.asc(key)]
    return top_k(fused, query, order, k)


def _combine(routes: DataFrame, query: Sequence[str], key: str, value, how) -> DataFrame:
    """One row per query and key. The representative is the hit with the best own score;
    ``first_route`` and ``first_rank`` keep first-seen order for ties."""
    rest = [c for c in routes.columns if c not in query]
    same = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) != "", F.struct(F.lit(0).alias("by"), F.col(key).cast("string").alias("key")))
    if key != "chunk_id" and "chunk_id" in routes.columns:
        # A hit with a blank key stands for itself.
        same = F.coalesce(same, F.struct(F.lit(1).alias("by"), F.col("chunk_id").cast("string").alias("key")))
    usable = routes.withColumn("_same", same).where("_same is not null")
    seen = F.min(F.struct("route", "rank"))
    best = F.max_by(F.struct(*rest), F.struct(
        F.coalesce("score", F.lit(0.0)), -F.col("route"), -F.col("rank")))
    fused = usable.withColumn("_v", value).groupBy(*query, "_same").agg(
        F.round(how("_v"), config.SCORE_DECIMALS).alias("fusion_score"),
        seen.alias("_seen"), best.alias("_best"))
    return fused.select(*query, "fusion_score", F.col("_seen.route").alias("first_route"),
                        F.col("_seen.rank").alias("first_rank"),
                        *[F.col(f"_best.{c}").alias(c) for c in rest if c not in ("route", "rank")])


def rrf(routes: DataFrame, k: int | None = None, rrf_k: int = config.RRF_K,
        query: Sequence[str] = ("query_id",), key: str = "chunk_id",
        mode: str = "sum") -> DataFrame:
    """Reciprocal rank fusion: the sum, or with ``mode="max"`` the best, of 1/(rrf_k+rank)."""
    how = {"sum": F.sum, "max": F.max}[mode]
    fused = _combine(routes, query, key, 1.0 / (F.lit(rrf_k) + F.col("rank")), how)
    return _ranked(fused, query, key, k)


def weighted_max(routes: DataFrame, weights: Sequence[float] = config.FUSION_WEIGHTS,
                 k: int | None = None, query: Sequence[str] = ("query_id",),
                 key: str = "chunk_id") -> DataFrame:
    """Scores scaled to 0..1 within each list, weighted by route; the best one counts.

    A list of equal scores scales to 0.
    """
    w = Window.partitionBy(*query, "route")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = (F.col("score") - low) / (high - low + F.lit(1e-9))
    by_route = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("route"))
    return _ranked(_combine(routes.withColumn("_scaled", scaled), query, key,
                            F.col("_scaled") * by_route, F.max).drop("_scaled"), query, key, k)


def union_routes(*lists: DataFrame) -> DataFrame:
    """Number ranked lists as routes 0, 1, ... of one table."""
    head, *tail = [df.withColumn("route", F.lit(i)) for i, df in enumerate(lists)]
    for df in tail:
        head = head.unionByName(df)
    return head
