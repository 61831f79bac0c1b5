"""Question-by-question comparison of two strategies.

``results`` is long: ``query_id, strategy, score, recall, hit_rank`` plus optional texts.
The two strategies are brought side by side by one aggregation over ``query_id``; a
missing score counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..scale import broadcast_if_small

# --- fixed values -----------------------------------------------------------
BOTH, ONLY_A, ONLY_B, NEITHER = "双召", "A独召", "B独召", "双失"
QUESTION_CHARS = 80
ANSWER_CHARS = 500
# ----------------------------------------------------------------------------


def _r(c: Column) -> Column:
    return F.round(c, config.SCORE_DECIMALS)


def side_by_side(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row per question with ``score_a, score_b, recall_a, recall_b, rank_a, rank_b``."""
    def of(strategy, column, default):
        return F.coalesce(F.max(F.when(F.col("strategy") == strategy, F.col(column))),
                          F.lit(default))

    return results.where(F.col("strategy").isin(a, b)).groupBy("query_id").agg(
        of(a, "score", 0.0).alias("score_a"), of(b, "score", 0.0).alias("score_b"),
        of(a, "recall", 0).alias("recall_a"), of(b, "recall", 0).alias("recall_b"),
        of(a, "hit_rank", 0).alias("rank_a"), of(b, "hit_rank", 0).alias("rank_b"))


def win_draw_lose(pairs: DataFrame) -> DataFrame:
    """Wins, draws and losses; the mean lead is over the wins only."""
    lead = F.col("score_a") - F.col("score_b")
    return pairs.agg(
        F.count_if(lead > 0).alias("a_wins"),
        _r(F.coalesce(F.avg(F.when(lead > 0, lead)), F.lit(0.0))).alias("a_mean_lead"),
        F.count_if(lead == 0).alias("draws"), F.count_if(lead < 0).alias("b_wins"),
        _r(F.coalesce(F.avg(F.when(lead < 0, -lead)), F.lit(0.0))).alias("b_mean_lead"))


def score_diff(pairs: DataFrame) -> DataFrame:
    """Every question with its difference A - B. Sort by ``diff`` descending to read it."""
    return pairs.withColumn("diff", _r(F.col("score_a") - F.col("score_b")))


def recall_cross(pairs: DataFrame) -> DataFrame:
    """The four recall buckets with counts and mean scores; empty buckets stay listed."""
    a, b = F.col("recall_a") > 0, F.col("recall_b") > 0
    bucket = F.when(a & b, BOTH).when(a, ONLY_A).when(b, ONLY_B).otherwise(NEITHER)
    cells = pairs.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("score_a")).alias("mean_a"),
        _r(F.avg("score_b")).alias("mean_b"))
    labels = pairs.sparkSession.createDataFrame([(x,) for x in (BOTH, ONLY_A, ONLY_B, NEITHER)],
                                                "bucket string")
    return labels.join(F.broadcast(cells), "bucket", "left").fillna(
        0, subset=["n", "mean_a", "mean_b"])


def score_breakdown(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Mean partial scores of both strategies."""
    parts = ("required", "optional", "reference")
    return scores.where(F.col("strategy").isin(a, b)).groupBy("strategy").agg(
        *[_r(F.avg(F.coalesce(p, F.lit(0.0)))).alias(f"mean_{p}") for p in parts])


def top_divergence(pairs: DataFrame, n: int = 5, texts: DataFrame | None = None) -> DataFrame:
    """The ``n`` questions with the largest absolute difference, numbered from 1.

    ``texts`` may add ``question, gold_answer, answer_a, answer_b``, cut for reading.
    """
    diff = score_diff(pairs)
    worst = diff.orderBy(F.abs("diff").desc(), F.asc("query_id")).limit(n)
    if texts is None:
        return worst
    cut = texts.select("query_id", F.substring("question", 1, QUESTION_CHARS).alias("question"),
                       "gold_answer",
                       F.substring("answer_a", 1, ANSWER_CHARS).alias("answer_a"),
                       F.substring("answer_b", 1, ANSWER_CHARS).alias("answer_b"))
    return cut.join(broadcast_if_small(worst), "query_id", "right")


def compare(results: DataFrame, a: str, b: str, scores: DataFrame | None = None,
            n: int = 5) -> dict[str, DataFrame]:
    """The whole comparison. Strategy names must match exactly and exist."""
    known = {r[0] for r in results.select("strategy").distinct().where(
        F.col("strategy").isin(a, b)).collect()}
    missing = {a, b} - known
    if missing:
        raise ValueError(f"no results for {', '.join(sorted(missing))}")
    pairs = side_by_side(results, a, b)
    means = pairs.agg(_r(F.avg("score_a")).alias("mean_a"), _r(F.avg("score_b")).alias("mean_b"),
                      F.count(F.lit(1)).alias("n_questions"))
    report = {"means": means, "win_draw_lose": win_draw_lose(pairs), "diff": score_diff(pairs),
              "recall_cross": recall_cross(pairs), "top_divergence": top_divergence(pairs, n)}
    if scores is not None:
        report["breakdown"] = score_breakdown(scores, a, b)
    return report
