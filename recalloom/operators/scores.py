"""Rubric scoring over answer tables and its roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scoring import rerank_score, score_columns, score_reason

__all__ = ["RUBRICS", "score_reasons", "to_grade", "grade", "score_rollup", "grading_prompt",
           "rerank_score"]

_REPLY_FORMAT = (
    'Reply with JSON only: {"评分理由": [...], "总分": n}. List one item per point, written '
    '"[必答]i: 得分" or "[必答]i: 0分", likewise "[选答]i: ..." and "[参考文件]i: ...", each followed by a '
    'reason; add "(surplus)" for every statement beside the question and "[冲突点]" if the answer '
    "contradicts the reference points.")

# Instructions of the two grading modes, given to the model as its system text.
RUBRICS = {
    "rubric": "You grade an answer against reference points. A required or optional point counts "
              "when the answer conveys it; a reference file counts when it is cited. " + _REPLY_FORMAT,
    "strict": "You grade an answer strictly against reference points. A point counts only when the "
              "answer states its core meaning precisely and with the same conclusion; a reference "
              "file counts only when it is named exactly. " + _REPLY_FORMAT,
}


def score_reasons(reasons: DataFrame, reason: str = "reason", strict: bool = False) -> DataFrame:
    """Add ``total, required, optional, reference``."""
    return reasons.withColumns(score_columns(F.col(reason), strict))


def to_grade(answers: DataFrame, graded: DataFrame,
             key: tuple[str, ...] = ("strategy", "query_id", "run")) -> DataFrame:
    """Answers that still need a grade: not blank and not scored before."""
    open_answers = answers.where(F.btrim(F.coalesce("answer", F.lit(""))) != "")
    return open_answers.join(graded.select(*key), list(key), "left_anti")


def grading_prompt() -> Column:
    """What a grading model is given about one answer, as JSON."""
    fields = {"问题": "question", "参考要点": "point", "必答点": "required_points",
              "选答点": "optional_points", "参考文件": "ref_file", "ai答案": "answer"}
    return F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in fields.items()]))


def grade(answers: DataFrame, model: Callable[[Column], Column],
          graded: DataFrame | None = None) -> DataFrame:
    """Score every answer not graded before and return old and new scores together."""
    key = ("strategy", "query_id", "run")
    todo = answers if graded is None else to_grade(answers, graded, key)
    reply = todo.withColumn("reason", score_reason(model(grading_prompt())))
    new = score_reasons(reply).select(*key, "total", "required", "optional", "reference", "reason")
    return new if graded is None else new.unionByName(graded.select(*new.columns))


def score_rollup(scores: DataFrame) -> DataFrame:
    """Per strategy: mean of each question's best run, and mean of all runs."""
    best = scores.groupBy("strategy", "query_id").agg(
        F.max("total").alias("_best"), F.sum("total").alias("_sum"),
        F.count("total").alias("_n"))
    best_avg = F.round(F.avg("_best"), config.SCORE_DECIMALS)
    all_avg = F.round(F.sum("_sum") / F.sum("_n"), config.SCORE_DECIMALS)
    return best.groupBy("strategy").agg(
        best_avg.alias("best_avg"), F.coalesce(all_avg, best_avg).alias("all_avg"),
        F.count(F.lit(1)).alias("n_questions"))
