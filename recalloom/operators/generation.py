"""Answer generation: context text and one model call per question."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
NO_REFERENCE = "（无参考信息）"
NO_RESULT = "（无检索结果）"
SOURCE_LABEL = "来源"
MATCH_LABEL = "匹配: "
MATCH_CHARS = 60
# ----------------------------------------------------------------------------


def context_text(hits: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The hits of each question as one numbered text. A group is one top-k list."""
    unique = hits.dropDuplicates([*by, "chunk_id"])
    listed = F.array_sort(F.collect_list(F.struct("rank", "source", "content_text", "index_text")))

    def block(hit, i):
        label = F.concat(F.lit(f"[{SOURCE_LABEL}"), (i + 1).cast("string"), F.lit(": "),
                         F.coalesce(hit["source"], F.lit("?")), F.lit("]"))
        differs = (F.coalesce(hit["index_text"], F.lit("")) != "") & (
            hit["index_text"] != hit["content_text"])
        note = F.when(differs, F.concat(F.lit(f" ({MATCH_LABEL}"), F.substring(
            hit["index_text"], 1, MATCH_CHARS), F.lit(")"))).otherwise(F.lit(""))
        return F.concat(label, note, F.lit("\n"), hit["content_text"])

    return unique.groupBy(*by).agg(
        F.array_join(F.transform(listed, block), "\n\n").alias("context"))


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the numbered sources only; say so when they "
                          "do not contain the answer.\n\n"),
                    F.coalesce(context, F.lit(NO_REFERENCE)), F.lit("\n\nQuestion: "), question)


def generate_answers(questions: DataFrame, hits: DataFrame, model: Callable[[Column], Column],
                     by: Sequence[str] = ("pipeline",), runs: int = 1) -> DataFrame:
    """``by..., query_id, run, answer``: one model call per question and run.

    A question without hits is not sent to the model.
    """
    ctx = context_text(hits, (*by, "query_id"))
    each = F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")
    asked = ctx.join(questions.select("query_id", "question"), "query_id").select("*", each)
    return asked.select(*by, "query_id", "run", model(
        answer_prompt(F.col("question"), F.col("context"))).alias("answer"))


def fill_unanswered(answers: DataFrame, grid: DataFrame,
                    by: Sequence[str] = ("pipeline", "run")) -> DataFrame:
    """Questions of ``grid`` without an answer row get the fixed no-result text."""
    return grid.select(*by, "query_id").join(answers, [*by, "query_id"], "left").fillna(
        NO_RESULT, subset=["answer"])
