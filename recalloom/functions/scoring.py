"""Rubric scores from the reasons a grading model returns."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config

# --- fixed values -----------------------------------------------------------
REQUIRED_MARK = r"\[必答\](\d+):.*?(得分|0分)"
OPTIONAL_MARK = r"\[选答\](\d+):.*?(得分|0分)"
REFERENCE_MARK = r"\[参考文件\](\d+):.*?(得分|0分)"
REQUIRED_MARK_STRICT = r"\[必答\](\d+):.*?(得分|(?<!\d)0分)"
OPTIONAL_MARK_STRICT = r"\[选答\](\d+):.*?(得分|(?<!\d)0分)"
REFERENCE_MARK_STRICT = r"\[参考文件\](\d+):.*?(得分|(?<!\d)0分)"
SURPLUS_MARK = r"\(surplus\)"
CONFLICT_MARK = "[冲突点]"
MISS = "0分"
NUMBERED_ITEM = r"\d+\..*?(?=\d+\.|\z)"
REASON_KEY = "评分理由"
# ----------------------------------------------------------------------------


def _literal_to_json(reply: Column) -> Column:
    """A reply written as a Python literal, as JSON; null when it is not one."""
    def convert(text):
        try:
            value = ast.literal_eval(text)
            return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
        except Exception:
            return None

    @F.pandas_udf(T.StringType())
    def literal(replies: pd.Series) -> pd.Series:
        return replies.map(convert)

    return literal(reply)


def _numbered(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(NUMBERED_ITEM), F.lit(0)), "\n")


def _reason_of(json_text: Column, strip) -> Column:
    """Reasons of a JSON reply: its string items line by line, or a numbered string."""
    node = F.try_parse_json(json_text)
    path = f"$['{REASON_KEY}']"
    items = F.try_variant_get(node, path, "array<variant>")
    kept = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    lines = F.transform(kept, lambda v: strip(F.variant_get(v, "$", "string")))
    text = F.when(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING",
                  F.try_variant_get(node, path, "string"))
    return F.coalesce(F.array_join(lines, "\n"), _numbered(text), F.lit(""))


def score_reason(reply: Column, literals: bool = True) -> Column:
    """Reason text of a grading reply: JSON, else a Python literal, else numbered items.

    Both are also found between code fences or other words around the outermost braces.
    """
    from .text import fenced_json, strip

    inner = fenced_json(reply)
    reply_json = F.when(F.try_parse_json(reply).isNotNull(), reply).when(F.try_parse_json(inner).isNotNull(), inner)
    fallback = _numbered(reply)
    if literals:
        as_json = _literal_to_json(F.when(inner != "", inner).otherwise(reply))
        fallback = F.when(as_json.isNotNull(), _reason_of(as_json, strip)).otherwise(fallback)
    return F.when(F.coalesce(reply, F.lit("")) == "", F.lit("")).when(
        reply_json.isNotNull(), _reason_of(reply_json, strip)).otherwise(fallback)


def score_columns(reason: Column, strict: bool = False) -> dict[str, Column]:
    """Total and partial scores of a reason text.

    The compatible patterns read ``10分`` as a miss; ``strict`` does not.
    """
    marks = ((REQUIRED_MARK_STRICT, OPTIONAL_MARK_STRICT, REFERENCE_MARK_STRICT) if strict
             else (REQUIRED_MARK, OPTIONAL_MARK, REFERENCE_MARK))
    weights = (config.SCORE_REQUIRED, config.SCORE_OPTIONAL, config.SCORE_REFERENCE)
    empty = F.coalesce(reason, F.lit("")) == ""
    parts, deductions = [], []
    for mark, weight in zip(marks, weights):
        verdicts = F.regexp_extract_all(reason, F.lit(mark), F.lit(2))
        n = F.size(verdicts)
        missed = F.size(F.filter(verdicts, lambda v: v == MISS))
        lost = F.when(n > 0, F.lit(float(weight)) / n * missed).otherwise(0.0)
        deductions.append(lost)
        parts.append(F.when(empty | (n <= 0), 0.0).otherwise(F.lit(float(weight)) - lost))
    surplus = F.least(F.regexp_count(reason, F.lit(SURPLUS_MARK)) * config.SURPLUS_PENALTY,
                      F.lit(config.SURPLUS_CAP))
    core = F.lit(100.0) - (deductions[0] + deductions[1] + deductions[2])
    total = F.when(empty | F.contains(reason, F.lit(CONFLICT_MARK)), 0.0).otherwise(
        F.greatest(core - surplus, F.lit(0.0)))
    names = ("total", "required", "optional", "reference")
    return {name: F.round(col, 2) for name, col in zip(names, (total, *parts))}


def rerank_score(reply: Column) -> Column:
    """First number of a reply, clamped; a reply without one scores the middle value."""
    number = F.regexp_extract(reply, r"[-+]?\d*\.?\d+", 0).try_cast("double")
    clamped = F.greatest(F.least(number, F.lit(config.RERANK_MAX)), F.lit(config.RERANK_MIN))
    return F.when(number.isNull(), F.lit(config.RERANK_ON_FAILURE)).otherwise(clamped)
