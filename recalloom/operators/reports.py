"""Rankings and wide tables for reports, and the way back from wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..scale import top_k

# --- fixed values -----------------------------------------------------------
# Column suffix of an exported sheet -> name in the long table. Longer suffixes first.
SHEET_SUFFIXES = {"_召回位置": "hit_rank", "_合并召回": "merged", "_拼接召回": "concat",
                  "_文件召回": "file", "_召回": "recall", "_得分": "score", "_回答": "answer"}
# ----------------------------------------------------------------------------


def ranking(rates: DataFrame, score: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Number strategies by falling score; equal scores in name order."""
    return top_k(rates, by, [F.desc(score), F.asc(name)], None, "place")


def topk_matrix(rates: DataFrame, ks: Sequence[int],
                metrics: Sequence[str] = ("single_rate", "merged_rate", "concat_rate",
                                          "file_rate", "avg_hit_rank")) -> DataFrame:
    """One row per pipeline, columns by metric and k, best pipeline at the smallest k first."""
    have = [m for m in metrics if m in rates.columns]
    cells = [F.max(F.when(F.col("top_k") == k, F.col(m))).alias(f"{m}_top{k}")
             for m in have for k in ks]
    wide = rates.groupBy("pipeline").agg(*cells)
    return ranking(wide, f"{have[0]}_top{min(ks)}", "pipeline")


def result_grid(recall: DataFrame, pipelines: Sequence[str],
                columns: Sequence[str] = ("single", "hit_rank", "merged", "concat", "file")) -> DataFrame:
    """The wide sheet: one row per question, the columns of every pipeline side by side."""
    have = [c for c in columns if c in recall.columns]
    return recall.groupBy("query_id").agg(*[
        F.max(F.when(F.col("pipeline") == p, F.col(c))).alias(f"{p}_{c}")
        for p in pipelines for c in have])


def sheet_to_long(sheet: DataFrame, key: Sequence[str]) -> DataFrame:
    """Read a wide sheet back: columns ``{strategy}{suffix}`` become rows per strategy."""
    parts: dict[str, dict[str, str]] = {}
    for column in sheet.columns:
        if column in key:
            continue
        for suffix, name in SHEET_SUFFIXES.items():
            if column.endswith(suffix):
                parts.setdefault(column[: -len(suffix)], {})[name] = column
                break
    # A lone position column does not make a strategy.
    parts = {s: cols for s, cols in parts.items() if set(cols) != {"hit_rank"}}
    names = [n for n in SHEET_SUFFIXES.values() if any(n in cols for cols in parts.values())]

    def cell(cols, n):
        return (F.col(f"`{cols[n]}`") if n in cols else F.lit(None)).cast("string").alias(n)

    rows = [F.struct(F.lit(s).alias("strategy"), *[cell(cols, n) for n in names])
            for s, cols in parts.items()]
    return sheet.select(*[F.col(f"`{k}`") for k in key], F.explode(F.array(*rows)).alias("_r")).select(
        *[F.col(f"`{k}`") for k in key], "_r.*")


def detail_documents(sheet: DataFrame, key: Sequence[str], prefix: str = "检索内容",
                     source_prefix: str = "来源") -> DataFrame:
    """Repeating content/source column pairs of a detail sheet as an array of hits."""
    numbers = [c[len(prefix):] for c in sheet.columns if c.startswith(prefix)]

    def cell(name):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) \
            if name in sheet.columns else F.lit("")

    docs = F.array(*[F.struct(cell(f"{prefix}{n}").alias("content"),
                              cell(f"{source_prefix}{n}").alias("source")) for n in numbers])
    return sheet.select(*[F.col(f"`{k}`") for k in key], docs.alias("docs"))


def export_text(df: DataFrame) -> DataFrame:
    """Cut every string cell to what a sheet cell may hold."""
    return df.select(*[F.substring(f"`{n}`", 1, config.EXPORT_CELL_CHARS).alias(n)
                       if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def cost_report(ledger: DataFrame) -> DataFrame:
    """Calls and cost per task of the append-only ledger."""
    return ledger.groupBy("task").agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum("cost"), config.SCORE_DECIMALS).alias("cost"))
