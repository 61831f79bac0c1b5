"""Sinks and sources for experiment results, reports and the cost ledger."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import export_text, result_grid
from ..scale import is_small
from . import xlsx

# Rows a report page may show; pages are made of strategies, not of questions.
REPORT_MAX_ROWS = 10_000


def collect_results(spark: SparkSession, out: str) -> DataFrame:
    """Rates of every experiment below a directory: ``{out}/{experiment}/rates``."""
    return spark.read.option("recursiveFileLookup", False).option("basePath", out).parquet(
        *[f"{out}/{name}/rates" for name in sorted(os.listdir(out))
          if not name.startswith("_") and os.path.isdir(f"{out}/{name}/rates")])


def save_workbook(sheets: dict[str, DataFrame], out: str) -> None:
    """One directory of workbooks per sheet, written by the tasks that hold the rows."""
    for name, df in sheets.items():
        xlsx.register(df.sparkSession)
        export_text(df).write.format("xlsx").option("sheet", name).mode("overwrite").save(f"{out}/{name}")


def recall_sheets(recall: DataFrame, rates: DataFrame, test_set: DataFrame, pipelines: Sequence[str],
                  top_k: int) -> dict[str, DataFrame]:
    """Summary and roll-up sheet of one k under their exported headers."""
    headers = {"single": "召回", "hit_rank": "召回位置", "merged": "合并召回", "concat": "拼接召回",
               "file": "文件召回"}
    grid = result_grid(recall.where(F.col("top_k") == top_k), pipelines)
    for p in pipelines:
        for column, title in headers.items():
            name = f"{p}_{column}"
            if name in grid.columns:
                value = F.col(f"`{name}`")
                if column == "hit_rank":
                    value = F.when(value > 0, F.concat(F.lit("top"), value.cast("string"))).otherwise("0")
                grid = grid.withColumn(f"{p}_{title}", value).drop(name)
    summary = test_set.select(F.col("query_id").alias("问题ID"), F.col("question").alias("问题"),
                              F.col("gold_answer").alias("正确回答"), F.col("ref_file").alias("参考文件")) \
        .join(grid.withColumnRenamed("query_id", "问题ID"), "问题ID", "left")

    def percent(c):
        return F.round(F.col(c), 1)

    place = F.when(F.col("avg_hit_rank") > 0, F.concat(
        F.lit("top"), F.round("avg_hit_rank", 2).cast("string"))).otherwise("--")
    rollup = rates.where(F.col("top_k") == top_k).select(
        F.col("pipeline").alias("策略"), percent("single_rate").alias("召回率(%)"),
        percent("merged_rate").alias("合并召回率(%)"), percent("concat_rate").alias("拼接召回率(%)"),
        place.alias("平均命中位置"), percent("file_rate").alias("文件召回率(%)"))
    return {"汇总": summary, "综合召回": rollup}


def save_jsonl(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").json(out)


def html_report(table: DataFrame, title: str, path: str, bars: Sequence[str] = (),
                label: str = "pipeline") -> str:
    """A ranked table with bars, for tables of strategies. Too long a table is refused."""
    if not is_small(table, REPORT_MAX_ROWS):
        raise ValueError(f"a report page shows at most {REPORT_MAX_ROWS} rows")
    rows = [r.asDict() for r in table.collect()]
    rows.sort(key=lambda r: r.get("place") or 0)

    def cell(v):
        return "--" if v is None else html.escape(f"{v:.2f}" if isinstance(v, float) else str(v))

    head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in table.columns) + "</tr>"
                     for r in rows)
    charts = ""
    for column in bars:
        top = max((r[column] or 0 for r in rows), default=0) or 1
        lines = "".join(
            f'<div class="bar"><span>{html.escape(str(r[label]))}</span>'
            f'<i style="width:{(r[column] or 0) / top * 100:.1f}%"></i><b>{cell(r[column])}</b></div>'
            for r in rows)
        charts += f"<section><h2>{html.escape(column)}</h2>{lines}</section>"
    page = f"""<!DOCTYPE html><html lang="zh"><head><meta charset="utf-8"><title>{html.escape(title)}</title>
<style>body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:4px 8px}}
.bar{{display:flex;gap:8px}}.bar span{{width:16em}}.bar i{{background:#48a;height:1em;max-width:50%}}</style></head>
<body><h1>{html.escape(title)}</h1>{charts}<table><tr>{head}</tr>
{body}</table></body></html>"""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path


class Ledger:
    """Append-only cost ledger with an optional budget."""

    SCHEMA = "task string, cost double, at timestamp"

    def __init__(self, spark: SparkSession, path: str, budget: float | None = None):
        self.spark, self.path, self.budget = spark, path, budget

    def read(self) -> DataFrame:
        from pyspark.errors import AnalysisException
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def add(self, entries: DataFrame) -> None:
        entries.select("task", F.col("cost").cast("double"), F.current_timestamp().alias("at")) \
            .write.mode("append").parquet(self.path)

    def total(self) -> float:
        return self.read().agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]

    def remaining(self) -> float | None:
        return None if self.budget is None else self.budget - self.total()

    def require(self, task: str) -> None:
        left = self.remaining()
        if left is not None and left <= 0:
            raise RuntimeError(f"budget used up before {task}")

    def reset(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)


def describe(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2, default=str)
