"""Test sets: questions with gold answers, scoring points and reference files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..scale import numbered
from . import xlsx

# --- fixed values -----------------------------------------------------------
# Header -> column; the second name of a pair is used when the first is absent or blank.
COLUMNS = {
    "gold_answer": ("正确回答", "参考答案"),
    "point": ("point",),
    "required_points": ("必答点",),
    "optional_points": ("选答点",),
    "ref_file": ("参考文件", "文件来源"),
}
# ----------------------------------------------------------------------------


def shape_test_set(rows: DataFrame, row_number: str) -> DataFrame:
    """``query_id, question, gold_answer, point, required_points, optional_points, ref_file``.

    The first column is the question, whatever its name. Rows with a blank question are
    skipped; the others keep the id of their place, ``Q1`` for the first data row.
    """
    columns = [c for c in rows.columns if c != row_number]
    by_name = {c.strip(): c for c in columns}

    def text(name):
        return F.coalesce(F.col(f"`{by_name[name]}`").cast("string"), F.lit(""))

    picked = []
    for target, names in COLUMNS.items():
        have = [F.when(text(n) != "", text(n)) for n in names if n in by_name]
        picked.append(F.coalesce(*have, F.lit("")).alias(target))
    question = strip(F.coalesce(F.col(f"`{columns[0]}`").cast("string"), F.lit("")))
    return rows.select(
        F.concat(F.lit("Q"), (F.col(row_number).cast("long") - 1).cast("string")).alias("query_id"),
        question.alias("question"), *picked).where(F.col("question") != "")


def read_test_set(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Read an ``.xlsx``, ``.csv`` or Parquet test set."""
    if path.endswith(".xlsx"):
        xlsx.register(spark)
        reader = spark.read.format("xlsx")
        rows = (reader.option("sheet", sheet) if sheet else reader).load(path)
        return shape_test_set(rows, "_row")
    rows = (spark.read.option("header", True).option("multiLine", True).csv(path)
            if path.endswith(".csv") else spark.read.parquet(path))
    if "_row" not in rows.columns:
        # Files by name, their blocks by place, then rows as they stand in a block.
        names = rows.columns
        placed = rows.select("*", F.col("_metadata.file_path").alias("_order_path"), F.col("_metadata.file_block_start").alias("_order_block"),
                             F.monotonically_increasing_id().alias("_order_line"))
        order = [F.asc("_order_path"), F.asc("_order_block"), F.asc("_order_line")]
        rows = numbered(placed, order, "_row", 2).select(*[F.col(f"`{c}`") for c in names], "_row")
    return shape_test_set(rows, "_row")


def read_gold_table(spark: SparkSession, path: str) -> DataFrame:
    """A workbook of raw questions and answers as it stands, for preparation."""
    xlsx.register(spark)
    return spark.read.format("xlsx").load(path).drop("_row")
