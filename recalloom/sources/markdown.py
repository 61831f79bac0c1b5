"""Knowledge bases: directories of Markdown files, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_markdown

# What a whole-text file scan yields, also needed to declare a stream of it.
FILE_SCHEMA = "value string"
PAGE_END = "\n\n"


def shape_files(files: DataFrame, kb: str) -> DataFrame:
    """``kb, file_id, text`` from raw files; the id is the file name without its extension."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md\z", "")
    return files.select(F.lit(kb).alias("kb"), F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))
                        .alias("file_id"),
                        F.concat(clean_markdown(F.col("value")), F.lit(PAGE_END)).alias("text"))


def read_markdown(spark: SparkSession, path: str, kb: str) -> DataFrame:
    """All ``*.md`` files below ``path``; an empty directory gives no rows."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return shape_files(files, kb)
