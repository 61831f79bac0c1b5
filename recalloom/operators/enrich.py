"""Chunk enrichment: metadata joins, text injection and summaries by a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import salvage_json, strip

Model = Callable[[Column], Column]

# --- fixed values -----------------------------------------------------------
FILE_TYPE_LABEL = "文件类型："
SECTION_LABEL = "章节："
SECTION_SUMMARY_LABEL = "章节摘要："
FILE_SUMMARY_LABEL = "文件摘要："
PART_SEPARATOR = "；"
UNKNOWN_TYPE = "未知"
FILE_META_SCHEMA = "file_type string, file_summary string"
# ----------------------------------------------------------------------------


def metadata_prefix(file_type: Column, section: Column, section_summary: Column,
                    file_summary: Column) -> Column:
    """Labelled, non-empty metadata joined in reading order."""
    def part(label, value):
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    return F.concat_ws(
        PART_SEPARATOR, part(FILE_TYPE_LABEL, file_type), part(SECTION_LABEL, section),
        part(SECTION_SUMMARY_LABEL, section_summary), part(FILE_SUMMARY_LABEL, file_summary))


def inject_metadata(chunks: DataFrame, text: str = "index_text") -> DataFrame:
    """Put the metadata in front of the searched text; it then feeds both search routes."""
    prefix = metadata_prefix(F.col("file_type"), F.col("title"), F.col("section_summary"),
                             F.col("file_summary"))
    return chunks.withColumn("_prefix", prefix).withColumn(
        text, F.when(F.col("_prefix") != "", F.concat("_prefix", F.lit("\n"), F.col(text)))
        .otherwise(F.col(text))).drop("_prefix")


def attach_metadata(chunks: DataFrame, file_meta: DataFrame, section_meta: DataFrame,
                    file_id: str = "file_id") -> DataFrame:
    """Left-join file and section metadata; absent values become empty strings.

    No side is hinted: both metadata tables grow with the corpus, and adaptive execution
    splits the partition of a file that holds very many chunks.
    """
    joined = (chunks.join(file_meta.select(file_id, "file_type", "file_summary"), file_id, "left")
              .join(section_meta.select(file_id, "section_idx", "section_summary"),
                    [file_id, "section_idx"], "left"))
    names = ("file_type", "file_summary", "section_summary")
    return joined.withColumns({n: F.coalesce(n, F.lit("")) for n in names})


def summary_windows(sections: DataFrame, text: str = "section_text") -> DataFrame:
    """What a summary model has to read, one row per call.

    A section of at most 3000 characters is one window; a longer one is cut into windows
    of 2000 whose summaries are summarised again by :func:`summarise_sections`.
    """
    from .chunkers import char_window_array

    body = F.col(text)
    windows = F.when(F.length(body) > config.SUMMARY_MAX_CHARS,
                     char_window_array(body, config.SUMMARY_WINDOW_CHARS)).otherwise(F.array(body))
    keep = [c for c in sections.columns if c != text]
    return sections.select(*keep, F.posexplode(windows).alias("window_idx", "window_text"))


def summarise_sections(sections: DataFrame, model: Model, file_id: str = "file_id", text: str = "section_text",
                       levels: int = 4, fallback_chars: int | None = config.SUMMARY_FALLBACK_CHARS) -> DataFrame:
    """Map-reduce summaries: ``file_id, section_idx, section_summary``.

    Where the summaries of a section's windows are together still longer than one call takes,
    they are cut into windows and summarised again, up to ``levels`` times; what is longer even
    then goes into the last call whole. One failed window fails its section. A failed section is
    asked once more; then its first ``fallback_chars`` characters stand in, or null without them.
    """
    key = [file_id, "section_idx"]

    def one_pass(src: DataFrame, left: int) -> DataFrame:
        windows = summary_windows(src, text) if left else src.select(
            *key, F.lit(0).alias("window_idx"), F.col(text).alias("window_text"))
        parts = windows.withColumn("_part", model(F.col("window_text")))
        # A section has length/2000 windows, so the list is bounded by its own text.
        listed = F.array_sort(F.collect_list(F.struct("window_idx", "_part")))
        merged = parts.groupBy(*key).agg(
            F.count(F.lit(1)).alias("_n"), F.count("_part").alias("_ok"),
            F.array_join(F.transform(listed, lambda p: p["_part"]), " ").alias("_joined"))
        joined = F.when(F.col("_ok") == F.col("_n"), F.col("_joined"))
        done = merged.where("_n = 1 or _ok < _n").select(*key, joined.alias("section_summary"))
        if not left:
            return done
        again = merged.where("_n > 1 and _ok = _n").select(*key, F.col("_joined").alias(text))
        return done.unionByName(one_pass(again, left - 1))

    first = one_pass(sections.select(*key, text), levels)
    done = first.where(F.col("section_summary").isNotNull())
    failed = sections.join(first.where(F.col("section_summary").isNull()).select(*key), key,
                           "left_semi")
    second = one_pass(failed.select(*key, text), levels).join(failed.select(*key, text), key)
    head = F.substring(F.col(text), 1, fallback_chars) if fallback_chars else F.lit(None).cast("string")
    return done.unionByName(second.select(
        *key, F.coalesce("section_summary", head).alias("section_summary")))


def file_metadata(summaries: DataFrame, model: Model, file_id: str = "file_id") -> DataFrame:
    """File type and summary from the section summaries of each file, in one call for a file of any size."""
    lines = F.array_sort(F.collect_list(F.struct("section_idx", "section_summary")))
    usable = summaries.where(F.coalesce("section_summary", F.lit("")) != "")
    asked = usable.groupBy(file_id).agg(F.array_join(F.transform(
        lines, lambda s: F.concat(F.lit("- "), s["section_summary"])), "\n").alias("_text"))
    replies = asked.withColumn("_meta", salvage_json(model(F.col("_text")), FILE_META_SCHEMA))
    files = summaries.select(file_id).distinct()
    return files.join(replies, file_id, "left").select(
        file_id, F.coalesce("_meta.file_type", F.lit(UNKNOWN_TYPE)).alias("file_type"),
        F.coalesce("_meta.file_summary", F.lit("")).alias("file_summary"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose metadata is not cached yet."""
    return wanted.join(cache.select(*key), key, "left_anti")


def rewrite_lines(reply: Column, n: int = config.REWRITES_PER_QUESTION) -> Column:
    """Question rewrites in a model reply: its first ``n`` lines of four characters or more."""
    lines = F.transform(F.split(reply, "\n"), lambda x: strip(x))
    return F.slice(F.filter(lines, lambda x: F.length(x) >= config.REWRITE_MIN_CHARS), 1, n)
