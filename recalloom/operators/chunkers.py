"""Chunkers: one section row becomes its chunk rows. All of them are narrow."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.splitting import (DEFAULT_SEPARATORS, HEADER_SEPARATORS, SENTENCE_SEPARATORS,
                                   recursive_chunks)
from ..functions.text import let, strip

Model = Callable[[Column], Column]


def _window_count(length: Column, size: int, overlap: int) -> Column:
    """Windows needed until one reaches the end; further ones would only repeat a suffix."""
    steps = F.ceil((length - overlap) / float(size - overlap))
    return F.when(length > 0, F.greatest(steps, F.lit(1))).otherwise(0).cast("int")


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and below size {size}")


def char_window_array(text: Column, size: int, overlap: int = 0) -> Column:
    """Fixed character windows. One pass over the text, however long it is."""
    _check(size, overlap)
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(1),
                   _window_count(F.length(text), size, overlap))


# A token is a run of non-blanks with the blanks behind it, so tokens rejoin to the text.
BLANK_TOKEN = r"[^ \t\n\r]+[ \t\n\r]*"


def token_window_array(tokens: Column, size: int, overlap: int = 0) -> Column:
    """Fixed windows over an array of tokens that rejoin to the text."""
    _check(size, overlap)
    return let(tokens, lambda ts: F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(ts) - 1, F.lit(0)), F.lit(size - overlap)),
                 lambda s: (F.size(ts) > 0) & ((s == 0) | (s + overlap < F.size(ts)))),
        lambda s: F.array_join(F.slice(ts, s + 1, F.lit(size)), "")))


def explode_chunks(sections: DataFrame, chunks: Column, text: str = "section_text") -> DataFrame:
    """One row per chunk: ``ord``, ``index_text`` (searched) and ``content_text`` (returned)."""
    keep = [c for c in sections.columns if c != text]
    return sections.select(*keep, F.posexplode(chunks).alias("ord", "index_text")).withColumn(
        "content_text", F.col("index_text"))


def char_windows(sections: DataFrame, size: int, overlap: int = 0,
                 text: str = "section_text") -> DataFrame:
    return explode_chunks(sections, char_window_array(F.col(text), size, overlap), text)


def token_windows(sections: DataFrame, size: int, overlap: int = 0, text: str = "section_text",
                  tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Windows of tokens; ``tokens`` may bring another tokenizer, for example a byte-pair one."""
    cut = tokens or (lambda c: F.regexp_extract_all(c, F.lit(BLANK_TOKEN), F.lit(0)))
    return explode_chunks(sections, token_window_array(cut(F.col(text)), size, overlap), text)


def recursive(sections: DataFrame, size: int, overlap: int = 0, text: str = "section_text",
              separators: Sequence[str] = DEFAULT_SEPARATORS) -> DataFrame:
    return explode_chunks(sections, recursive_chunks(F.col(text), size, overlap, separators), text)


def paragraphs(sections: DataFrame, text: str = "section_text",
               separator: str = r"(?U)\n\s*\n") -> DataFrame:
    """Non-blank paragraphs, stripped; ``paragraph_idx`` counts them from 0."""
    parts = F.filter(F.transform(F.split(F.col(text), separator), lambda p: strip(p)),
                     lambda p: p != "")
    out = explode_chunks(sections, parts, text)
    return out.withColumn("paragraph_idx", F.col("ord"))


def index_lines(reply: Column) -> Column:
    """Index texts in a model reply: its lines of at least three characters."""
    lines = F.transform(F.split(reply, "\n"), lambda x: strip(x))
    return F.filter(lines, lambda x: F.length(x) >= config.INDEX_LINE_MIN_CHARS)


def paragraph_indexes(sections: DataFrame, model: Model, text: str = "section_text") -> DataFrame:
    """Each paragraph once as itself and once per index text the model writes for it.

    Without a usable reply the paragraph stands in for its own index text.
    """
    paras = paragraphs(sections, text)
    lines = index_lines(F.coalesce(model(F.col("content_text")), F.lit("")))
    asked = paras.withColumn("_lines", lines)
    own = F.array(F.col("content_text"))
    rows = F.concat(own, F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(own))
    keep = [c for c in paras.columns if c not in ("ord", "index_text")]
    return asked.select(*keep, F.posexplode(rows).alias("ord", "index_text"))


def parent_child(sections: DataFrame, parent: Callable[[Column], Column],
                 child: Callable[[Column], Column], text: str = "section_text") -> DataFrame:
    """Search children, return parents: ``index_text`` is the child, ``content_text`` the parent."""
    keep = [c for c in sections.columns if c != text]
    parents = sections.select(*keep, F.posexplode(parent(F.col(text)))
                              .alias("parent_idx", "content_text"))
    return parents.select(*keep, "parent_idx", "content_text",
                          F.posexplode(child(F.col("content_text"))).alias("ord", "index_text"))


def recursive_parent_child(sections: DataFrame, parent_size: int = 1100, child_size: int = 150,
                           parent_overlap: int = 0, text: str = "section_text") -> DataFrame:
    return parent_child(
        sections, lambda c: recursive_chunks(c, parent_size, parent_overlap),
        lambda c: recursive_chunks(c, child_size, 0, SENTENCE_SEPARATORS), text)


def header_prefix(headers: Column) -> Column:
    """``# A > ## B`` for a chain of headings."""
    return F.array_join(F.transform(
        headers, lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["title"])),
        " > ")


def header_aware(sections: DataFrame, size: int = config.HEADER_SPLIT_CHARS,
                 overlap: int = config.HEADER_SPLIT_OVERLAP, text: str = "section_text",
                 repeat_prefix: bool = False) -> DataFrame:
    """Chunks of headed sections, every chunk opened by its chain of headings.

    Only sections longer than ``size`` pass through the splitter. ``repeat_prefix`` puts
    the chain twice on the first piece of a split section.
    """
    keep = [c for c in sections.columns if c != text]
    prefix = header_prefix(F.col("headers"))
    opened = F.when(prefix != "", F.concat(prefix, F.lit("\n"), F.col(text))).otherwise(F.col(text))
    marked = sections.withColumn("_prefix", prefix).withColumn("_full", opened)
    short = marked.where(F.length("_full") <= size).select(
        *keep, F.lit(0).alias("ord"), F.col("_full").alias("index_text"))
    body = F.col("_full") if repeat_prefix else F.col(text)
    pieces = marked.where(F.length("_full") > size).select(
        *keep, "_prefix",
        F.posexplode(recursive_chunks(body, size, overlap, HEADER_SEPARATORS)).alias("ord", "_piece"))
    split = pieces.select(*keep, "ord", F.when(
        F.col("_prefix") != "", F.concat("_prefix", F.lit("\n"), "_piece")).otherwise(
        F.col("_piece")).alias("index_text"))
    return short.unionByName(split).withColumn("content_text", F.col("index_text"))


def chunk_lengths(chunks: DataFrame, by: Sequence[str], text: str = "index_text") -> DataFrame:
    """Count and length distribution of chunks per strategy."""
    n = F.length(text)
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(n).alias("sum_chars"),
        F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))
