"""Boilerplate lines by their frequency within a site. DataFrame operations only.

A line of a page is dropped when more than ``max_ratio`` of the pages of its host contain it.

Edges: null or empty html has no lines. A page without a host belongs to no site and keeps all
its lines. A line repeated within a page counts once for the page; all its copies are kept or
dropped together. ``min_pages`` is the least number of pages that must share a line: with 2, a
site of one page loses nothing. With ``rotating_ratio``, lines on more than that lower share of the
pages go too, if they are on ``rotating_pages`` pages at least: ads and menus that rotate over a
large site. The floor keeps small sites, where chance makes large shares, at ``max_ratio``. Rows
repeated with the same id count as pages of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_bounded, stored

# What ends a line, what is no text, and what is left out without ending a line.
_BLOCKS = (r"(?i)</?(p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|article|nav|aside|main|section|header|footer"
           r"|title|head|body|html|form|blockquote|pre)\b[^>]*>")
_HIDDEN = (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(html: Column) -> Column:
    """The visible lines of a page: white space runs as one blank, trimmed, empty ones left out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), SPACE, " ")
    for hidden in _HIDDEN:
        text = F.regexp_replace(text, hidden, " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCKS, "\n"), r"<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


# A tenth of a site's pages, and several of them.
ROTATING_RATIO, ROTATING_PAGES = 0.1, 5


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int, rotating_ratio: float | None = None,
                rotating_pages: int = ROTATING_PAGES) -> DataFrame:
    """(host, keys): the keys of the lines to drop, one row per host that has any.

    Each of these lines is on more than ``max_ratio`` or ``rotating_ratio`` of the host's pages, so a
    host has at most (mean lines per page) / (the lower ratio) of them however large it is.
    """
    sited = pages.where(F.col("host") != "")
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # Partial aggregation leaves one row per line and task, however frequent the line.
    shared = (sited.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("key"))
              .groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= (min_pages if rotating_ratio is None else min(min_pages, rotating_pages))))
    common = (F.col("n") >= min_pages) & (F.col("n") > F.col("pages") * F.lit(max_ratio))
    if rotating_ratio is not None:
        common |= (F.col("n") >= rotating_pages) & (F.col("n") > F.col("pages") * F.lit(rotating_ratio))
    totals = broadcast_if_bounded(stored(totals, "host-pages"))
    return (shared.join(totals, "host").where(common)
            .groupBy("host").agg(F.collect_list("key").alias("keys")))


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     max_ratio: float = 0.5, min_pages: int = 2, rotating_ratio: float | None = None,
                     rotating_pages: int = ROTATING_PAGES) -> DataFrame:
    """``id, host, lines, kept``: the lines of each page before and after, in their order."""
    cut = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"),
                       lines_of(F.col(f"`{html_col}`")).alias("lines"))
    common = broadcast_if_bounded(stored(boilerplate(cut, max_ratio, min_pages, rotating_ratio, rotating_pages), "boilerplate"))
    joined = cut.join(common, "host", "left")
    stays = F.filter("lines", lambda x: ~F.array_contains("keys", _key(x)))
    return joined.select("id", "host", "lines", F.when(F.col("keys").isNull(), F.col("lines")).otherwise(stays).alias("kept"))
