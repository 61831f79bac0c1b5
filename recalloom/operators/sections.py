"""Section detection: one document row becomes one row per section, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import strip

# --- fixed values -----------------------------------------------------------
HEADING = r"(?mdU)^(#{1,6})\s+(.+)$"
ORDINAL = r"(?mdU)^([一二三四五六七八九十]+)、(.+)$"
# ----------------------------------------------------------------------------

# Written before every heading so that one split yields the sections; three control
# characters in this order do not occur in text.
_CUT = "\x01\x02\x01"


def _with_pieces(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_pieces`` (text before the first heading, then one item per section)."""
    t = F.col(text)
    headed = F.coalesce(F.regexp_like(t, F.lit(HEADING)), F.lit(False))

    def cut(pattern: str):
        return F.split(F.regexp_replace(t, pattern, _CUT + "$0"), _CUT)

    return docs.withColumn("_headed", headed).withColumn(
        "_pieces", F.when(F.col("_headed"), cut(HEADING)).otherwise(cut(ORDINAL)))


def detect_sections(docs: DataFrame, text: str = "text", collapse_single: bool = True,
                    min_chars: int | None = config.MIN_SECTION_CHARS) -> DataFrame:
    """Sections of every document: ``section_idx, title, level, start, end, section_text``.

    ``#`` headings delimit sections; a document without any falls back to Chinese ordinal
    headings, and one without either is a single section. Text before the first heading
    is not part of a section. ``collapse_single`` treats a document with one heading as
    having none. Sections of fewer than ``min_chars`` characters are dropped; ``None``
    keeps all. ``section_text`` is stripped; ``start`` and ``end`` are character offsets.
    """
    keep = [c for c in docs.columns if c != text]
    flat = 2 if collapse_single else 1
    pieces = F.col("_pieces")
    cut = _with_pieces(docs.where(F.col(text).isNotNull()), text).withColumn(
        "_flat", F.size(pieces) <= flat)
    # A flat document is one piece with nothing in front of it.
    cut = cut.withColumn("_pieces", F.when(F.col("_flat"), F.array(F.lit(""), F.col(text)))
                         .otherwise(pieces))
    starts = F.aggregate(
        F.transform(pieces, lambda p: F.length(p)),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    cut = cut.withColumn("_starts", F.slice(starts, F.lit(1), F.size(pieces)))
    rows = cut.select(*keep, "_headed", "_flat",
                      F.posexplode(F.arrays_zip("_pieces", "_starts")).alias("_pos", "_p"))
    rows = rows.where(F.col("_pos") > 0).select(
        *keep, "_headed", "_flat", (F.col("_pos") - 1).alias("section_idx"),
        F.col("_p._pieces").alias("_raw"), F.col("_p._starts").alias("start"))
    raw = F.col("_raw")
    hashes = F.regexp_extract(raw, HEADING, 1)
    title = F.when(F.col("_flat"), F.lit(config.DEFAULT_SECTION_TITLE)).when(
        F.col("_headed"), strip(F.regexp_extract(raw, HEADING, 2))).otherwise(
        strip(F.regexp_extract(raw, ORDINAL, 0)))
    level = F.when(F.col("_flat") | ~F.col("_headed"), 1).otherwise(F.length(hashes))
    sections = rows.select(
        *keep, "section_idx", title.alias("title"), level.alias("level"), "start",
        (F.col("start") + F.length(raw)).alias("end"), strip(raw).alias("section_text"))
    if min_chars is None:
        return sections
    return sections.where(F.length("section_text") >= min_chars)


def whole_document(docs: DataFrame, text: str = "text") -> DataFrame:
    """The unsplit arm: every document is one section."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(
        *keep, F.lit(0).alias("section_idx"), F.lit(config.DEFAULT_SECTION_TITLE).alias("title"),
        F.lit(1).alias("level"), F.lit(0).alias("start"), F.length(text).alias("end"),
        strip(F.col(text)).alias("section_text"))


def header_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per heading with its chain of enclosing headings (``headers``).

    The chain is a fold over the headings of one document, row by row in the JVM. Text
    before the first heading is kept as a section without headers.
    """
    keep = [c for c in docs.columns if c != text]
    head = "array<struct<level:int,title:string>>"
    cut = _with_pieces(docs.where(F.col(text).isNotNull()), text).where(F.col("_headed"))
    heads = F.transform(
        F.col("_pieces"),
        lambda p: F.struct(F.length(F.regexp_extract(p, HEADING, 1)).cast("int").alias("level"),
                           strip(F.regexp_extract(p, HEADING, 2)).alias("title")))
    chains = F.aggregate(
        heads,
        F.array(F.array().cast(head)).cast(f"array<{head}>"),
        lambda acc, h: F.concat(acc, F.array(
            F.when(h["level"] == 0, F.array().cast(head)).otherwise(
                F.concat(F.filter(F.element_at(acc, -1), lambda e: e["level"] < h["level"]),
                         F.array(h)).cast(head)))).cast(f"array<{head}>"),
    )
    cut = cut.withColumn("_chains", F.slice(chains, F.lit(2), F.size("_pieces")))
    headed = cut.select(*keep, F.posexplode(F.arrays_zip("_pieces", "_chains")).alias("_pos", "_p"))
    headed = headed.select(*keep, F.col("_pos").alias("section_idx"),
                           F.col("_p._chains").alias("headers"),
                           strip(F.col("_p._pieces")).alias("section_text"))
    plain = _with_pieces(docs.where(F.col(text).isNotNull()), text).where(~F.col("_headed")).select(
        *keep, F.lit(0).alias("section_idx"), F.array().cast(head).alias("headers"),
        strip(F.col(text)).alias("section_text"))
    return headed.unionByName(plain).where(F.col("section_text") != "")


def merge_pages(pages: DataFrame, file_id: str = "file_id", page_no: str = "page_no",
                text: str = "text") -> DataFrame:
    """Concatenate the pages of a file in page order, each followed by a blank line.

    Every file becomes one row: a group is one text, which all later steps hold whole.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_no), F.col(text))))
    return (pages.groupBy(file_id)
            .agg(F.array_join(F.transform(ordered, lambda p: F.concat(p[text], F.lit("\n\n"))), "")
                 .alias(text), F.count(F.lit(1)).alias("n_pages")))
