"""String expressions. Everything but Unicode folding stays inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
IMAGE = r"(?d)!\[.*?\]\(.*?\)"
LINK = r"(?d)\[.*?\]\(.*?\)"
WORD_BREAK = r"[^\p{L}\p{N}]+"
NOT_CJK = r"[^\x{4E00}-\x{9FFF}]"
NOT_ALNUM = r"[^\p{L}\p{N}]"
FILE_EXTENSION = r"\.(pdf|md|docx?)\z"
VOLUME_PREFIX = r"\A0?\d{1,2}(?=第[一二三四五六七八九十]+册)"
# ----------------------------------------------------------------------------

Tokenizer = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_markdown(c: Column) -> Column:
    """Drop images, then links together with their anchor text."""
    return F.regexp_replace(F.regexp_replace(c, IMAGE, ""), LINK, "")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, longer than one character."""
    return F.filter(F.split(F.lower(c), WORD_BREAK), lambda t: F.length(t) > 1)


def cjk_bigram_tokens(c: Column) -> Column:
    """Overlapping character pairs of every CJK run, and words of other scripts."""
    runs = F.regexp_extract_all(
        c, F.lit(r"(?=([\x{4E00}-\x{9FFF}]{2}))[\x{4E00}-\x{9FFF}]"), F.lit(1))
    return F.concat(runs, word_tokens(F.regexp_replace(c, r"[\x{4E00}-\x{9FFF}]+", " ")))


def jieba_tokens(c: Column) -> Column:
    """Exact-mode dictionary segmentation; needs the jieba package on the executors."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segment(texts: pd.Series) -> pd.Series:
        import jieba

        def cut(text):
            return [w.strip() for w in jieba.lcut(text or "") if len(w.strip()) > 1]

        return texts.map(cut)

    return segment(c)


TOKENIZERS: dict[str, Tokenizer] = {
    "word": word_tokens,
    "cjk_bigram": cjk_bigram_tokens,
    "jieba": jieba_tokens,
}


def keep_charset(c: Column, charset: str = "cjk") -> Column:
    """Reduce a text to the characters that recall compares."""
    if charset == "cjk":
        return F.regexp_replace(c, NOT_CJK, "")
    if charset == "alnum":
        return F.regexp_replace(F.lower(c), NOT_ALNUM, "")
    raise ValueError(f"unknown charset {charset!r}")


def nfkc(c: Column) -> Column:
    """Compatibility folding; Spark has no built-in for it. Meant for short names."""

    @F.pandas_udf(T.StringType())
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return fold(c)


def normalise_file_ref(c: Column, fold: Callable[[Column], Column] = nfkc) -> Column:
    """Comparable form of a file name: no extension, width-folded, no blanks, no volume number."""
    bare = F.regexp_replace(strip(c), FILE_EXTENSION, "")
    joined = F.regexp_replace(fold(bare), r"(?U)\s+", "")
    return F.regexp_replace(joined, VOLUME_PREFIX, "")


def file_match(ref: Column, src: Column, aliases: list[tuple[str, str]] = ()) -> Column:
    """Whether two normalised names mean the same file: equal, contained, or aliased."""
    hit = F.contains(ref, src) | F.contains(src, ref)
    for ref_prefix, src_prefix in aliases:
        hit = hit | (F.startswith(ref, F.lit(ref_prefix)) & F.startswith(src, F.lit(src_prefix)))
    return F.coalesce((ref != "") & (src != "") & hit, F.lit(False))


def fenced_json(c: Column) -> Column:
    """The outermost braces of a model reply, fences and chatter cut away."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def salvage_json(c: Column, schema: str) -> Column:
    """Parse a reply as JSON, else its first-to-last brace; null when neither parses."""
    whole = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    inner = fenced_json(c)
    braces = F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, schema))
    return F.coalesce(whole, braces)
