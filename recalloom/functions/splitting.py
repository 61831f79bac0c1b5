"""Recursive separator splitting of one text. Runs inside an Arrow UDF on the executors."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config

# --- fixed values -----------------------------------------------------------
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")
HEADER_SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", " ", "")
SENTENCE_SEPARATORS = ("。", "！", "？", "\n", " ", "")
# ----------------------------------------------------------------------------


def _pieces(text: str, separator: str) -> list[str]:
    """Cut in front of every separator; without one, into characters."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``, carrying up to ``overlap`` over."""
    window: deque[str] = deque()
    width = 0
    for piece in pieces:
        if window and width + len(piece) > size:
            yield "".join(window)
            while window and (width > overlap or width + len(piece) > size):
                width -= len(window.popleft())
        window.append(piece)
        width += len(piece)
    if window:
        yield "".join(window)


def _split(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[str]:
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1:]
    fitting: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        yield from _pack(fitting, size, overlap)
        fitting = []
        if finer:
            yield from _split(piece, size, overlap, finer)
        else:
            yield piece
    yield from _pack(fitting, size, overlap)


def recursive_split(text: str | None, size: int, overlap: int = 0,
                    separators: Sequence[str] = DEFAULT_SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that fits."""
    chunks = (c.strip() for c in _split(text or "", size, overlap, separators)) if text else ()
    return [c for c in chunks if c]


def recursive_chunks(text: Column, size: int, overlap: int = 0,
                     separators: Sequence[str] = DEFAULT_SEPARATORS) -> Column:
    """Column form of :func:`recursive_split`."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_split(t, size, overlap, separators))

    return split(text)


def guarded_chunks(text: Column, splitter) -> Column:
    """Apply a custom ``splitter(text) -> list[str]``, falling back when it raises.

    A failing text is first cut into 3000-character pieces that are tried one by one; a
    piece that still fails is kept whole.
    """

    def attempt(whole):
        try:
            return list(splitter(whole))
        except Exception:
            chunks = []
            for piece in recursive_split(whole, config.FALLBACK_SPLIT_CHARS):
                try:
                    chunks.extend(splitter(piece))
                except Exception:
                    chunks.append(piece)
            return chunks

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: attempt(t) if t else [])

    return split(text)
