"""Flat arrays of rows of uneven length, and the word cache that fills them."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

# Text handled at once; bounds what a task holds beside its Arrow batch.
WINDOW_CHARS = 1 << 20
# Words a cache holds, and their characters. More cost a worker memory and hardly save time: most words that are new are rare.
CACHED_WORDS, CACHED_CHARS = 1 << 17, 16 << 20


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen rows one after another, and where each ends."""
    size = lengths[rows]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[rows] - (ends - size), size) + np.arange(total)
    return flat[at], ends


def windows(text, size: int = WINDOW_CHARS) -> Iterator:
    """The text (str or bytes) in pieces of about ``size``, cut at blanks, which stay with the right piece."""
    at, blank = 0, b" " if isinstance(text, bytes) else " "
    while len(text) - at > size:
        cut = text.find(blank, at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def packs(texts: Iterable, size: int = WINDOW_CHARS, empty="") -> Iterator[list]:
    """Whole texts (null as ``empty``) in lists of about ``size`` together; a longer text alone."""
    held: list = []
    chars = 0
    for text in texts:
        held.append(text or empty)
        chars += len(held[-1])
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def give_back() -> None:
    """Return to the system what Python, Arrow and the C library hold free for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as an Arrow task that gives back its memory when it ends: idle workers stay beside the JVM, which goes on."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


_resident: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]):
    """What a Python worker keeps between tasks: the object of the operator that ran last.

    Workers are reused by all operators; one that moves in frees what the one before has held.
    """
    if key not in _resident:
        _resident.clear()
        give_back()
        _resident[key] = make()
        give_back()
    return _resident[key]


class Words(dict):
    """Numbers words as they come; ``fill`` works out the values of the new ones together.

    Emptied when it holds more than ``limit`` words or ``CACHED_CHARS`` of them: that costs time,
    never changes a result.
    """

    def __init__(self, fill: Callable[[list[str], int], None], reset: Callable[[], None], limit: int = CACHED_WORDS) -> None:
        super().__init__()
        self.fill, self.reset, self.limit, self.new, self.chars = fill, reset, limit, [], 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.chars += len(word)
        return n

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        """The numbers of ``words``; valid until the next call."""
        if len(self) > self.limit or self.chars > CACHED_CHARS:
            self.clear()
            self.chars = 0
            self.reset()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            new, self.new = self.new, []
            self.fill(new, len(self) - len(new))
        return found


class Rows:
    """Growing rows of one number type, read as flat array, starts and lengths."""

    def __init__(self, dtype) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.ends, self.used, self.count = np.empty(1 << 16, self.dtype), np.zeros(1 << 12, np.int64), 0, 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Add rows: their values one after another, and their lengths."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(lengths) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.ends[self.count:self.count + len(lengths)] = self.used + np.cumsum(lengths)
        self.used += len(flat)
        self.count += len(lengths)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = self.ends[:self.count]
        starts = np.concatenate([[0], ends[:-1]]) if self.count else ends
        return gather(self.flat, starts, ends - starts, rows)
