"""How much of a gold answer a retrieved text covers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Stands for a character that starts no block; it is equal to none.
_BREAK = ""


def _automaton(chars: Sequence[str]) -> tuple[list[dict], list[int], list[int], list[int]]:
    """Suffix automaton: moves, links, lengths of all substrings, and where each first ends."""
    moves: list[dict] = [{}]
    link, length, first, last = [-1], [0], [-1], 0
    for at, ch in enumerate(chars):
        new = len(moves)
        moves.append({})
        length.append(at + 1)
        first.append(at)
        link.append(0)
        state = last
        while state >= 0 and ch not in moves[state]:
            moves[state][ch] = new
            state = link[state]
        if state >= 0:
            old = moves[state][ch]
            if length[old] == length[state] + 1:
                link[new] = old
            else:
                copy = len(moves)
                moves.append(dict(moves[old]))
                length.append(length[state] + 1)
                first.append(first[old])
                link.append(link[old])
                while state >= 0 and moves[state].get(ch) == old:
                    moves[state][ch] = copy
                    state = link[state]
                link[old] = link[new] = copy
        last = new
    return moves, link, length, first


def _runs(chars: Sequence[str], automaton) -> Iterator[tuple[int, int, int]]:
    """(size, start in the automaton's text, start here) of common runs, none shorter than one before it.

    Only ends are given at which the longest run so far is reached or passed.
    """
    moves, link, length, first = automaton
    state = size = best = 0
    for at, ch in enumerate(chars):
        while state and ch not in moves[state]:
            state = link[state]
            size = length[state]
        to = moves[state].get(ch)
        if to is None:
            size = 0
            continue
        state, size = to, size + 1
        if size >= best:
            best = size
            yield size, first[state] - size + 1, at - size + 1


def _longest_block(a: Sequence[str], b: Sequence[str]) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and size of the longest common run; of several the first in
    ``a``, then in ``b``. Takes time and memory in proportion to the texts; the automaton is that of
    the shorter one."""
    if len(a) <= len(b):
        found = ((-size, i, j) for size, i, j in _runs(b, _automaton(a)))
    else:
        found = ((-size, i, j) for size, j, i in _runs(a, _automaton(b)))
    size, i, j = min(found, default=(0, 0, 0))
    return i, j, -size


def matched_chars(a: str, b: str, autojunk: bool = True) -> int:
    """Total size of the matching blocks of two texts: the longest common block, then the
    same left and right of it. With ``autojunk`` a character that makes up more than one
    hundredth of a text of 200 or more only extends blocks and starts none."""
    seeds: Sequence[str] = b
    if autojunk and len(b) >= 200:
        common = {ch for ch, n in Counter(b).items() if n > len(b) // 100 + 1}
        seeds = [_BREAK if ch in common else ch for ch in b]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, size = _longest_block(a[a0:a1], seeds[b0:b1])
        i, j = i + a0, j + b0
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if a0 < i and b0 < j:
                todo.append((a0, i, b0, j))
            if i + size < a1 and j + size < b1:
                todo.append((i + size, a1, j + size, b1))
    return total


def block_coverage(needle: str | None, haystack: str | None, autojunk: bool,
                   floor: float = 0.0) -> float:
    """Share of ``needle`` found in matching blocks of ``haystack``.

    No matching can exceed the overlap of the two character multisets. Where that bound
    is already below ``floor`` the costly alignment is skipped and 0 returned; the
    comparison with any threshold of at least ``floor`` stays the same.
    """
    if not needle or not haystack:
        return 0.0
    if floor > 0:
        have = Counter(haystack)
        shared = sum(min(n, have[ch]) for ch, n in Counter(needle).items())
        if shared / len(needle) < floor:
            return 0.0
    return matched_chars(needle, haystack, autojunk) / len(needle)


def coverage(needle: Column, haystack: Column, autojunk: bool = True,
             floor: float = 0.0) -> Column:
    """Column form of :func:`block_coverage`; both sides already reduced to their charset."""

    @F.pandas_udf(T.DoubleType())
    def measure(needles: pd.Series, haystacks: pd.Series) -> pd.Series:
        return pd.Series([block_coverage(n, h, autojunk, floor)
                          for n, h in zip(needles, haystacks)], dtype="float64")

    return measure(needle, haystack)


def verbatim_coverage(needle: Column, haystack: Column) -> Column:
    """1 when the needle occurs as it stands, else 0."""
    return F.when((F.length(needle) > 0) & F.contains(haystack, needle), 1.0).otherwise(0.0)
