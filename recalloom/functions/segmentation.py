"""Cutting unspaced text into the words of a dictionary: the likeliest path through the graph of all words.

The dictionary is a trie of arrays. Texts are walked in blocks: all places of a block step down the trie together, then
the best path is computed for all runs of the block at once, from their ends backwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Logarithms are kept as whole numbers in this unit, so that sums of them are exact and ties are real ties.
SCALE = 1 << 20
ABSENT = np.iinfo(np.int64).min
_CODE_BITS = 21
# Characters worked on at once; a longer run is worked on alone.
BLOCK_CHARS = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


@dataclass(frozen=True)
class Trie:
    """One level per character. A node is the place of its (parent, character) in the sorted ``keys`` of its level.

    ``weights`` holds the weight of the word ending at a node, or ``ABSENT``. ``unknown`` is the weight of a single
    character that is no word.
    """

    keys: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    unknown: int

    @staticmethod
    def build(words: Sequence[str], weights: Sequence[int], unknown: int) -> Trie:
        """Empty words are left out; of a word given twice the larger weight holds."""
        pairs = sorted((w, int(x)) for w, x in zip(words, weights) if w)
        sizes = np.array([len(w) for w, _ in pairs], dtype=np.int64)
        gains = np.array([x for _, x in pairs], dtype=np.int64)
        codes = code_points("".join(w for w, _ in pairs))
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        parent = np.zeros(len(pairs), dtype=np.int64)
        keys, levels, level = [], [], 0
        alive = np.arange(len(pairs))
        while len(alive):
            nodes, place = np.unique((parent[alive] << _CODE_BITS) | codes[begins[alive] + level], return_inverse=True)
            parent[alive] = place
            weight = np.full(len(nodes), ABSENT, dtype=np.int64)
            ends = alive[sizes[alive] == level + 1]
            np.maximum.at(weight, parent[ends], gains[ends])
            keys.append(nodes)
            levels.append(weight)
            level += 1
            alive = alive[sizes[alive] > level]
        return Trie(tuple(keys), tuple(levels), unknown)

    def words_at(self, codes: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """``places, length, weights`` of the words found at all places, by rising length; ``room`` ends a run."""
        at = np.flatnonzero(room > 0)
        node = np.zeros(len(at), dtype=np.int64)
        for level, (keys, weights) in enumerate(zip(self.keys, self.weights)):
            inside = room[at] > level
            at, node = at[inside], node[inside]
            wanted = (node << _CODE_BITS) | codes[at + level]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[place] == wanted
            at, node = at[hit], place[hit]
            if not len(at):
                return
            found = weights[node]
            word = found != ABSENT
            if word.any():
                yield at[word], level + 1, found[word]


def segment_runs(runs: Sequence[str], trie: Trie) -> list[list[str]]:
    """The words of each run. Among paths of one weight the longest first word wins, then the longest second, and so on.

    Neighbouring characters that are no words stay together as one piece, so the pieces of a run always make the run.
    """
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    out: list[list[str]] = [[] for _ in runs]
    if not len(runs) or not sizes.sum():
        return out
    # Every run is followed by one place that stands for its end.
    text = "\0".join(runs) + "\0"
    codes = code_points(text)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    room = np.repeat(ends, sizes + 1) - np.arange(len(codes))
    starts, lengths, gains = [], [], []
    single = np.zeros(len(codes), dtype=bool)
    for at, length, weight in trie.words_at(codes, room):
        if length == 1:
            single[at] = True
        starts.append(at)
        lengths.append(np.full(len(at), length, dtype=np.int64))
        gains.append(weight)
    lone = np.flatnonzero(~single & (room > 0))
    starts.insert(0, lone)
    lengths.insert(0, np.ones(len(lone), dtype=np.int64))
    gains.insert(0, np.full(len(lone), trie.unknown, dtype=np.int64))
    start, length, gain = map(np.concatenate, (starts, lengths, gains))
    # By distance from the end, then place; the sort is stable, so lengths rise within a place.
    order = np.argsort((room[start] << 32) | start, kind="stable")
    start, length, gain = start[order], length[order], gain[order]
    groups = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
    counts = np.diff(np.append(groups, len(start)))
    distance = room[start[groups]]
    steps = np.flatnonzero(np.concatenate([[True], distance[1:] != distance[:-1], [True]]))
    best = np.zeros(len(codes), dtype=np.int64)
    stride = np.zeros(len(codes), dtype=np.int64)
    for i, j in zip(steps[:-1], steps[1:]):
        a = groups[i]
        b = groups[j] if j < len(groups) else len(start)
        total = gain[a:b] + best[start[a:b] + length[a:b]]
        top = np.maximum.reduceat(total, groups[i:j] - a)
        best[start[groups[i:j]]] = top
        wins = total == np.repeat(top, counts[i:j])
        stride[start[a:b][wins]] = length[a:b][wins]
    cut = np.zeros(len(codes), dtype=bool)
    cut[ends] = True
    here = begins[sizes > 0]
    while len(here):
        cut[here] = True
        here = here + stride[here]
        here = here[room[here] > 0]
    stray = cut & (stride == 1) & ~single & (room > 0)
    cut[1:] &= ~(stray[1:] & stray[:-1])
    bounds = np.flatnonzero(cut)
    owner = np.searchsorted(ends, bounds)
    for a, b, run, left in zip(bounds[:-1].tolist(), bounds[1:].tolist(), owner.tolist(), room[bounds].tolist()):
        if left:
            out[run].append(text[a:b])
    return out


def segment_lists(runs: pa.Array, trie: Trie, least: int) -> pa.Array:
    """Lists of runs to lists of their words of at least ``least`` characters; null lists give empty ones."""
    rows = [[r for r in row or () if r] for row in runs.to_pylist()]
    flat = [r for row in rows for r in row]
    words: list[list[str]] = []
    block, size = [], 0
    for run in flat:
        if block and size + len(run) > BLOCK_CHARS:
            words += segment_runs(block, trie)
            block, size = [], 0
        block.append(run)
        size += len(run) + 1
    words += segment_runs(block, trie)
    it = iter(words)
    return pa.array([[w for _ in row for w in next(it) if len(w) >= least] for row in rows], type=pa.list_(pa.string()))
