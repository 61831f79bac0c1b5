"""Keyword scores of whole batches of chunks, of which every task keeps the best per question.

Chunks come one to a row with their tokens. An Arrow task looks the tokens up among those of the questions; with the
statistics of those, another adds up the scores of a block of chunks as one table and keeps ``k`` chunks per index and question. No pair of chunk and question
becomes a row, nothing is sorted or hashed by chunk, and what leaves a task does not grow with the chunks it saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import config

# Cells (chunks x questions) and summands of the scores that are held at a time.
BLOCK_CELLS = 1 << 21


@dataclass(frozen=True)
class Asked:
    """The questions as the tasks get them: of ``tokens``, number t is asked by ``queries[starts[t]:starts[t + 1]]``.

    ``idf`` and ``avgdl`` are those of every index, one row each; without them chunks bring their weights.
    """

    n_queries: int
    tokens: pa.Array
    starts: np.ndarray
    queries: np.ndarray
    weights: np.ndarray
    idf: np.ndarray | None = None
    avgdl: np.ndarray | None = None
    k1: float = config.BM25_K1
    b: float = config.BM25_B


def asked_by(terms: pa.Table) -> Asked:
    """``terms``: one row per question with ``token`` and ``qw``, lists of equal length."""
    lists = terms.column("token").combine_chunks() if terms.num_rows else pa.array([], pa.list_(pa.string()))
    flat = lists.flatten()
    tokens = pc.unique(flat)
    number = pc.index_in(flat, value_set=tokens).to_numpy(zero_copy_only=False).astype("int64")
    order = np.argsort(number, kind="stable")
    query = np.repeat(np.arange(terms.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64"))
    qw = terms.column("qw").combine_chunks().flatten().to_numpy(zero_copy_only=False) if terms.num_rows else np.empty(0)
    return Asked(terms.num_rows, tokens, np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(tokens)))]).astype("int64"),
                 query[order].astype("int64"), qw[order])


def _numbers(asked: Asked, lists: pa.Array) -> np.ndarray:
    """The number of every listed token among the asked ones, -1 for others."""
    return pc.fill_null(pc.index_in(lists.flatten(), value_set=asked.tokens), -1).to_numpy(zero_copy_only=False).astype("int64")


def _rows(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def find(batches: Iterator[pa.RecordBatch], asked: Asked, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Replace the last column, ``tokens``, by ``dl, numbers, tf``: the length, and what of the asked tokens there is how often."""
    n = max(len(asked.tokens), 1)
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        number = _numbers(asked, lists)
        known = number >= 0
        key, tf = np.unique(_rows(lists)[known] * n + number[known], return_counts=True)
        row, token = np.divmod(key, n)
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype("int32")
        dl = pc.fill_null(pc.list_value_length(lists), 0)
        found = [pa.ListArray.from_arrays(pa.array(starts), pa.array(v.astype("int32"))) for v in (token, tf)]
        columns = [*batch.columns[:-1], dl, *found]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _weights(asked: Asked, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token number and weight of every asked token of the chunks, ordered by row."""
    if asked.idf is None:
        number, known = (m := _numbers(asked, batch.column(2))), m >= 0
        return _rows(batch.column(2))[known], number[known], batch.column(3).flatten().to_numpy(zero_copy_only=False)[known]
    row, token = _rows(batch.column(3)), batch.column(3).flatten().to_numpy(zero_copy_only=False)
    tf, dl = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)[row]
    group = batch.column(0).to_numpy(zero_copy_only=False)[row]
    norm = (1.0 - asked.b) + asked.b * dl / np.maximum(asked.avgdl[group], 1.0)
    return row, token, asked.idf[group, token] * tf / (tf + asked.k1 * norm)


class _Lists:
    """The ``k`` best chunks per index and question so far, by score and then id."""

    def __init__(self, asked: Asked, k: int, id_type: pa.DataType):
        self.asked, self.k = asked, k
        self.rows = pa.table({"group": pa.array([], pa.int32()), "query": pa.array([], pa.int32()),
                              "chunk_id": pa.array([], id_type), "score": pa.array([], pa.float64())})
        self.floors: dict[int, np.ndarray] = {}

    def add(self, group: int, ids: pa.Array, scores: np.ndarray) -> None:
        """Take in the scores (chunks x questions) of chunks of one index; 0 where they share no token."""
        floor = self.floors.get(group, np.full(self.asked.n_queries, -np.inf))
        shared = scores > 0
        scores = np.round(scores, config.SCORE_DECIMALS)
        if len(scores) > self.k:
            # A chunk below the k-th of its own block is in no list; where fewer share a token, all of them are kept.
            kth = np.partition(np.where(shared, scores, -np.inf), len(scores) - self.k, axis=0)[len(scores) - self.k]
            floor = np.maximum(floor, kth)
        at, query = np.nonzero(shared & (scores >= floor))
        if not len(at):
            return
        new = pa.table({"group": pa.array(np.full(len(at), group, "int32")), "query": pa.array(query.astype("int32")),
                        "chunk_id": ids.take(pa.array(at)), "score": pa.array(scores[at, query])})
        mine = pc.equal(self.rows.column("group"), group)
        rows = pa.concat_tables([self.rows.filter(mine), new])
        rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
        query = rows.column("query").to_numpy()
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        kept = rows.filter(pa.array(place < self.k))
        last = place == self.k - 1
        floor = np.full(self.asked.n_queries, -np.inf)
        floor[query[last]] = rows.column("score").to_numpy()[last]
        self.floors[group] = floor
        self.rows = pa.concat_tables([self.rows.filter(pc.invert(mine)), kept]).combine_chunks()


def _add_scores(lists: _Lists, group: int, ids: pa.Array, row: np.ndarray, token: np.ndarray, weight: np.ndarray) -> None:
    """Add up the scores of chunks of one index block by block; ``row`` counts the chunks of ``ids`` and rises."""
    asked = lists.asked
    n_rows = max(1, BLOCK_CELLS // asked.n_queries)
    for low in range(0, len(ids), n_rows):
        high = min(low + n_rows, len(ids))
        a, z = np.searchsorted(row, [low, high])
        scores = np.zeros((high - low) * asked.n_queries)
        # A posting counts once for every question with its token.
        times = np.concatenate([[0], np.cumsum(asked.starts[token[a:z] + 1] - asked.starts[token[a:z]])])
        while a < z:
            step = max(1, int(np.searchsorted(times, times[0] + BLOCK_CELLS, side="right")) - 1)
            t = token[a:a + step]
            n = asked.starts[t + 1] - asked.starts[t]
            entry = np.repeat(asked.starts[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat((row[a:a + step] - low) * asked.n_queries, n) + asked.queries[entry]
            scores += np.bincount(cell, np.repeat(weight[a:a + step], n) * asked.weights[entry], len(scores))
            a, times = a + step, times[step:]
        lists.add(group, ids.slice(low, high - low), scores.reshape(high - low, asked.n_queries))


def scan(batches: Iterator[pa.RecordBatch], asked: Asked, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``group, query, chunk_id, score`` of the best chunks of one task; batches hold ``group, chunk_id`` and
    ``dl, numbers, tf`` as :func:`find` gives them or, without statistics, ``tokens, weights``."""
    lists = _Lists(asked, k, schema.field("chunk_id").type)
    for batch in batches:
        if not batch.num_rows or not asked.n_queries:
            continue
        row, token, weight = _weights(asked, batch)
        group = batch.column(0).to_numpy(zero_copy_only=False)
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            mine = group[row] == g
            _add_scores(lists, int(g), batch.column(1).take(pa.array(rows)), np.searchsorted(rows, row[mine]), token[mine], weight[mine])
    yield from lists.rows.rename_columns(schema.names).cast(schema).to_batches()
