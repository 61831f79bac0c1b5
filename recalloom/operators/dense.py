"""Exact nearest neighbours by cosine similarity.

Vectors are multiplied with the query matrix batch by batch inside Arrow tasks. Each task
keeps the ``k`` best per query, so what leaves it is ``k`` rows per query however many
vectors it saw. No pair of query and vector becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import config
from ..scale import top_k


# Queries multiplied at a time; bounds the score table to this many rows of one Arrow batch.
QUERY_BLOCK = 512
# Query vectors that may be shared with every task.
MAX_SHARED_QUERIES = 8192


def _matrix(column) -> np.ndarray:
    """An Arrow list column as rows of a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if len(flat) % len(column):
        raise ValueError("vectors of one index must have the same length")
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


class _Best:
    """Running top-k of every query, ordered by score and then id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * n_queries
        self.ids = [np.empty(0, dtype=object)] * n_queries

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int) -> None:
        """Take in the scores of consecutive queries from number ``first`` on."""
        for i, row in enumerate(scores, first):
            floor = self.scores[i][-1] if len(self.scores[i]) == self.k else -np.inf
            keep = np.flatnonzero(row >= floor)
            if len(keep) > 4 * self.k:
                cut = -np.partition(-row[keep], self.k - 1)[self.k - 1]
                keep = keep[row[keep] >= cut]
            merged = np.concatenate([self.scores[i], row[keep]])
            names = np.concatenate([self.ids[i], ids[keep]])
            order = sorted(range(len(merged)), key=lambda j: (-merged[j], names[j]))[: self.k]
            self.scores[i], self.ids[i] = merged[order], names[order]


def _scan(batches, query_ids: list, matrix: np.ndarray, k: int, schema: pa.Schema) -> Iterator:
    best = _Best(len(query_ids), k)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        vectors = _unit(_matrix(batch.column(1)))
        ids = np.array(batch.column(0).to_pylist(), dtype=object)
        for at in range(0, len(query_ids), QUERY_BLOCK):
            scores = matrix[at:at + QUERY_BLOCK] @ vectors.T
            # + 0.0 turns a negative zero into zero, so that equal scores compare equal.
            best.add(np.round(scores, config.SCORE_DECIMALS) + 0.0, ids, at)
    rows = [(q, i, float(s)) for q, ids, scores in zip(query_ids, best.ids, best.scores)
            for i, s in zip(ids, scores)]
    if rows:
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


# Memory of one block of vectors in the task that holds it.
BLOCK_BYTES = 128 << 20


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = config.TOP_K,
               chunk_id: str = "chunk_id", embedding: str = "embedding",
               query_id: str = "query_id", query_embedding: str = "embedding",
               block_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest vectors per query: ``query_id, chunk_id, score, rank``.

    A batch of queries of checked size is sent to the tasks that scan the vectors, which
    then need no shuffle. A larger one is paired with the vectors block by block; a block
    holds ``block_rows`` vectors, or as many as fit ``BLOCK_BYTES`` as doubles.
    """
    v = vectors.select(F.col(chunk_id).alias("chunk_id"), F.col(embedding).alias("embedding"))
    q = queries.select(F.col(query_id).alias("query_id"),
                       F.col(query_embedding).alias("embedding"))
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType),
                           T.StructField("chunk_id", v.schema["chunk_id"].dataType),
                           T.StructField("score", T.DoubleType())])
    # Fetch no more than may be shared, then look at what came.
    head = q.limit(MAX_SHARED_QUERIES + 1).toArrow()
    if head.num_rows <= MAX_SHARED_QUERIES and head.nbytes <= config.BROADCAST_MAX_BYTES:
        partial = _scan_with_shared_queries(v, head, k, schema)
    else:
        dim = max([len(e) for e in head.column(1).slice(0, 1).to_pylist() if e], default=1)
        partial = _scan_by_blocks(v, q, k, schema, block_rows or max(1, BLOCK_BYTES // (8 * dim)))
    return top_k(partial, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _scan_with_shared_queries(v: DataFrame, table: pa.Table, k: int, schema) -> DataFrame:
    arrow = to_arrow_schema(schema)
    shared = v.sparkSession.sparkContext.broadcast(
        (table.column(0).to_pylist(), _unit(_matrix(table.column(1)))))

    def scan(batches):
        ids, matrix = shared.value
        if ids:
            yield from _scan(batches, ids, matrix, k, arrow)

    return v.mapInArrow(scan, schema)


def _scan_by_blocks(v: DataFrame, q: DataFrame, k: int, schema, block_rows: int) -> DataFrame:
    """Pair every block of vectors with every block of queries, one pair per task.

    Blocks are filled by a hash of the id, so copies of one vector spread over all of
    them and no block depends on the data. Rows travel once per opposite block.
    """
    n_v = max(1, math.ceil(v.count() / block_rows))
    n_q = max(1, math.ceil(q.count() / max(1, block_rows // 100)))
    left = v.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"),
                    F.pmod(F.xxhash64("chunk_id"), F.lit(n_v)).cast("int").alias("vb"), "*")
    right = q.select(F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qb"),
                     F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"), "*")
    arrow = to_arrow_schema(schema)

    def pair(vec: pa.Table, qry: pa.Table) -> pa.Table:
        if not vec.num_rows or not qry.num_rows:
            return arrow.empty_table()
        rows = _scan(vec.select(["chunk_id", "embedding"]).to_batches(),
                     qry.column("query_id").to_pylist(),
                     _unit(_matrix(qry.column("embedding"))), k, arrow)
        return pa.Table.from_batches(list(rows), arrow)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(pair, schema)


def mean_vectors(vectors: DataFrame, by: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector per group; sums are combined inside each partition before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_vector = array_to_vector(F.col(embedding).cast("array<double>"))
    return vectors.groupBy(by).agg(
        vector_to_array(Summarizer.mean(as_vector)).alias(embedding))
