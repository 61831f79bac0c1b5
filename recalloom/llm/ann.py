"""Nearest neighbours by randomly rotated one-bit codes, reranked within error bounds.

A unit vector is told by its nearest centre, and by the signs of what is left of it after a
random rotation: one bit per dimension, and correction scalars. The inner product with a query
is estimated from the bits; the scalars give a bound on the error of the estimate. Where the
upper bound reaches the query's present k-th best score, the vector is compared exactly.

Centres are fitted on a bounded sample; every vector is encoded and every code is looked at.
Queries are taken in blocks of bounded size, each shared with all tasks, against all codes; a
task keeps k vectors per query.

Edges: vectors that are null, zero, of another than the most frequent length, or that hold null
or non-finite components take no part, nor do rows with a null id. A query is never compared
with rows of its own id; an id that repeats among the queries asks once, with its smallest
vector. Ties go to the smaller id. Fewer than k candidates are all returned; without queries or
candidates there are no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Vectors the centres are fitted on, about, and the centres.
SAMPLE_ROWS, CENTRES = 4000, 16
# How many deviations of the estimate the bounds allow.
DEVIATIONS = 3.0
# Bytes of queries that one pass over the codes shares with every task.
QUERY_BYTES = 16 << 20
# Estimates held at once by a task.
_CELLS = 2 << 20


def usable(vector: Column, dim: int | None = None) -> Column:
    good = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good & (F.size(vector) == dim) if dim else good, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


@dataclass
class Codec:
    """A rotation and centres; tells unit vectors by bits and scalars."""

    rotation: np.ndarray
    centres: np.ndarray

    @staticmethod
    def fit(vectors: np.ndarray, seed: int = 7, rounds: int = 8) -> Codec:
        rng = np.random.default_rng(seed)
        units = _unit(vectors)
        rotation = np.linalg.qr(rng.normal(size=(units.shape[1],) * 2))[0]
        centres = units[rng.permutation(len(units))[:CENTRES]]
        for _ in range(rounds):
            near = (units @ centres.T).argmax(1)
            centres = np.stack([units[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        return Codec(rotation, centres)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre, packed bits, and (length of the rest, alignment with its bits, product with the centre) of each."""
        near = (2 * units @ self.centres.T - (self.centres ** 2).sum(1)).argmax(1)
        rest = units - self.centres[near]
        size = np.sqrt((rest * rest).sum(1))
        turned = (rest / np.maximum(size, 1e-12)[:, None]) @ self.rotation
        aligned = np.abs(turned).sum(1) / np.sqrt(units.shape[1])
        with_centre = (rest * self.centres[near]).sum(1)
        return near, np.packbits(turned > 0, axis=1), np.stack([size, aligned, with_centre], 1)

    def upper(self, queries: np.ndarray, near: np.ndarray, bits: np.ndarray, scalars: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of unit ``queries`` with encoded vectors, queries first."""
        dim = queries.shape[1]
        signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.sqrt(dim)
        out = np.empty((len(queries), len(near)), np.float32)
        for c in np.unique(near):
            at = np.flatnonzero(near == c)
            left = queries - self.centres[c]
            length = np.sqrt((left * left).sum(1))[:, None]
            size, aligned, with_centre = scalars[at].T
            aligned = np.maximum(aligned, 1e-6)
            estimate = ((left @ self.rotation).astype(np.float32) @ signs[at].T) / aligned
            error = length * (np.sqrt(np.maximum(1 - aligned ** 2, 0)) / aligned * (DEVIATIONS / np.sqrt(max(dim - 1, 1))))
            # No estimate may leave what is possible: the product of both lengths.
            most = np.minimum(estimate + error, length)
            out[:, at] = (queries @ self.centres[c])[:, None] + with_centre + size * most
        return out + 1e-5


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Codec | None]:
    """The index, a stored row (vec_id, vector, centre, bits, scalars) per usable vector, and its codec."""
    good = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    good = good.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    kind = good.schema["vector"].dataType.simpleString()
    lengths = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = f"vec_id bigint, vector {kind}, centre int, bits binary, scalars array<double>"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    dim, n = lengths["dim"], lengths["count"]
    good = good.where(F.size("vector") == dim)
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    # About SAMPLE_ROWS vectors at any size of the table; one at least.
    sample = good.where(chosen).orderBy("vec_id").toArrow() if n > 1 else good.toArrow()
    if not sample.num_rows:
        sample = good.limit(1).toArrow()
    codec = Codec.fit(_matrix(sample.column("vector").combine_chunks(), dim))
    shared = vectors.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, bits, scalars = shared.value.encode(_unit(_matrix(batch.column(1), dim)))
            columns = [pa.array(near.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(list(scalars), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["vec_id", "vector", "centre", "bits", "scalars"])

    return stored(good.mapInArrow(run, schema), "codes"), codec


class _Best:
    """The k best (score, smaller id first) of each query so far, and the k-th score."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.query, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = np.concatenate([self.query, query]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]
        kth = np.flatnonzero(np.arange(len(query)) - first == self.k - 1)
        self.least[query[kth]] = scores[kth]


def search(index: DataFrame, codec: Codec | None, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows (vec_id, vector) of ``queries``."""
    spark, schema = index.sparkSession, "query_id bigint, vec_id bigint, score double"
    if codec is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = len(codec.rotation)
    asked = stored(queries.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), dim))
                   .groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    blocks = -(-asked.count() * dim * 8 // QUERY_BYTES) or 1
    found = []
    for block in range(blocks):
        # About QUERY_BYTES of queries, chosen by a hash of their ids.
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()
        if not some.num_rows:
            continue
        shared = spark.sparkContext.broadcast((codec, some.column("vec_id").to_numpy(), _matrix(some.column("vector").combine_chunks(), dim)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            codec, query_ids, originals = shared.value
            best, units = _Best(len(query_ids), k), _unit(originals)
            rows = max(1, _CELLS // len(query_ids))
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    ids, vectors = part.column(0).to_numpy(), _unit(_matrix(part.column(1), dim))
                    bits = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
                    scalars = part.column(4).flatten().to_numpy().reshape(-1, 3)
                    near = part.column(2).to_numpy()
                    upper = codec.upper(units, near, bits, scalars)
                    upper[np.searchsorted(query_ids, ids[own := np.isin(ids, query_ids)]), np.flatnonzero(own)] = -np.inf
                    # By falling bound: the first few settle the k-th score that rules out the others.
                    width = min(4 * k, len(ids))
                    top = np.argpartition(-upper, width - 1, axis=1)[:, :width]
                    q, v = np.repeat(np.arange(len(query_ids)), width), top.ravel()
                    seen = np.isfinite(upper[q, v])
                    q, v = q[seen], v[seen]
                    best.add(q, ids[v], np.einsum("ij,ij->i", units[q], vectors[v]))
                    upper[np.arange(len(query_ids))[:, None], top] = -np.inf
                    q, v = np.nonzero(upper >= np.where(np.isfinite(best.least), best.least, -2)[:, None])
                    for cut in range(0, len(q), _CELLS // 8):
                        a, b = q[cut:cut + _CELLS // 8], v[cut:cut + _CELLS // 8]
                        best.add(a, ids[b], np.einsum("ij,ij->i", units[a], vectors[b]))
            if len(best.query):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.query]), pa.array(best.ids), pa.array(best.scores)], names=["query_id", "vec_id", "score"])

        found.append(stored(index.mapInArrow(run, schema), "found"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
