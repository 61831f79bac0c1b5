"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: its words, and their first four and five letters. Each term has
a weight and a vector; a text's score is the logistic of a bias, the weights of its terms, and
the inner products of the vectors of each two of its terms, so a term that is harmless alone
can count beside another one.

The machine is trained in one task on a bounded sample of labelled rows, chosen by a hash of
their keys; everything else runs over all rows and whole texts.

Edges: null and empty texts have no terms and get the score of the bias. Rows with a null label
or id teach nothing; labels repeated for an id count once, as the largest. Without any labelled
row every text scores 0. Rows repeated score alike. Extra columns are carried along.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, stored
from .ragged import Rows, Words, giving_back, packs, resident, windows

# Labelled rows that the machine learns from, about: what the training task holds.
SAMPLE_ROWS = 12_000
HASH_BITS = 18
FACTORS = 8
# A term gets weights if it is in MIN_TEXTS training texts and either its share of toxic ones is
# no chance (chi square of MIN_CHANCE or more) or a COMMON share of the texts have it; the latter
# may say nothing alone but something beside another term.
MIN_TEXTS, MIN_CHANCE, COMMON = 4, 20.0, 0.1
_EDGE = string.punctuation + "«»“”„‘’…–—¿¡"


class Terms:
    """Hashed terms of texts; the terms of a word are worked out once."""

    def __init__(self) -> None:
        self.rows = Rows(np.uint32)
        self.words = Words(self._new, self.rows.clear)

    def _new(self, words: list[str], first: int) -> None:
        flat, counts = [], []
        for word in words:
            word = word.lower().strip(_EDGE)
            terms = [word, *("^" + word[:n] for n in (4, 5) if len(word) > n)] if word else []
            flat.extend(zlib.crc32(t.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1) for t in terms)
            counts.append(len(terms))
        self.rows.extend(np.array(flat, np.uint32), np.array(counts, np.int64))

    def of(self, text: str) -> np.ndarray:
        """The distinct terms of a text."""
        found = [self.rows.gather(np.unique(self.words.numbers(w.split())))[0] for w in windows(text)]
        return np.unique(np.concatenate(found))


@dataclass
class Machine:
    """Terms outside ``known`` play no part."""

    known: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def place(self) -> np.ndarray:
        """For each term its row in the weights; those without one share the last, empty row."""
        at = np.full(1 << HASH_BITS, len(self.known), np.int64)
        at[self.known] = np.arange(len(self.known))
        return at

    def pack(self) -> bytes:
        head = np.array([len(self.known), self.vectors.shape[1]], np.int64).tobytes()
        parts = (self.known.astype(np.uint32), np.array([self.bias]), self.weights.astype(np.float32), self.vectors.astype(np.float32))
        return head + b"".join(x.tobytes() for x in parts)

    @staticmethod
    def unpack(data: bytes) -> Machine:
        n, k = np.frombuffer(data, np.int64, 2)
        known = np.frombuffer(data, np.uint32, n, 16)
        at = 16 + 4 * n
        bias = float(np.frombuffer(data, np.float64, 1, at)[0])
        weights = np.frombuffer(data, np.float32, n + 1, at + 8)
        return Machine(known, bias, weights, np.frombuffer(data, np.float32, (n + 1) * k, at + 12 + 4 * n).reshape(n + 1, k))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.zeros((len(ends), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(ends > starts)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def margins(bias: float, weights: np.ndarray, vectors: np.ndarray, terms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The margin of each text, and the sum of its terms' vectors."""
    chosen = vectors[terms]
    both = _sums(chosen, ends)
    pairs = 0.5 * ((both ** 2).sum(1) - _sums(np.einsum("ij,ij->i", chosen, chosen), ends))
    return bias + _sums(weights[terms], ends) + pairs, both


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(term_sets: list[np.ndarray], labels: np.ndarray, epochs: int = 20, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Logistic loss, minibatches, adaptive steps; the same rows in the same order give the same machine."""
    counts = np.bincount(np.concatenate([np.empty(0, np.uint32), *term_sets]).astype(np.int64), minlength=1 << HASH_BITS)
    toxic = np.bincount(np.concatenate([np.empty(0, np.uint32), *(t for t, y in zip(term_sets, labels, strict=True) if y)]).astype(np.int64),
                        minlength=1 << HASH_BITS)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    chance = (toxic - counts * share) ** 2 / np.maximum(counts * share * (1 - share), 1e-9)
    known = np.flatnonzero((counts >= MIN_TEXTS) & ((chance >= MIN_CHANCE) | (counts >= COMMON * len(labels)))).astype(np.uint32)
    rng, m = np.random.default_rng(seed), len(known)
    machine = Machine(known, -30.0, np.zeros(m + 1), rng.normal(0, 0.01, (m + 1, FACTORS)))
    machine.vectors[m] = 0
    if not len(labels):
        return machine
    at = machine.place()
    rows = [x[x < m] for x in (at[t] for t in term_sets)]
    bias, w, v = float(np.log(share / (1 - share))), machine.weights, machine.vectors
    past_b, past_w, past_v = 1e-6, np.full(m + 1, 1e-6), np.full((m + 1, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 256)):
            terms, ends = np.concatenate([rows[i] for i in batch]), np.cumsum([len(rows[i]) for i in batch])
            margin, both = margins(bias, w, v, terms, ends)
            error = (_logistic(margin) - labels[batch]) / len(batch)
            each = np.repeat(error, np.diff(ends, prepend=0))
            used, inverse = np.unique(terms, return_inverse=True)
            gw = np.bincount(inverse, each, len(used)) + decay * w[used]
            pull = each[:, None] * (np.repeat(both, np.diff(ends, prepend=0), axis=0) - v[terms])
            gv = np.stack([np.bincount(inverse, pull[:, f], len(used)) for f in range(FACTORS)], 1) + decay * v[used]
            gb = float(error.sum())
            past_b += gb * gb
            past_w[used] += gw * gw
            past_v[used] += gv * gv
            bias -= rate * gb / past_b ** 0.5
            w[used] -= rate * gw / np.sqrt(past_w[used])
            v[used] -= 0.2 * rate * gv / np.sqrt(past_v[used])
    machine.bias = bias
    return machine


def _worker_terms() -> Terms:
    return resident("toxicity", Terms)


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, label`` of about ``rows`` labelled documents, chosen by a hash of the id."""
    known = stored(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
                   .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")), "labels")
    share = rows / max(known.count(), 1)
    chosen = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    # Of about ``rows`` rows at any size of the table, so it can be broadcast.
    few = F.broadcast(known.where(chosen))
    named = docs.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text_col}`").alias("text"))
    return named.join(few, F.col("_key") == F.col("_id")).select("_key", "text", F.col("_label").alias("label"))


def train(labelled: DataFrame) -> bytes:
    """The packed machine for rows of ``_key, text, label`` (0 or 1); see ``sample``."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_terms()
        for batch in batches:
            found = [words.of(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["_key", "terms", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(k, lab, t) for b in batches for k, t, lab in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort()
        machine = fit([np.frombuffer(t, np.uint32) for _, _, t in rows], np.array([lab for _, lab, _ in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([machine.pack()], pa.binary())], names=["machine"])

    rows = labelled.select(F.col("_key").cast("string"), "text", F.col("label").cast("int")).mapInArrow(giving_back(terms), "_key string, terms binary, label int")
    return rows.repartition(1).mapInArrow(giving_back(learn), "machine binary").first()[0]


def score(docs: DataFrame, machine: bytes, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the text replaced by its score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = _worker_terms(), Machine.unpack(shared.value)
        at = model.place()
        for batch in batches:
            scores = []
            for texts in packs(batch.column(batch.num_columns - 1).to_pylist()):
                sets = [x[x < len(model.known)] for x in (at[words.of(t)] for t in texts)]
                margin, _ = margins(model.bias, model.weights, model.vectors, np.concatenate(sets), np.cumsum([len(x) for x in sets]))
                scores.append(_logistic(margin.astype(np.float64)))
            values = pa.array(np.concatenate([np.empty(0), *scores]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*batch.schema.names[:-1], score_col])

    others = [c for c in docs.columns if c != text_col]
    score_col = fresh_name(others, score_col)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), f"`{score_col}` double"])
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`")).mapInArrow(giving_back(run), schema)
