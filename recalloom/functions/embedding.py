"""Embedding providers. A provider turns a text column into a vector column.

The offline default is a hashed bag of words: deterministic, model-free and good enough to
exercise the vector route. Its results say nothing about a trained model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from .text import Tokenizer, word_tokens

Embedder = Callable[[Column], Column]


# Slots remembered by a worker; a batch looks up each of its different tokens once.
_KEPT_SLOTS = 1 << 16


@lru_cache(maxsize=_KEPT_SLOTS)
def _slot(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def _hashed_counts(token_lists: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors (rows x ``dim``) of listed tokens; tokens stay in Arrow, only different ones become strings."""
    tokens = token_lists.flatten().dictionary_encode()
    slots = np.array([_slot(t, dim) for t in tokens.dictionary.to_pylist()], dtype="int64")
    lengths = pc.fill_null(pc.list_value_length(token_lists), 0).to_numpy(zero_copy_only=False)
    cell = np.repeat(np.arange(len(token_lists)) * dim, lengths) + slots[tokens.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(cell, minlength=len(token_lists) * dim).astype("float64").reshape(-1, dim)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return counts / np.where(norm == 0, 1.0, norm)


def hashing_embedder(dim: int = 64, tokenizer: Tokenizer = word_tokens) -> Embedder:
    """Unit vectors of token counts hashed into ``dim`` slots."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def hashed(token_lists: pa.Array) -> pa.Array:
        vectors = _hashed_counts(token_lists, dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * dim, pa.int32()), pa.array(vectors.ravel()))

    return lambda text: hashed(tokenizer(F.coalesce(text, F.lit(""))))


def local_model_embedder(model: str = "BAAI/bge-small-zh-v1.5") -> Embedder:
    """A sentence-transformers model loaded once per Python worker; needs that package."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        encoder = SentenceTransformer(model)
        for texts in batches:
            vectors = encoder.encode(texts.fillna("").tolist(), normalize_embeddings=True)
            yield pd.Series(list(np.asarray(vectors, dtype="float32")))

    return encode


def remote_embedder(base_url: str, model: str, api_key: str = "", batch: int = 10,
                    retries: int = 30, wait_seconds: float = 60.0, post=None) -> Embedder:
    """An OpenAI-compatible embeddings endpoint, called in small batches from the tasks."""
    from .models import post_json, with_retry

    send = post or post_json

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def ask(texts):
            reply = with_retry(lambda: send(f"{base_url}/embeddings",
                                            {"model": model, "input": texts}, api_key),
                               retries, lambda attempt: wait_seconds)
            ordered = sorted(reply["data"], key=lambda d: d["index"])
            return [np.asarray(d["embedding"], dtype="float32") for d in ordered]

        for texts in batches:
            todo = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(todo), batch) for v in ask(todo[i:i + batch])])

    return encode


EMBEDDING_SOURCES = {
    "hashing": lambda **kw: hashing_embedder(**kw),
    "local": lambda **kw: local_model_embedder(**kw),
    "remote": lambda **kw: remote_embedder(**kw),
}


def embedder(source: str = "hashing", **settings) -> Embedder:
    if source not in EMBEDDING_SOURCES:
        raise ValueError(f"unknown embedding source {source!r}")
    return EMBEDDING_SOURCES[source](**settings)


def expected_dim(source: str) -> int:
    return config.EMBED_DIM_LOCAL if source == "local" else config.EMBED_DIM_REMOTE
