"""Registry of the named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..scale import spread
from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Inputs made for the query being built; one query reads and checks each of them once.
_inputs: dict[tuple, DataFrame] = {}


def once(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Give the same DataFrame object for the same arguments within one query."""
    @wraps(fn)
    def shared(spark: SparkSession, *args) -> DataFrame:
        key = (fn.__qualname__, *args)
        if key not in _inputs:
            _inputs[key] = fn(spark, *args)
        return _inputs[key]

    return shared


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its own tests check the result."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
            _inputs.clear()
            return fn(ship(spark), sf_dir)

        QUERIES[name] = fresh
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# Tables whose rows carry much work, with their key.
_HEAVY = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}


@once
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _HEAVY[name]) if name in _HEAVY else df
