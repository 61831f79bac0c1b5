"""Helpers shared by the operators: scratch tables, checked broadcasts, shipping to executors."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship

# A side is broadcast only when its measured size stays below this; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

# Whole texts go to Python tasks in Arrow batches of about this size, held twice by the JVM and by Python.
ARROW_BYTES = 1 << 20

# The white space of the contracts: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and bounded Arrow batches; a size set by the submitter stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(ARROW_BYTES))
    return ship(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Cuts the lineage: later steps neither repeat the work nor need the executors that did it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def payload_bytes(df: DataFrame, limit: int) -> int:
    """Bytes of ``df`` as JSON, arrays included, looking at no more than ``limit`` rows + 1."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return 1 << 62 if rows > limit else int(size or 0)


def broadcast_if_bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast for a stored table of measured size; leave a larger one to shuffle."""
    return F.broadcast(df) if payload_bytes(df, max_rows) <= max_bytes else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the decimal text of a key, modulo ``n``."""
    return F.crc32(F.col(column).cast("string")) % n


def fresh_name(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores added until no column has it (in any case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
