"""Size checks and skew handling shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS
from .session import checkpoint_dir


def _measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes (as JSON) of the first ``BROADCAST_MAX_ROWS + 1`` rows.

    Kept with the DataFrame object, so one table handed to several operators is read once.
    """
    if "_measured_size" not in df.__dict__:
        width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        rows, size = df.limit(BROADCAST_MAX_ROWS + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
        df.__dict__["_measured_size"] = (rows, size or 0)
    return df.__dict__["_measured_size"]


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
             max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows and ``max_bytes``.

    Reads at most one row more than ever allowed, so the check stays cheap on a large input.
    """
    rows, size = _measured(df)
    return rows <= min(max_rows, BROADCAST_MAX_ROWS) and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast only for a side of checked size; a larger one is left to shuffle."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Feed all cores from a table too small to do so itself.

    A file of one row group is read by one task, which would then also do all the text
    work behind it. A table of at least as many splits as cores is returned unchanged, so
    a large one is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None,
          rank: str = "rank") -> DataFrame:
    """Keep the ``k`` first rows of each group and number them from 1; ``None`` keeps all.

    The row_number filter lets Spark cut every group to ``k`` rows before the shuffle, so
    a hot group never reaches one task whole.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def frequent_keys_join(large: DataFrame, lookup: DataFrame, on: Sequence[str],
                       hot: Column) -> DataFrame:
    """Join on keys of very uneven frequency; ``lookup`` has one row per key.

    ``hot`` picks the frequent keys of ``lookup``. The caller chooses it so that they are
    provably few; they are joined by broadcast and leave the shuffle to keys none of which
    dominates. Every row falls in exactly one of the two parts.
    """
    on = list(on)
    frequent = F.broadcast(lookup.where(hot))
    frequent_keys = F.broadcast(lookup.where(hot).select(*on))
    return large.join(frequent, on).unionByName(
        large.join(frequent_keys, on, "left_anti").join(lookup.where(~hot), on))


def written(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Write a table and go on from what was written.

    What follows neither repeats the work behind it nor depends on any executor that did it.
    """
    parts = [c for c in by if c in df.columns]
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)
    back = df.sparkSession.read.parquet(path)
    # Partition values come back with inferred types; keep those they had.
    return back.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a step of a query below the shared checkpoint folder and go on from it."""
    return written(df, f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


# Bits of monotonically_increasing_id below the number of the partition.
_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Number the rows from ``start`` on in ``order``, which should tell all rows apart.

    Rows are dealt by ranges of the order, sorted inside each range and written with their place in it; a number is that
    place plus the rows of the ranges before, of which there is one count per partition. No task sees more than its range.
    Equal rows get different numbers in any order; an empty table stays empty; a former column ``name`` is replaced.
    """
    place = "_place"
    while place in df.columns:
        place += "_"
    # The write fixes ranges and places: sampled ranges may differ from one run of a plan to the next.
    ranged = df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = staged(ranged.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = f"{place}_part"
    keyed = kept.withColumn(part, F.shiftrightunsigned(place, _ROW_BITS))
    before = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = keyed.groupBy(part).count().select(part, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col(place) - F.shiftleft(F.col(part), _ROW_BITS)
    return keyed.join(F.broadcast(offsets), part).select(
        *[F.col(f"`{c}`") for c in kept.columns if c != place], (F.col("_before") + inside + start).alias(name))
