"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per
digest, the digests that the index lacks are found by a sort-merge anti join in which only the
batch is shuffled, and they are appended. DataFrame and SQL operations only.

Edges: null text counts as empty. A null id is larger than any other, so such a row stays only
where its text has no row with an id. Rows repeated with the same id and text form one group of
which exactly one row stays. An empty batch gives no rows and leaves the index as it is. Extra
columns are carried along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_bounded, fresh_name, scratch, stored

_NULL_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Every run of white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """One row (digest, keep_id) per known text, in ``buckets`` buckets sorted by digest.

    ``path`` lives in a folder that all executors share. Opening an existing path declares the
    table again over its files, so the index outlives the session. ``buckets`` must be the same
    for every session that opens the path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add digests; the write deals them to buckets in the order of the index."""
        # One task per bucket and so one file: no task opens all the buckets.
        (rows.select("digest", "keep_id").repartition(self.buckets, "digest")
         .write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name))


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, place) per row, stored: what is left of the texts for all later steps.

    ``place`` tells rows apart that repeat an id and a text.
    """
    return stored(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), digest(F.col(f"`{text_col}`")).alias("digest"))
                  .withColumn("place", F.monotonically_increasing_id()), "digests")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide every row of a batch and add its new texts to the index.

    Returns ``id, keep_id, group_size, kept, digest``. ``group_size`` counts the rows of the
    batch with that text. Rows whose text the index knew give way to the id stored there; of the
    others the row with the smallest id stays. A row with the very id that the index holds stays
    too, so a batch that is run again, after its texts were appended, is decided as before.
    """
    rows = groups_of(docs, id_col, text_col)
    order = F.struct(F.coalesce("id", F.lit(_NULL_ID)).alias("at"), "place")
    # Partial aggregation: a text that a third of all rows share leaves each task as one row.
    texts = rows.groupBy("digest").agg(F.min(order).alias("first"), F.min("id").alias("least"),
                                       F.count(F.lit(1)).alias("group_size"))
    texts = stored(texts, "texts")
    new = texts.hint("merge").join(index.table().hint("merge"), "digest", "left_anti")
    new = stored(new, "new-texts")
    index.append(new.select("digest", F.col("least").alias("keep_id")))
    keepers = new.select("digest", F.col("least").alias("keep_id"), "group_size", F.col("first.place").alias("keep_place"))
    known = stored(texts.join(new, "digest", "left_anti").select("digest", "group_size")
                   .join(index.table(), "digest").select("digest", "keep_id", "group_size"), "known-texts")
    if known.isEmpty():
        known = known.withColumn("keep_place", F.lit(None).cast("bigint"))
    else:
        held = known.select(F.col("digest").alias("_digest"), "keep_id")
        held = (rows.join(held, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("keep_id")))
                .groupBy("digest").agg(F.min("place").alias("keep_place")))
        known = known.join(held, "digest", "left")
    decided = rows.join(keepers.unionByName(known), "digest")
    return decided.select("id", "keep_id", "group_size", F.coalesce(F.col("place") == F.col("keep_place"), F.lit(False)).alias("kept"), "digest")


def kept_rows(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were."""
    d, p, n = (fresh_name([*docs.columns, "id"], c) for c in ("digest", "id", "n"))
    # Of a pair of id and text all rows are alike in these two columns: those of a dropped pair all
    # go; of a pair that repeats one row stays, and such pairs are few.
    gone = (deduplicate(docs, index, id_col, text_col).groupBy("id", "digest")
            .agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("rows"))
            .where(~F.col("any") | (F.col("rows") > 1))
            .select(F.col("id").alias(f"{p}_"), F.col("digest").alias(f"{d}_"), F.col("any").alias(n)))
    gone = stored(gone, "dropped")
    repeated = gone.where(n).limit(1).count() > 0
    gone = broadcast_if_bounded(gone)
    keyed = docs.withColumn(d, digest(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(f"{p}_")) & (F.col(f"`{d}`") == F.col(f"{d}_"))
    once = keyed.join(gone, same, "left_anti").drop(d)
    if not repeated:
        return once
    again = keyed.join(gone.where(n), same, "left_semi").dropDuplicates([id_col, d]).drop(d)
    return once.unionByName(again)


def run_index(spark: SparkSession, name: str = "digest-index", buckets: int = 64) -> DigestIndex:
    """An empty index in the shared folder of this session."""
    return DigestIndex(spark, scratch(spark, name), buckets)
