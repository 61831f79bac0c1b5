"""The index as partitioned tables: chunks, postings, vocabulary, statistics and vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.text import word_tokens
from ..operators.bm25 import SparseIndex
from ..operators.enrich import cache_misses
from ..operators.search import Index


def collection_name(kb: Column, suffix: Column, with_meta: bool = False) -> Column:
    """``{kb}__{suffix}`` with ``_meta`` for an index that carries metadata."""
    tail = [F.lit("_meta")] if with_meta else []
    return F.concat(kb, F.lit(config.NAME_SEPARATOR), suffix, *tail)


def split_collection(name: Column) -> tuple[Column, Column]:
    """Knowledge base and suffix of a collection name, cut at the first separator."""
    at = F.instr(name, config.NAME_SEPARATOR)
    n = len(config.NAME_SEPARATOR)
    return name.substr(F.lit(1), at - 1), name.substr(at + n, F.length(name))


# An index is named by these columns; every table of the store is partitioned by them.
KEY = ("kb", "chunker", "section_mode", "with_meta")
TABLES = ("chunks", "postings", "vocab", "stats", "vectors")
# A build writes all tables under a version of its own. This table says which version of an
# index is read: its last row for the index. It is written last, and only ever appended to.
CURRENT = "current"


class IndexStore:
    """Indexes below one directory. Reads prune to the partitions of the named index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, table: str) -> bool:
        try:
            self.table(table)
            return True
        except AnalysisException:
            return False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def keys(self) -> DataFrame:
        """The indexes there are; only partition names and footers are read."""
        return self._current().select(*KEY)

    def _switches(self) -> DataFrame:
        schema = "kb string, chunker string, section_mode string, with_meta boolean, version string, place bigint"
        if not self._exists(CURRENT):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{CURRENT}")

    def _current(self) -> DataFrame:
        last = self._switches().groupBy(*KEY).agg(F.max_by("version", "place").alias("version"))
        return last.where("version is not null")

    def version(self, key: dict) -> str | None:
        """The version that is read of an index; null when there is none."""
        row = self._only(self._current(), key).first()
        return row["version"] if row else None

    def switch(self, key: dict, version: str | None) -> None:
        """Read this version of an index from now on; without one the index is dropped."""
        place = (self._switches().agg(F.max("place")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(*[key[c] for c in KEY], version, place)], self._switches().schema)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/{CURRENT}")

    def drop(self, key: dict) -> None:
        """Serve an index no longer. Its files stay until the store's folder is tidied."""
        if self.has(key):
            self.switch(key, None)

    def knowledge_bases(self) -> list[str]:
        return sorted(r[0] for r in self.keys().select("kb").distinct().collect())

    def strategies(self, kb: str) -> list[str]:
        """Names below one knowledge base, as they follow its prefix in a collection name."""
        rows = self.keys().where(F.col("kb") == kb).collect()
        return sorted({r["chunker"] + ("_meta" if r["with_meta"] else "") for r in rows})

    def has(self, key: dict) -> bool:
        return not self._only(self.keys(), key).isEmpty()

    @staticmethod
    def _only(df: DataFrame, key: dict) -> DataFrame:
        # Partition values are compared as written, whatever type the reader infers.
        for column in KEY:
            df = df.where(F.col(column).cast("string") == str(key[column]).lower()
                          if column == "with_meta" else F.col(column).cast("string") == key[column])
        return df

    def read(self, name: str, key: dict) -> DataFrame:
        version = self.version(key)
        if version is None:
            raise LookupError(f"no index {key}; build it first")
        return self.read_version(name, key, version)

    def read_version(self, name: str, key: dict, version: str) -> DataFrame:
        return self._only(self.table(name), key).where(F.col("version") == version).drop(*KEY, "version")

    def count(self, key: dict) -> int:
        """Chunks in an index, 0 when there is none."""
        return self.read("chunks", key).count() if self.has(key) else 0

    def write(self, name: str, df: DataFrame, key: dict, version: str, *inner: str) -> None:
        """Write one version's part of a table; a repeated write leaves the same result."""
        if key["kb"][:1].isdigit():
            raise ValueError("the name of a knowledge base must not start with a digit")
        keyed = df.withColumns({**{c: F.lit(key[c]) for c in KEY}, "version": F.lit(version)})
        (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*KEY, "version", *inner).parquet(f"{self.path}/{name}"))

    def open(self, key: dict, tokenizer=word_tokens) -> Index:
        vectors = None
        if self._exists("vectors"):
            found = self.read("vectors", key)
            vectors = None if found.isEmpty() else found
        buckets = self.read("stats", key).first()["buckets"]
        sparse = SparseIndex(postings=self.read("postings", key), buckets=buckets)
        return Index(self.read("chunks", key), sparse, vectors, tokenizer)


class MetadataCache:
    """Model-made summaries, kept between builds in an append-only table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def extend(self, wanted: DataFrame, make) -> DataFrame:
        """Append ``make(misses)`` for the rows not cached yet and return the whole cache."""
        misses = cache_misses(wanted, self.read(), self.key)
        if not misses.isEmpty():
            columns = self.spark.createDataFrame([], self.schema).columns
            make(misses).select(*columns).write.mode("append").parquet(self.path)
        return self.read()
