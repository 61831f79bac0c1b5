"""Continuous intake of a knowledge base: new Markdown files join the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.markdown import FILE_SCHEMA, shape_files
from ..sources.segments import SegmentStore


def markdown_stream(spark: SparkSession, path: str, kb: str, files_per_trigger: int = 10_000) -> DataFrame:
    """``kb, file_id, text`` of every file that appears below ``path``, each once."""
    files = (spark.readStream.format("text").schema(FILE_SCHEMA).option("wholetext", True)
             .option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_trigger)
             .load(path))
    return shape_files(files, kb)


def ingest(spark: SparkSession, path: str, kb: str, documents: str, checkpoint: str) -> StreamingQuery:
    """Append what is new and stop. The file sink and checkpoint make a restart exact."""
    return (markdown_stream(spark, path, kb).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).partitionBy("kb")
            .trigger(availableNow=True).start(documents))


def take_in(store: SegmentStore, source: str, chunks: DataFrame, batch_id: int) -> None:
    """Upsert one batch of a stream. A batch that was committed before is passed over; of several
    rows of one id in a batch the greatest is taken, as they have no order."""
    if store.manifest()["tags"].get(source, -1) >= batch_id:
        return
    rest = [c for c in chunks.columns if c != "chunk_id"]
    once = chunks.groupBy("chunk_id").agg(F.max(F.struct(*rest)).alias("_row")).select("chunk_id", "_row.*")
    store.upsert(once, {source: batch_id})


def feed_index(chunks: DataFrame, store: SegmentStore, checkpoint: str, source: str) -> StreamingQuery:
    """Upsert a stream of chunks into a standing index and stop when all that is there was taken in.

    The number of a batch is committed together with its rows, so a restart takes in each batch once.
    """
    return (chunks.writeStream.foreachBatch(lambda df, batch_id: take_in(store, source, df, batch_id))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
