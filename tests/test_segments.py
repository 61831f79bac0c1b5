"""A standing index under upserts and deletes, against a rebuild of what is live."""

import random

import pytest
from pyspark.sql import functions as F

from recalloom.functions.embedding import hashing_embedder
from recalloom.operators import bm25, search
from recalloom.sources.segments import ConcurrentChange, SegmentStore

WORDS = [f"word{i}" for i in range(60)]


def batch(spark, ids, rng):
    rows = [(str(i), " ".join(rng.choices(WORDS, k=rng.randint(0, 30))), f"text {i}") for i in ids]
    return rows, spark.createDataFrame(rows, "chunk_id string, index_text string, content_text string")


def questions(spark):
    return spark.createDataFrame([(i, f"word{i} word{i * 7 % 60} word{i * 3 % 60} nowhere") for i in range(8)], "query_id long, question string")


def lists(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


def check(spark, store, live):
    table = spark.createDataFrame([(i, *row) for i, row in live.items()], "chunk_id string, index_text string, content_text string")
    asked = questions(spark)
    index = store.open()
    assert sorted(map(tuple, index.chunks.select("chunk_id", "index_text", "content_text").collect())) == sorted((i, *row) for i, row in live.items())
    assert lists(bm25.sparse_topk(index.sparse, asked, 6)) == lists(bm25.sparse_topk(bm25.fit(table), asked, 6))
    assert store.count() == len(live)
    return index


def test_any_series_of_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(11)
    store, live = SegmentStore(spark, str(tmp_path / "index")), {}
    steps = [("+", range(0, 40)), ("+", range(30, 50)), ("-", range(10, 20)), ("+", range(5, 15)), ("-", [3, 999]), ("+", range(0, 3)), ("-", range(20, 50)), ("+", range(100, 103))]
    for n, (kind, ids) in enumerate(steps):
        if kind == "+":
            rows, df = batch(spark, ids, rng)
            store.upsert(df)
            live.update({r[0]: r[1:] for r in rows})
        else:
            store.delete(spark.createDataFrame([(str(i),) for i in ids], "chunk_id string"))
            for i in ids:
                live.pop(str(i), None)
        manifest = store.manifest()
        # What is read stays within twice what is live, in few segments.
        assert sum(s["rows"] for s in manifest["segments"]) <= max(2 * len(live), 1) or len(manifest["segments"]) == 1
        if n in (1, 3, 7):
            check(spark, store, live)
    removed = store.vacuum(1)
    assert removed
    check(spark, store, live)
    assert store.vacuum(1) == []


def test_changes_at_once_and_bad_batches(spark, tmp_path):
    rng = random.Random(2)
    store = SegmentStore(spark, str(tmp_path / "index"), embed=hashing_embedder(16))
    assert store.count() == 0 and store.open().chunks.count() == 0
    rows, df = batch(spark, range(12), rng)
    store.upsert(df, {"source": 7})
    assert store.manifest()["tags"] == {"source": 7}
    stale = store.manifest()
    store.delete(spark.createDataFrame([("3",)], "chunk_id string"))
    with pytest.raises(ConcurrentChange):
        store._commit(stale, stale["segments"])
    assert store.count() == 11 and store.manifest()["number"] == stale["number"] + 1
    with pytest.raises(ValueError, match="once"):
        store.upsert(df.unionByName(df.limit(1)))
    assert store.count() == 11
    index = store.open()
    asked = questions(spark).withColumn("embedding", hashing_embedder(16)(F.col("question")))
    found = search.search(index, asked, "hybrid", 4)
    assert found.count() == 32 and found.where("content_text not like 'text %' or chunk_id = '3'").count() == 0


def test_stream_feeds_the_index_once(spark, tmp_path):
    from recalloom.streaming.ingest import feed_index

    store, landing = SegmentStore(spark, str(tmp_path / "index")), str(tmp_path / "landing")
    schema = "chunk_id string, index_text string, content_text string"

    def run():
        stream = spark.readStream.schema(schema).parquet(landing)
        feed_index(stream, store, str(tmp_path / "checkpoint"), "landing").awaitTermination()

    spark.createDataFrame([("a", "word1 word2", "one"), ("b", "word3", "two")], schema).coalesce(1).write.mode("append").parquet(landing)
    run()
    number = store.manifest()["number"]
    run()
    assert store.count() == 2 and store.manifest()["number"] == number
    spark.createDataFrame([("b", "word9", "new"), ("c", "word1", "three")], schema).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert store.count() == 3
    assert {r["chunk_id"]: r["content_text"] for r in store.open().chunks.collect()} == {"a": "one", "b": "new", "c": "three"}
    # A batch that comes again after its commit is passed over.
    from recalloom.streaming.ingest import take_in
    last = store.manifest()
    take_in(store, "landing", store.open().chunks, last["tags"]["landing"])
    assert store.manifest()["number"] == last["number"]
