"""Row numbers in an order, without one task that sees all rows."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from recalloom.operators import bm25
from recalloom.scale import numbered
from recalloom.sources import test_sets


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x").alias("_place"), F.lit(0).alias("n.b"))
    got = numbered(rows, [F.desc("v")], "n", 1)
    assert got.columns == ["v", "_place", "n.b", "n"]
    pairs = sorted((r["n"], r["v"]) for r in got.collect())
    want = sorted((r["v"] for r in rows.collect()), reverse=True)
    assert pairs == list(enumerate(want, 1))


def test_ties_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (0, "c")], "v int, t string")
    got = numbered(rows, [F.asc_nulls_first("v")], "n").collect()
    assert sorted(r["n"] for r in got) == [0, 1, 2, 3] and {r["n"]: r["t"] for r in got}[0] == "b"
    assert numbered(rows.where("false"), [F.asc("v")], "n").count() == 0
    assert sorted(r["v"] for r in numbered(rows.where("v is not null"), [F.desc("t")], "v").select("v").collect()) == [0, 1, 2]


def test_tokens_seen_once_fill_many_ranges(spark):
    words = [f"same{i:05d}" for i in range(4000)]
    chunks = spark.createDataFrame([(i, " ".join(words[i * 40:(i + 1) * 40])) for i in range(100)] + [(100, "common"), (101, "common")],
                                   "chunk_id long, index_text string")
    ids = bm25.token_ids(bm25.vocabulary(bm25.tokenise(chunks)))
    assert [r["token"] for r in ids.orderBy("token_id").collect()] == ["common", *words]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = bm25.token_ids(bm25.vocabulary(bm25.tokenise(chunks)))
        files = [f.removeprefix("file:").replace("///", "/") for f in ids.inputFiles()]
        sizes = sorted(n for n in (pq.read_metadata(f).num_rows for f in files) if n)
        assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_test_set_of_several_files_is_numbered_by_name(spark, tmp_path):
    # The second file is larger, so Spark reads it first.
    for name, count in (("a", 3), ("b", 400)):
        text = "question,正确回答\n" + "".join(f"{name}{i},answer\n" for i in range(count))
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    folder = tmp_path / "set.csv"
    folder.mkdir()
    for name in "ab":
        (folder / f"{name}.csv").write_bytes((tmp_path / f"{name}.csv").read_bytes())
    rows = {r["question"]: r["query_id"] for r in test_sets.read_test_set(spark, str(folder)).collect()}
    assert rows == {f"a{i}": f"Q{i + 1}" for i in range(3)} | {f"b{i}": f"Q{i + 4}" for i in range(400)}
    parquet = str(tmp_path / "set.parquet")
    spark.createDataFrame([(f"q{i}", "x") for i in range(50)], "question string, point string").coalesce(1).write.parquet(parquet)
    rows = {r["question"]: r["query_id"] for r in test_sets.read_test_set(spark, parquet).collect()}
    assert rows == {f"q{i}": f"Q{i + 1}" for i in range(50)}
