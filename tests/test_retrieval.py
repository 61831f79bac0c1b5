import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recalloom.operators import bm25, dense, fusion, search
from recalloom.scale import frequent_keys_join, is_small

DOCS = {"d1": "apple banana apple", "d2": "banana cherry", "d3": "", "d4": "apple cherry cherry dates",
        "d5": "the the the the fig", "d6": "banana cherry"}
QUERIES = {"q1": "apple apple cherry", "q2": "unknown words", "q3": "banana", "q4": ""}


def brute_bm25(docs, queries, k, k1=1.5, b=0.75):
    toks = {d: [t for t in x.split() if len(t) > 1] for d, x in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = {}
    for q, text in queries.items():
        scores = {}
        for d, ts in toks.items():
            tf, total, hit = Counter(ts), 0.0, False
            for t, f in Counter(text.split()).items():
                if t in tf:
                    hit = True
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
                    total += f * (1 + math.log(f)) * idf * tf[t] / (
                        tf[t] + k1 * (1 - b + b * len(ts) / max(avg, 1)))
            if hit:
                scores[d] = round(total, 6)
        out[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def frames(spark):
    chunks = spark.createDataFrame(list(DOCS.items()), "chunk_id string, index_text string")
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, question string")
    return chunks, queries


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


def test_sparse_topk_matches_brute_force(spark):
    chunks, queries = frames(spark)
    got = ranked(bm25.sparse_topk(bm25.fit(chunks), queries, 3))
    assert got == {q: s for q, s in brute_bm25(DOCS, QUERIES, 3).items() if s}


def test_stored_postings_and_shuffled_queries_give_the_same(spark, monkeypatch):
    chunks, queries = frames(spark)
    want = ranked(bm25.sparse_topk(bm25.fit(chunks), queries, 3))
    tokenised = bm25.tokenise(chunks)
    for share in (0.0, 0.4, 2.0):
        stored = bm25.SparseIndex(postings=bm25.document_weights(tokenised, share=share))
        assert ranked(bm25.sparse_topk(stored, queries, 3)) == want
    monkeypatch.setattr(bm25, "is_small", lambda *a, **k: False)
    assert ranked(bm25.sparse_topk(bm25.fit(chunks), queries, 3)) == want


def test_several_indexes_in_one_plan(spark):
    chunks, queries = frames(spark)
    both = chunks.withColumn("arm", F.lit("a")).unionByName(
        chunks.where("chunk_id != 'd4'").withColumn("arm", F.lit("b")))
    got = bm25.sparse_topk(bm25.fit(both, by=["arm"]), queries, 3)
    fewer = {d: t for d, t in DOCS.items() if d != "d4"}
    assert ranked(got.where("arm = 'a'")) == {q: s for q, s in brute_bm25(DOCS, QUERIES, 3).items() if s}
    assert ranked(got.where("arm = 'b'")) == {q: s for q, s in brute_bm25(fewer, QUERIES, 3).items() if s}


def test_token_ids_are_dense_and_ordered(spark):
    chunks, _ = frames(spark)
    rows = bm25.token_ids(bm25.vocabulary(bm25.tokenise(chunks)), prefix_chars=1).collect()
    want = sorted(((r.df, r.token) for r in rows), key=lambda x: (-x[0], x[1]))
    assert [(r.df, r.token) for r in sorted(rows, key=lambda r: r.token_id)] == want
    assert sorted(r.token_id for r in rows) == list(range(len(rows)))


def test_frequent_keys_join_keeps_every_row(spark):
    rows = [("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(20)] + [("gone", 1)]
    large = spark.createDataFrame(rows, "k string, v int")
    lookup = large.where("k != 'gone'").groupBy("k").count()
    for floor in (1, 10, 1000):
        got = frequent_keys_join(large, lookup, ["k"], F.col("count") >= floor)
        assert sorted((r.k, r.v) for r in got.collect()) == sorted(r for r in rows if r[0] != "gone")


def test_size_check(spark, monkeypatch):
    df = spark.range(10)
    assert is_small(df, 10) and not is_small(df, 9) and not is_small(df, 100, 20)
    monkeypatch.setattr("recalloom.scale.BROADCAST_MAX_ROWS", 5)
    assert not is_small(spark.range(6)) and not is_small(spark.range(6), 100) and is_small(spark.range(5))
    assert is_small(spark.range(0))


@pytest.mark.parametrize("blocks", [False, True])
def test_dense_topk_matches_brute_force(spark, monkeypatch, blocks):
    rng = np.random.default_rng(1)
    vec = rng.normal(size=(60, 8)).round(3)
    vec[40:] = vec[3]  # a third of the vectors are copies of one
    qry = rng.normal(size=(7, 8)).round(3)
    v = spark.createDataFrame([(f"v{i:02d}", x.tolist()) for i, x in enumerate(vec)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(qry)], "query_id int, embedding array<double>")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    if blocks:
        monkeypatch.setattr(dense, "MAX_SHARED_QUERIES", 6)
    got = ranked(dense.dense_topk(v.repartition(5), q, 6, block_rows=25))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(qry) @ unit(vec).T, 6)
    for i in range(len(qry)):
        order = sorted(range(60), key=lambda j: (-sims[i][j], f"v{j:02d}"))[:6]
        assert [c for c, _ in got[i]] == [f"v{j:02d}" for j in order]
        assert [s for _, s in got[i]] == pytest.approx([sims[i][j] for j in order], abs=1e-9)


def test_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [1.0, 0.0])], "g string, embedding array<float>")
    assert {r.g: r.embedding for r in dense.mean_vectors(df, "g").collect()} == {"a": [2.0, 4.0], "b": [1.0, 0.0]}


ROUTES = [("q", 0, 1, 0.9, "x"), ("q", 0, 2, 0.5, "y"), ("q", 0, 3, 0.1, "z"),
          ("q", 1, 1, 7.0, "y"), ("q", 1, 2, 3.0, "w"), ("p", 1, 1, 1.0, "v")]


def fuse(spark, fn, rows=ROUTES, **kw):
    df = spark.createDataFrame(rows, "query_id string, route int, rank int, score double, chunk_id string")
    out = {}
    for r in fn(df, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.fusion_score))
    return out


def test_rrf_sum_and_max(spark):
    r = lambda n: round(1 / (60 + n), 6)
    got = fuse(spark, fusion.rrf)
    assert got["q"] == [("y", round(1 / 62 + 1 / 61, 6)), ("x", r(1)), ("w", r(2)), ("z", r(3))]
    assert got["p"] == [("v", r(1))]
    assert fuse(spark, fusion.rrf, mode="max")["q"] == [("x", r(1)), ("y", r(1)), ("w", r(2)), ("z", r(3))]
    assert len(fuse(spark, fusion.rrf, k=2)["q"]) == 2


def test_rrf_sum_matches_brute_force(spark):
    rng, rows = random.Random(2), []
    for route in range(4):
        rows += [("q", route, i + 1, rng.random(), c) for i, c in enumerate(rng.sample("abcdefghij", 6))]
    scores, seen = {}, []
    for _, _, rank, _, c in rows:
        scores[c] = scores.get(c, 0) + 1 / (60 + rank)
        if c not in seen:
            seen.append(c)
    want = sorted(seen, key=lambda c: -round(scores[c], 6))
    assert [c for c, _ in fuse(spark, fusion.rrf, rows)["q"]] == want


def test_weighted_max(spark):
    got = dict(fuse(spark, fusion.weighted_max, weights=(0.3, 0.7))["q"])
    assert got["x"] == pytest.approx(0.3, abs=1e-5) and got["y"] == pytest.approx(0.7, abs=1e-5)
    # A single candidate spans no range and scales to zero.
    assert fuse(spark, fusion.weighted_max)["p"] == [("v", 0.0)]


def test_hybrid_falls_back_to_vectors_without_known_words(spark):
    chunks, queries = frames(spark)
    vectors = chunks.select("chunk_id", F.array(F.length("index_text").cast("double"), F.lit(1.0)).alias("embedding"))
    index = search.Index(chunks, bm25.fit(chunks), vectors)
    asked = queries.where("query_id = 'q2'").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    hybrid = search.retrieve(index, asked, "hybrid", 3).orderBy("rank").collect()
    vector = search.retrieve(index, asked, "vector", 3).orderBy("rank").collect()
    assert [r.chunk_id for r in hybrid] == [r.chunk_id for r in vector]
    with pytest.raises(ValueError):
        search.retrieve(index, asked, "nearest")


def test_multi_query_merges_equal_texts(spark):
    chunks, queries = frames(spark)
    chunks = chunks.withColumn("content_text", F.col("index_text"))
    rewrites = spark.createDataFrame([("q3", 1, "cherry banana")], "query_id string, route int, question string")
    index = search.Index(chunks, bm25.fit(chunks))
    asked = queries.where("query_id = 'q3'")
    by_id = [r.chunk_id for r in search.multi_query(index, asked, rewrites, "bm25", 5).orderBy("rank").collect()]
    by_text = [r.chunk_id for r in search.multi_query(index, asked, rewrites, "bm25", 5, "content_text").orderBy("rank").collect()]
    assert {"d2", "d6"} <= set(by_id) and len({"d2", "d6"} & set(by_text)) == 1


def test_rerank_keeps_order_of_equals(spark):
    hits = spark.createDataFrame([("q", 1, "a", 0.2), ("q", 2, "b", 0.9), ("q", 3, "c", 0.2)],
                                 "query_id string, rank int, chunk_id string, s double")
    rows = search.relevance_order(hits, F.col("s")).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"]
    assert search.relevance_order(hits, F.col("s"), 2).count() == 2
