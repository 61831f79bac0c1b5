"""Rebuilt indexes, several chunkers in one run, and what a search falls back to."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import value
from recalloom.config import RecallConfig
from recalloom.functions.embedding import hashing_embedder
from recalloom.functions.scoring import REASON_KEY, score_reason
from recalloom.functions.text import TOKENIZERS
from recalloom.operators import fusion, search
from recalloom.plans import build, experiment, multi_query
from recalloom.sources import index_store

TOK = TOKENIZERS["cjk_bigram"]


def corpus(spark, files, seed=1):
    rng = random.Random(seed)
    letters = [chr(0x4E00 + i) for i in range(400)]
    texts = ["".join(rng.choice(letters) for _ in range(4000)) for _ in range(files)]
    docs = spark.createDataFrame([(f"文件{i}", t) for i, t in enumerate(texts)], "file_id string, text string")
    asked = [(f"Q{i}-{j}", t[at:at + 40], t[at:at + 180], f"文件{i}") for i, t in enumerate(texts) for j, at in enumerate((1000, 1420, 2600))]
    return docs, spark.createDataFrame(asked, "query_id string, question string, gold_answer string, ref_file string")


def setup_at(spark, path, **more):
    return build.Build(index_store.IndexStore(spark, str(path)), TOK, **more)


def test_chunkers_together_measure_as_alone(spark, tmp_path):
    docs, tests = corpus(spark, 3)
    setup, names = setup_at(spark, tmp_path / "store"), ["fixed_1100", "fixed_1500"]

    def rates(run, values):
        cfg = RecallConfig(kb="k", variable="chunker", values=values, retriever="bm25", top_k_values=[2], section_mode="raw")
        return run(cfg)["recall"]

    def flags(df, name):
        return {tuple(r) for r in df.where(F.col(name[0]) == name[1]).select("query_id", "hit_rank", "single", "merged", "concat", "file").collect()}

    def plain(cfg):
        return experiment.run_recall(cfg, tests, setup, docs)

    together = rates(plain, names)
    labels = sorted(r[0] for r in together.select("pipeline").distinct().collect())
    rewrites = tests.select("query_id", F.lit(1).alias("route"), "question")
    several = rates(lambda cfg: multi_query.run_multi_query(cfg, tests, rewrites, setup, docs), names)
    for name, label in zip(names, labels):
        alone = rates(plain, [name])
        assert flags(together, ("pipeline", label)) == flags(alone, ("pipeline", label)) != set()
        one = rates(lambda cfg: multi_query.run_multi_query(cfg, tests, rewrites, setup, docs), [name])
        assert flags(several, ("chunker", name)) == flags(one, ("chunker", name)) != set()


def test_rebuild_leaves_nothing_behind(spark, tmp_path):
    docs, _ = corpus(spark, 3)
    key = build.index_key("k", "fixed_1100", "raw")
    first = setup_at(spark, tmp_path, embed=hashing_embedder(16, TOK), token_buckets=5)
    build.build_index(docs, key, first)
    old = first.store.version(key)
    small = docs.where("file_id = '文件1'")
    second = setup_at(spark, tmp_path, token_buckets=2)
    n = build.build_index(small, key, second, force=True)
    index = second.store.open(key, TOK)
    ids = {r[0] for r in index.chunks.select("chunk_id").collect()}
    assert len(ids) == n == second.store.count(key) and index.vectors is None
    assert {r[0] for r in index.sparse.postings.select("chunk_id").distinct().collect()} == ids
    assert index.sparse.postings.agg(F.max("bucket")).first()[0] <= 1
    assert second.store.read_version("chunks", key, old).count() > n  # the version before is whole still

    def broken(docs, key, setup, whole=build.bm25.corpus_stats):
        raise RuntimeError("lost")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(build.bm25, "corpus_stats", broken)
        with pytest.raises(Exception):
            build.build_index(docs, key, second, force=True)
    assert second.store.count(key) == n
    second.store.drop(key)
    assert not second.store.has(key) and second.store.knowledge_bases() == [] and second.store.count(key) == 0
    assert build.build_index(docs, key, second) > n


def test_bm25_needs_its_side(spark):
    chunks = spark.createDataFrame([("c", "t", [1.0])], "chunk_id string, index_text string, embedding array<float>")
    asked = spark.createDataFrame([("q", "t", [1.0])], "query_id string, question string, embedding array<float>")
    index = search.Index(chunks, None, chunks.select("chunk_id", "embedding"), TOK)
    with pytest.raises(ValueError):
        search.retrieve(index, asked, "bm25", 1)
    assert search.retrieve(index, asked, "hybrid", 1).count() == 1


def test_blank_texts_stand_for_themselves(spark):
    hits = spark.createDataFrame([("q", 0, 1, 1.0, "a", ""), ("q", 0, 2, 0.9, "b", None), ("q", 1, 1, 1.0, "a", ""), ("q", 1, 2, 0.5, "c", "x"), ("q", 0, 3, 0.1, "d", "x")],
                                 "query_id string, route int, rank int, score double, chunk_id string, content_text string")
    got = fusion.rrf(hits, key="content_text").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "c", "b"]
    assert got[1].content_text == "x"


@pytest.mark.parametrize("frame", ["{}", "```json\n{}\n```", "Here it is: {}", "```\n{}```\nDone."])
def test_grades_between_fences(spark, frame):
    want = "[必答]1: 得分\n[选答]1: 0分"
    for body in ('{"%s": ["[必答]1: 得分", "[选答]1: 0分"], "总分": 3}', "{'%s': ['[必答]1: 得分', '[选答]1: 0分']}"):
        assert value(spark, score_reason(F.col("reply")), reply=frame.replace("{}", body % REASON_KEY)) == want


def test_reranking_keeps_all_of_a_longer_list(spark, tmp_path):
    docs, tests = corpus(spark, 2)
    cfg = RecallConfig(kb="k", variable="retriever", values=["vector"], reranker="bge_reranker", chunker="fixed_1100", top_k_values=[8], section_mode="raw")
    hits = experiment.run_recall(cfg, tests, setup_at(spark, tmp_path, embed=hashing_embedder(16, TOK)), docs)["hits"]
    assert hits.groupBy("query_id").count().agg(F.min("count")).first()[0] == 8
