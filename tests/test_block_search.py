"""Search by blocks against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from recalloom.operators import block_search, bm25

RARE = [f"rare{i}" for i in range(300)]
COMMON = [f"common{i}" for i in range(12)]


def corpus(spark, n=900, seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(COMMON, k=rng.randint(3, 40)) + rng.choices(RARE, k=rng.randint(0, 4))) for _ in range(n)]
    texts += ["common0 " * 30] * 40 + ["", " ", "rare7"]  # many equal scores
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, index_text string")


def asked(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(RARE, 2) + rng.sample(COMMON, 2))) for i in range(12)]
    rows += [(90, "common0"), (91, "rare7"), (92, "nowhere at all"), (93, ""), (94, "rare7 rare7 common3"), (95, None)]
    return spark.createDataFrame(rows, "query_id long, question string")


@pytest.mark.parametrize("k, size, seeds", [(5, 16, 4), (1, 64, 1), (40, 8, 2), (2000, 16, 4)])
def test_blocks_give_the_lists_of_a_full_search(spark, k, size, seeds):
    index, questions = bm25.fit(corpus(spark)), asked(spark)
    want = sorted(map(tuple, bm25.sparse_topk(index, questions, k).select("query_id", "chunk_id", "score", "rank").collect()))
    weights = bm25.document_weights(index.tokenised)
    found = block_search.search_blocks(block_search.build_blocks(weights, size=size), bm25.query_terms(questions), k, seeds)
    got = sorted(map(tuple, found.hits.select("query_id", "chunk_id", "score", "rank").collect()))
    assert got == want and want
    read = block_search.blocks_read(found.blocks)
    total = read.agg(F.sum("postings"), F.sum("postings_read"), F.sum("blocks"), F.sum("blocks_scored")).first()
    assert total[1] <= total[0] and total[3] <= total[2]
    if k <= 5:
        # The words of the rare sort decide these lists: most postings are never read.
        assert total[1] < 0.7 * total[0]
    if k == 2000:
        assert total[3] == total[2]


def test_several_indexes_at_once(spark):
    chunks = corpus(spark, 200)
    both = chunks.withColumn("corpus", F.lit("a")).unionByName(chunks.where("chunk_id % 2 = 0").withColumn("corpus", F.lit("b")))
    index, questions = bm25.fit(both, by=["corpus"]), asked(spark)
    want = sorted(map(str, bm25.sparse_topk(index, questions, 3).select("corpus", "query_id", "chunk_id", "score", "rank").collect()))
    weights = bm25.document_weights(index.tokenised, ["corpus"])
    found = block_search.search_blocks(block_search.build_blocks(weights, ["corpus"], 16), bm25.query_terms(questions), 3)
    assert sorted(map(str, found.hits.collect())) == want


def test_one_token_in_all_chunks_fills_many_blocks(spark):
    chunks = spark.createDataFrame([(i, "same words here") for i in range(500)], "chunk_id long, index_text string")
    weights = bm25.document_weights(bm25.tokenise(chunks))
    sizes = block_search.assign_blocks(weights, size=10).groupBy("block").count().collect()
    assert sum(r["count"] for r in sizes) == 500 and max(r["count"] for r in sizes) < 60 and len(sizes) > 15
    empty = block_search.build_blocks(weights.where("false"))
    assert block_search.search_blocks(empty, bm25.query_terms(asked(spark))).hits.count() == 0
