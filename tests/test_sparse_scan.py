import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recalloom.functions import embedding
from recalloom.operators import bm25, sparse_scan
from recalloom.plans import evaluation_queries
from test_retrieval import brute_bm25, ranked


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    docs = {f"d{i:03d}": " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for i in range(n)}
    # A third of the texts are copies of one, so that lists are full of ties.
    docs.update({d: "w1 w2 w2" for d in list(docs)[::3]})
    return docs, {i: " ".join(rng.choice([*words, "unknown"]) for _ in range(6)) for i in range(9)}


def test_no_pair_of_chunk_and_question_is_shuffled(spark):
    docs, asked = corpus()
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id string, index_text string").repartition(5)
    queries = spark.createDataFrame(list(asked.items()), "query_id int, question string")
    found = bm25.sparse_topk(bm25.fit(chunks), queries, 4)
    assert ranked(found) == {q: s for q, s in brute_bm25(docs, asked, 4).items() if s}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The chunks meet the questions inside the tasks: no grouping by both, no row per occurrence dealt by chunk.
    assert "Aggregate" not in plan and "RepartitionByExpression [chunk_id" not in plan


@pytest.mark.parametrize("cells", [1, 30, 1 << 20])
def test_blocks_and_batches_do_not_change_the_lists(monkeypatch, cells):
    monkeypatch.setattr(sparse_scan, "BLOCK_CELLS", cells)
    docs, asked = corpus()
    terms = {q: sorted(set(t.split())) for q, t in asked.items()}
    weights = {d: [(t, 1.0 + len(t) + i % 3) for i, t in enumerate(sorted(set(x.split())))] for d, x in docs.items()}
    table = pa.table({"token": list(terms.values()), "qw": [[1.0 + j for j in range(len(t))] for t in terms.values()]})
    rows = [(g, d, [t for t, _ in w], [x for _, x in w]) for g in (0, 1) for d, w in weights.items() if g == 0 or d > "d050"]
    schema = pa.schema([("g", pa.int32()), ("chunk_id", pa.string()), ("t", pa.list_(pa.string())), ("w", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 17]), schema)], schema=schema) for i in range(0, len(rows), 17)]
    out = pa.schema([("_group", pa.int32()), ("_query", pa.int32()), ("chunk_id", pa.string()), ("score", pa.float64())])
    got = {}
    for batch in sparse_scan.scan(iter(batches), sparse_scan.asked_by(table), 3, out):
        for r in batch.to_pylist():
            got.setdefault((r["_group"], r["_query"]), []).append((r["chunk_id"], r["score"]))
    for g in (0, 1):
        for number, (q, words) in enumerate(terms.items()):
            scores = {}
            for d, w in weights.items():
                held = [x * (1.0 + words.index(t)) for t, x in w if t in words]
                if held and (g == 0 or d > "d050"):
                    scores[d] = round(sum(held), 6)
            want = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:3]
            assert sorted(got.get((g, number), []), key=lambda s: (-s[1], s[0])) == want


def test_texts_are_tokenised_once(spark):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "two")], "chunk_id string, index_text string")
    queries = spark.createDataFrame([(1, "two")], "query_id int, question string")
    found = bm25.sparse_topk(bm25.fit(chunks), queries, 2)
    # Scores and statistics come from what was written of the tokens.
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["b", "a"]


def test_study_detects_sections_once(spark, tmp_path):
    text = "Head\n" + "some longer words about nothing at all, " * 20
    spark.createDataFrame([(1, text, "en", "web"), (2, text, "de", "book")], "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    arms = evaluation_queries.study_arms(spark, str(tmp_path))
    assert arms._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    rows = arms.select("with_meta", "section_mode", "doc_id", "ord", "content_text", "index_text").collect()
    pure = {r[1:4]: r for r in rows if not r.with_meta}
    meta = {r[1:4]: r for r in rows if r.with_meta}
    assert pure.keys() == meta.keys() and len(rows) == 2 * len(pure) > 4
    assert all(r.index_text == r.content_text and meta[key].index_text.endswith("\n" + r.content_text)
               and "文件摘要：" in meta[key].index_text and meta[key].content_text == r.content_text for key, r in pure.items())
    some = evaluation_queries.study_arms(spark, str(tmp_path), spark.createDataFrame([(2,)], "doc_id long"))
    assert {r.doc_id for r in some.collect()} == {2} and some.count() == len(rows) // 2


def test_hashing_embedder_keeps_few_tokens_and_the_same_vectors(spark):
    texts = ["apple banana apple", "", None, "x y", " ".join(f"word{i}" for i in range(300)), "banana"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r.i: r.v for r in df.select("i", embedding.hashing_embedder(16)(F.col("t")).alias("v")).collect()}
    for i, text in enumerate(texts):
        want = [0.0] * 16
        for token in [w for w in (text or "").split() if len(w) > 1]:
            want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += 1
        norm = sum(x * x for x in want) ** 0.5 or 1.0
        assert got[i] == pytest.approx([x / norm for x in want])
    # A worker remembers a bounded part of the vocabulary: a million strings before.
    assert embedding._slot.cache_info().maxsize <= 1 << 16
