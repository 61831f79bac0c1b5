"""Queries on the sparse model, search, fusion and reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.embedding import hashing_embedder
from ..operators import block_search, bm25, dense, fusion, generation, search
from ..scale import broadcast_if_small, is_small
from ..session import checkpoint_dir
from ..sources.segments import SegmentStore
from .catalog import once, query, table

DIM = 64
K = config.TOP_K


@once
def corpus(spark, sf_dir) -> DataFrame:
    """Whole documents as chunks."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("index_text"),
        F.col("text").alias("content_text"), "source")


@once
def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def tokens_sql(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), "
            "lambda t: length(t) > 1)")


MODEL = f"""ct AS (SELECT doc_id AS chunk_id, {tokens_sql('text')} AS tokens FROM documents),
st AS (SELECT count(*) AS n, sum(len(tokens))::DOUBLE / greatest(count(*), 1) AS avgdl FROM ct),
tf AS (SELECT chunk_id, dl, token, count(*) AS tf
       FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM ct) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
voc AS (SELECT token, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, st)"""


def weight_sql(k1: float = 1.5, b: float = 0.75) -> str:
    return f"idf * tf / (tf + {k1} * ({1 - b} + {b} * dl / greatest(avgdl, 1)))"


def query_sql(src: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""(SELECT query_id, token, count(*) AS qtf FROM (
  SELECT query_id, unnest({tokens_sql('text')}) AS token FROM ({src})) GROUP BY ALL)"""


def sparse_sql(k: int, name: str = "sparse", src: str | None = None, k1: float = 1.5,
               b: float = 0.75, ids: str = "query_id") -> str:
    """CTEs ending in the top-k list ``name``."""
    terms = query_sql(src) if src else query_sql()
    return f"""{name}_all AS (SELECT {ids}, chunk_id,
    round(sum(qtf * (1 + ln(greatest(qtf, 1))) * {weight_sql(k1, b)}), 6) AS score
  FROM {terms} JOIN tf USING (token) JOIN voc USING (token), st GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY score DESC, chunk_id)::INTEGER AS rank
  FROM {name}_all QUALIFY rank <= {k})"""


@query("bm25_stats", f"""WITH {MODEL}
SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM voc) AS vocab_size FROM st""")
def bm25_stats(spark, sf_dir):
    tokenised = bm25.tokenise(corpus(spark, sf_dir))
    vocab = bm25.document_frequencies(tokenised).agg(F.count(F.lit(1)).alias("n")).scalar()
    return bm25.corpus_stats(tokenised).select(
        "n_docs", F.round("avgdl", 6).alias("avgdl"), vocab.alias("vocab_size"))


@query("bm25_vocab", f"""WITH {MODEL}
SELECT token, df, round(idf, 6) AS idf, row_number() OVER (ORDER BY df DESC, token) - 1 AS token_id FROM voc""")
def bm25_vocab(spark, sf_dir):
    vocab = bm25.vocabulary(bm25.tokenise(corpus(spark, sf_dir)))
    return bm25.token_ids(vocab).select("token", "df", F.round("idf", 6).alias("idf"), "token_id")


@query("bm25_doc_weights", f"""WITH {MODEL}
SELECT chunk_id, token, tf::INTEGER AS tf, round({weight_sql()}, 6) AS weight
FROM tf JOIN voc USING (token), st""")
def bm25_doc_weights(spark, sf_dir):
    weights = bm25.document_weights(bm25.tokenise(corpus(spark, sf_dir)))
    return weights.select("chunk_id", "token", "tf", F.round("weight", 6).alias("weight"))


@query("bm25_query_weights", f"""WITH {MODEL}
SELECT query_id, token, round(qtf * (1 + ln(greatest(qtf, 1))), 6) AS qw
FROM {query_sql()} JOIN voc USING (token)""")
def bm25_query_weights(spark, sf_dir):
    """Query vectors; tokens that the corpus does not know are dropped."""
    known = bm25.document_frequencies(bm25.tokenise(corpus(spark, sf_dir))).select("token")
    q = bm25.query_terms(questions(spark, sf_dir))
    return q.join(known, "token", "left_semi").select(
        "query_id", "token", F.round("qw", 6).alias("qw"))


def sparse_hits(spark, sf_dir, k: int = K, **params) -> DataFrame:
    return bm25.sparse_topk(bm25.fit(corpus(spark, sf_dir), **params), questions(spark, sf_dir), k)


@query("search_sparse_topk", f"""WITH {MODEL}, {sparse_sql(K)}
SELECT query_id, chunk_id, score, rank FROM sparse""")
def search_sparse_topk(spark, sf_dir):
    return sparse_hits(spark, sf_dir).select("query_id", "chunk_id", "score", "rank")


def block_hits(spark, sf_dir, k: int = K) -> block_search.BlockHits:
    """Search by blocks over the postings of the questions' tokens."""
    asked = questions(spark, sf_dir)
    terms = bm25.query_terms(asked)
    matches = bm25.fit(corpus(spark, sf_dir)).matches(terms.select("token").distinct(), is_small(asked, max_bytes=config.QUERY_TEXT_MAX_BYTES))
    return block_search.search_blocks(block_search.build_blocks(matches), terms, k)


@query("search_sparse_blocks", f"""WITH {MODEL}, {sparse_sql(K)}
SELECT query_id, chunk_id, score, rank FROM sparse""")
def search_sparse_blocks(spark, sf_dir):
    """The lists of ``search_sparse_topk``, with blocks left out by their bounds."""
    return block_hits(spark, sf_dir).hits


@query("sparse_block_bounds", f"""WITH {MODEL}, {sparse_sql(K)}
SELECT query_id, count(DISTINCT chunk_id) AS chunks, max(score) AS best, count(DISTINCT token) AS tokens,
       true AS bounded FROM (SELECT query_id, token FROM {query_sql()} SEMI JOIN voc USING (token)) JOIN sparse_all USING (query_id)
GROUP BY query_id""")
def sparse_block_bounds(spark, sf_dir):
    """Per question: chunks sharing a token, their best score, tokens; and that no bound is below a score of its block."""
    asked = questions(spark, sf_dir)
    terms = bm25.query_terms(asked)
    small = is_small(asked, max_bytes=config.QUERY_TEXT_MAX_BYTES)
    index = block_search.build_blocks(bm25.fit(corpus(spark, sf_dir)).matches(terms.select("token").distinct(), small))
    # Without any list to fill there is no floor: every block is scored.
    asked_terms = terms.join(index.maxima.select("token").distinct(), "token", "left_semi")
    bounds = index.maxima.join(asked_terms, "token").groupBy("query_id", "block").agg(F.sum(F.col("qw") * F.col("top")).alias("bound"))
    scores = index.postings.join(asked_terms, "token").groupBy("query_id", "block", "chunk_id").agg(
        F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
    best = scores.groupBy("query_id", "block").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("chunks"))
    tokens = asked_terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("tokens"))
    return best.join(bounds, ["query_id", "block"]).groupBy("query_id").agg(
        F.sum("chunks").alias("chunks"), F.max("score").alias("best"),
        F.bool_and(F.col("bound") + block_search.SLACK >= F.col("score")).alias("bounded")).join(tokens, "query_id")


CHANGED = """(SELECT d.doc_id, CASE WHEN quality = 0 THEN text || ' ' || source ELSE text END AS text
      FROM documents d LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1)"""
CHANGED_MODEL = MODEL.replace("doc_id AS chunk_id", "doc_id::VARCHAR AS chunk_id").replace("FROM documents)", f"FROM {CHANGED})", 1)


@query("search_incremental", f"""WITH {CHANGED_MODEL}, {sparse_sql(K)}
SELECT query_id, chunk_id, score, rank FROM sparse""")
def search_incremental(spark, sf_dir):
    """Search a standing index after changes: all documents come in, those of poor quality again with
    their source added, and toxic ones are deleted."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = SegmentStore(spark, f"{checkpoint_dir(spark)}/standing-index-{uuid.uuid4().hex}", columns="")
    marked = docs.select("doc_id", "text", "source").join(broadcast_if_small(labels), "doc_id")
    key = F.col("doc_id").cast("string").alias("chunk_id")
    store.upsert(docs.select(key, F.col("text").alias("index_text")))
    store.upsert(marked.where("quality = 0").select(key, F.concat("text", F.lit(" "), "source").alias("index_text")))
    store.delete(marked.where("toxic = 1").select(key))
    hits = bm25.sparse_topk(store.open().sparse, questions(spark, sf_dir), K)
    return hits.select("query_id", "chunk_id", "score", "rank")


@query("search_dense_topk", f"""WITH e AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label AS query_id, i, avg(x) AS y FROM e GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(y * y)) AS nq FROM m GROUP BY ALL),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS nv FROM e GROUP BY ALL),
s AS (SELECT query_id, vec_id AS chunk_id, round(sum(x * y) / any_value(nq * nv), 6) AS score
      FROM e JOIN m USING (i) JOIN qn USING (query_id) JOIN vn USING (vec_id) GROUP BY ALL)
SELECT query_id, chunk_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
FROM s QUALIFY rank <= {K}""")
def search_dense_topk(spark, sf_dir):
    """The vectors nearest to the mean vector of every label."""
    vectors = table(spark, sf_dir, "embeddings")
    means = dense.mean_vectors(vectors.select(F.col("label").alias("query_id"), "embedding"),
                               "query_id")
    return dense.dense_topk(vectors, means, K, chunk_id="vec_id")


HASHED = f"""slots AS (SELECT chunk_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % {DIM} AS slot, sum(tf)::DOUBLE AS x
  FROM tf GROUP BY ALL),
vnorm AS (SELECT chunk_id, sqrt(sum(x * x)) AS nv FROM slots GROUP BY ALL)"""


def dense_sql(k: int, name: str = "dense", src: str | None = None) -> str:
    terms = query_sql(src) if src else query_sql()
    return f"""{name}_q AS (SELECT query_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % {DIM} AS slot, sum(qtf)::DOUBLE AS y
  FROM {terms} GROUP BY ALL),
{name}_n AS (SELECT query_id, sqrt(sum(y * y)) AS nq FROM {name}_q GROUP BY ALL),
{name}_dot AS (SELECT query_id, chunk_id, sum(x * y) AS d FROM slots JOIN {name}_q USING (slot) GROUP BY ALL),
{name}_all AS (SELECT query_id, chunk_id,
    round(coalesce(d, 0) / nq / CASE WHEN nv IS NULL OR nv = 0 THEN 1 ELSE nv END, 6) AS score
  FROM {name}_n CROSS JOIN ct LEFT JOIN vnorm USING (chunk_id) LEFT JOIN {name}_dot USING (query_id, chunk_id)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
  FROM {name}_all QUALIFY rank <= {k})"""


def hashed_index(spark, sf_dir) -> search.Index:
    chunks = corpus(spark, sf_dir)
    vectors = chunks.select("chunk_id", hashing_embedder(DIM)(F.col("index_text")).alias("embedding"))
    return search.Index(chunks, bm25.fit(chunks), vectors)


@once
def embedded_questions(spark, sf_dir) -> DataFrame:
    return questions(spark, sf_dir).withColumn("embedding", hashing_embedder(DIM)(F.col("question")))


TWO_ROUTES = f"""{MODEL}, {HASHED}, {dense_sql(2 * K)}, {sparse_sql(2 * K)},
routes AS (SELECT query_id, 0 AS route, rank, score, chunk_id FROM dense
           UNION ALL SELECT query_id, 1, rank, score, chunk_id FROM sparse)"""


def fused_sql_ranked(value: str, how: str, src: str = "routes") -> str:
    return f"""SELECT query_id, chunk_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id)::INTEGER AS rank
FROM (SELECT query_id, chunk_id, round({how}({value}), 6) AS score,
             min(route * 1000000 + rank) AS seen FROM {src} GROUP BY ALL)
QUALIFY rank <= {K}"""


@query("search_hashed_vector", f"""WITH {MODEL}, {HASHED}, {dense_sql(K)}
SELECT query_id, chunk_id, score, rank FROM dense""")
def search_hashed_vector(spark, sf_dir):
    return search.retrieve(hashed_index(spark, sf_dir), embedded_questions(spark, sf_dir),
                           "vector", K)


@query("search_hybrid_rrf", f"WITH {TWO_ROUTES} {fused_sql_ranked('1.0::DOUBLE / (60 + rank)', 'sum')}")
def search_hybrid_rrf(spark, sf_dir):
    return search.retrieve(hashed_index(spark, sf_dir), embedded_questions(spark, sf_dir),
                           "hybrid_rrf", K)


@query("fuse_rrf_max", f"WITH {TWO_ROUTES} {fused_sql_ranked('1.0::DOUBLE / (60 + rank)', 'max')}")
def fuse_rrf_max(spark, sf_dir):
    return search.retrieve(hashed_index(spark, sf_dir), embedded_questions(spark, sf_dir),
                           "rrf_max", K)


@query("fuse_weighted", f"""WITH {TWO_ROUTES}, scaled AS (
  SELECT *, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9) * 0.5 AS v
  FROM routes WINDOW w AS (PARTITION BY query_id, route))
{fused_sql_ranked('v', 'max', 'scaled')}""")
def fuse_weighted(spark, sf_dir):
    return search.retrieve(hashed_index(spark, sf_dir), embedded_questions(spark, sf_dir),
                           "weighted", K)


REWRITES = """SELECT item_id, 0 AS route, text FROM benchmark
UNION ALL SELECT item_id, 1, substr(text, 1, length(text) // 2) FROM benchmark
UNION ALL SELECT item_id, 2, substr(text, length(text) // 2 + 1) FROM benchmark"""


@once
def half_rewrites(spark, sf_dir) -> DataFrame:
    """Two rewrites per question: its first and its second half."""
    q = questions(spark, sf_dir)
    half = F.floor(F.length("question") / 2).cast("int")
    first = q.select("query_id", F.lit(1).alias("route"),
                     F.col("question").substr(F.lit(1), half).alias("question"))
    second = q.select("query_id", F.lit(2).alias("route"),
                      F.col("question").substr(half + 1, F.length("question")).alias("question"))
    return first.unionByName(second)


MQ_ROUTES = f"""{MODEL}, mq AS ({REWRITES}),
{sparse_sql(K, 'mqr', "SELECT item_id * 10 + route AS query_id, text FROM mq")},
routes AS (SELECT query_id // 10 AS query_id, query_id % 10 AS route, rank, score, chunk_id FROM mqr)"""


@query("multi_query_rrf", f"WITH {MQ_ROUTES} {fused_sql_ranked('1.0::DOUBLE / (60 + rank)', 'sum')}")
def multi_query_rrf(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return search.multi_query(search.Index(chunks, bm25.fit(chunks)), questions(spark, sf_dir),
                              half_rewrites(spark, sf_dir), "bm25", K)


@query("multi_query_by_content", f"""WITH {MQ_ROUTES},
texts AS (SELECT query_id, route, rank, r.score, chunk_id, d.text FROM routes r JOIN documents d ON d.doc_id = chunk_id),
fused AS (SELECT query_id, text, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(route * 1000000 + rank) AS seen,
            arg_max(chunk_id, score * 1e9 - route * 1000 - rank) AS chunk_id FROM texts GROUP BY query_id, text)
SELECT query_id, chunk_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, text)::INTEGER AS rank
FROM fused QUALIFY rank <= {K}""")
def multi_query_by_content(spark, sf_dir):
    """Equal texts fuse into one result, represented by the best-scored copy."""
    chunks = corpus(spark, sf_dir)
    return search.multi_query(search.Index(chunks, bm25.fit(chunks)), questions(spark, sf_dir),
                              half_rewrites(spark, sf_dir), "bm25", K, key="content_text")


OVERLAP = f"""round(len(list_intersect(list_distinct({tokens_sql('q.text')}), {tokens_sql('d.text')}))::DOUBLE
  / greatest(len(list_distinct({tokens_sql('q.text')})), 1), 6)"""


@query("rerank_overlap", f"""WITH {MODEL}, {sparse_sql(2 * K)},
o AS (SELECT s.query_id, s.chunk_id, s.rank AS old_rank, {OVERLAP} AS rerank_score
      FROM sparse s JOIN benchmark q ON q.item_id = s.query_id JOIN documents d ON d.doc_id = s.chunk_id)
SELECT query_id, chunk_id, old_rank, rerank_score,
       row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old_rank)::INTEGER AS rank
FROM o QUALIFY rank <= {K}""")
def rerank_overlap(spark, sf_dir):
    hits = search.with_payload(sparse_hits(spark, sf_dir, 2 * K), corpus(spark, sf_dir),
                               questions(spark, sf_dir), 2 * K)
    asked = hits.join(broadcast_if_small(questions(spark, sf_dir)), "query_id")
    best = search.relevance_order(
        asked, search.overlap_score(F.col("question"), F.col("content_text")), K)
    return best.select("query_id", "chunk_id", "old_rank", "rerank_score", "rank")


@query("hit_fields", f"""WITH {MODEL}, {sparse_sql(K)}
SELECT query_id, rank, chunk_id::VARCHAR AS id, score, d.text AS content_text, d.text AS index_text,
       source, '' AS file_id, '' AS section_id, chunk_id::VARCHAR AS chunk_id, '' AS file_name,
       '' AS file_type, '' AS file_summary, '' AS section_summary, '' AS section_title
FROM sparse JOIN documents d ON d.doc_id = chunk_id""")
def hit_fields(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    index = search.Index(chunks, bm25.fit(chunks))
    hits = search.search(index, questions(spark, sf_dir), "bm25", K)
    return hits.withColumn("id", F.col("id").cast("string"))


@query("context_format", f"""WITH {MODEL}, {sparse_sql(K)}
SELECT query_id, string_agg('[来源' || rank || ': ' || source || ']' || chr(10) || d.text,
                            chr(10) || chr(10) ORDER BY rank) AS context
FROM sparse JOIN documents d ON d.doc_id = chunk_id GROUP BY query_id""")
def context_format(spark, sf_dir):
    hits = search.with_payload(sparse_hits(spark, sf_dir), corpus(spark, sf_dir),
                               questions(spark, sf_dir), K)
    return generation.context_text(hits)


@query("chunk_search_return_parent", f"""WITH p AS (
  SELECT doc_id, (s / 1100)::INTEGER AS parent_idx, substr(text, s::BIGINT + 1, 1100) AS content_text
  FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 1100)) AS s FROM documents)),
c AS (SELECT doc_id, parent_idx, (s / 150)::INTEGER AS ord, substr(content_text, s::BIGINT + 1, 150) AS index_text
  FROM (SELECT *, unnest(generate_series(0, length(content_text) - 1, 150)) AS s FROM p)),
ct AS (SELECT doc_id || '#' || parent_idx || '#' || ord AS chunk_id, {tokens_sql('index_text')} AS tokens FROM c),
st AS (SELECT count(*) AS n, sum(len(tokens))::DOUBLE / greatest(count(*), 1) AS avgdl FROM ct),
tf AS (SELECT chunk_id, dl, token, count(*) AS tf
       FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM ct) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
voc AS (SELECT token, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, st),
{sparse_sql(K)}
SELECT query_id, string_split(chunk_id, '#')[1]::BIGINT AS doc_id,
       string_split(chunk_id, '#')[2]::INTEGER AS parent_idx, max(score) AS score
FROM sparse GROUP BY ALL""")
def chunk_search_return_parent(spark, sf_dir):
    """Search small children, return each parent once with its best child's score."""
    from ..operators import chunkers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("section_text"))
    children = chunkers.parent_child(docs, lambda c: chunkers.char_window_array(c, 1100),
                                     lambda c: chunkers.char_window_array(c, 150))
    keyed = children.withColumn("chunk_id", F.concat_ws("#", "doc_id", "parent_idx", "ord"))
    hits = bm25.sparse_topk(bm25.fit(keyed), questions(spark, sf_dir), K)
    part = F.split("chunk_id", "#")
    return hits.groupBy("query_id", part[0].cast("bigint").alias("doc_id"),
                        part[1].cast("int").alias("parent_idx")).agg(F.max("score").alias("score"))


@query("index_catalog", """SELECT lang AS kb, source AS suffix, lang || '__' || source AS collection, count(*) AS n_vectors
FROM documents GROUP BY ALL""")
def index_catalog(spark, sf_dir):
    """Collections by knowledge base prefix, with the number of texts each holds."""
    from ..sources.index_store import collection_name, split_collection

    docs = table(spark, sf_dir, "documents").select(
        collection_name(F.col("lang"), F.col("source")).alias("collection"))
    counts = docs.groupBy("collection").agg(F.count(F.lit(1)).alias("n_vectors"))
    kb, suffix = split_collection(F.col("collection"))
    return counts.select(kb.alias("kb"), suffix.alias("suffix"), "collection", "n_vectors")


@query("missing_indexes", """SELECT DISTINCT lang || '__' || source AS collection FROM documents
EXCEPT SELECT d.lang || '__' || d.source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1""")
def missing_indexes(spark, sf_dir):
    """Needed collections that do not exist: the difference of two name sets."""
    from ..sources.index_store import collection_name

    docs = table(spark, sf_dir, "documents")
    name = collection_name(F.col("lang"), F.col("source")).alias("collection")
    built = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return docs.select(name).distinct().join(built.select(name).distinct(), "collection", "left_anti")
