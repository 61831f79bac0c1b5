"""Queries on recall, scoring, comparison and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_MAX_ROWS
from ..functions.text import keep_charset
from ..operators import bm25, chunkers, compare, enrich, recall, reports, scores, search, sections
from ..scale import broadcast_if_small, is_small, staged
from .catalog import once, query, table
from .retrieval_queries import (MODEL, MQ_ROUTES, corpus, fused_sql_ranked, half_rewrites, questions,
                                sparse_hits, sparse_sql, tokens_sql)
from .text_queries import DOCS_MD, SECTIONS, documents_with_headings, window_sql

# Two settings of the sparse model stand for two strategies.
STRATEGIES = {"default": {}, "no_length_norm": {"b": 0.0}}


@once
def test_set(spark, sf_dir) -> DataFrame:
    """Benchmark items as questions that quote their own gold answer; each names the file
    of the document bearing its number."""
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit(" "), "source", F.lit(".pdf")).alias("ref_file"))
    items = questions(spark, sf_dir).withColumn("gold_answer", F.col("question"))
    return files.join(broadcast_if_small(items), "query_id").select(
        "query_id", "question", "gold_answer", "ref_file")


TEST_SET = """ts AS (SELECT item_id AS query_id, b.text AS gold, source AS ref
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"""


def document_hits(spark, sf_dir, k: int, **params) -> DataFrame:
    """BM25 hits on whole documents with text and source, as runs of one pipeline."""
    hits = sparse_hits(spark, sf_dir, k, **params)
    return search.with_payload(hits, corpus(spark, sf_dir), questions(spark, sf_dir), k).select(
        "query_id", "rank", "chunk_id", "score", "content_text", "source")


def flags_sql(name: str, hits: str, keys: str = "query_id", flag: str = "contains(d.text, gold)") -> str:
    """CTE with the recall flags of each result list."""
    return f"""{name} AS (SELECT {keys}, hit_rank, file_rank, (hit_rank > 0)::INTEGER AS single,
    (file_rank > 0)::INTEGER AS "file", (hit_rank > 0)::INTEGER AS merged
  FROM (SELECT {keys}, coalesce(min(CASE WHEN {flag} THEN rank END), 0)::INTEGER AS hit_rank,
          coalesce(min(CASE WHEN contains(d.source, ref) OR contains(ref, d.source) THEN rank END), 0)::INTEGER AS file_rank
        FROM {hits} h JOIN documents d ON d.doc_id = h.chunk_id JOIN ts USING (query_id) GROUP BY {keys}))"""


def rates_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_questions, round(avg(single) * 100, 6) AS single_rate,
       round(avg(merged) * 100, 6) AS merged_rate, round(avg("file") * 100, 6) AS file_rate,
       coalesce(round(avg(CASE WHEN single = 1 THEN hit_rank END), 6), 0) AS avg_hit_rank
FROM {src} GROUP BY {keys}"""


@query("recall_per_question", f"""WITH {MODEL}, {sparse_sql(5)}, {TEST_SET}, {flags_sql('r', 'sparse')}
SELECT query_id, hit_rank, file_rank, single, "file", merged FROM r""")
def recall_per_question(spark, sf_dir):
    hits = document_hits(spark, sf_dir, 5).withColumn("pipeline", F.lit("bm25")).withColumn(
        "top_k", F.lit(5))
    return recall.question_recall(hits, test_set(spark, sf_dir), measure="verbatim",
                                  concat=False).drop("pipeline", "top_k")


@query("recall_rollup_by_k", f"""WITH {MODEL}, {sparse_sql(10)}, {TEST_SET},
cut AS (SELECT s.*, top_k FROM sparse s, (SELECT unnest([1, 3, 5, 10])::INTEGER AS top_k) WHERE rank <= top_k),
{flags_sql('r', 'cut', 'top_k, query_id')}
{rates_sql('r', 'top_k')}""")
def recall_rollup_by_k(spark, sf_dir):
    """One search at the largest k serves every k."""
    hits = recall.cut_at(document_hits(spark, sf_dir, 10), [1, 3, 5, 10])
    flags = recall.question_recall(hits, test_set(spark, sf_dir), ["top_k"], measure="verbatim",
                                   concat=False)
    return recall.rollup(flags, ["top_k"])


@once
def test_set_by_content(spark, sf_dir) -> DataFrame:
    """Every benchmark item with the files of all documents that hold its text."""
    items = questions(spark, sf_dir).withColumn("gold_answer", F.col("question"))
    return recall.with_reference_files(items, table(spark, sf_dir, "documents").select("text", "source"))


TEST_SET_BY_CONTENT = """ts AS (SELECT item_id AS query_id, b.text AS gold,
    coalesce(list(DISTINCT d.source) FILTER (WHERE d.source <> ''), []) AS refs
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id, b.text)"""


def content_flags_sql(name: str, lists: str, hits: str, keys: str) -> str:
    """As flags_sql, for every question of ``lists`` and any of its files."""
    return f"""{name} AS (SELECT {keys}, n_ref_files, hit_rank, file_rank, (hit_rank > 0)::INTEGER AS single,
    (file_rank > 0)::INTEGER AS "file", (hit_rank > 0)::INTEGER AS merged
  FROM (SELECT {keys}, len(any_value(refs))::INTEGER AS n_ref_files,
          coalesce(min(CASE WHEN contains(d.text, gold) THEN rank END), 0)::INTEGER AS hit_rank,
          coalesce(min(CASE WHEN len(list_filter(refs, lambda x: contains(d.source, x) OR contains(x, d.source))) > 0
            AND d.source <> '' THEN rank END), 0)::INTEGER AS file_rank
        FROM {lists} LEFT JOIN {hits} h USING ({keys}) LEFT JOIN documents d ON d.doc_id = h.chunk_id GROUP BY {keys}))"""


def content_recall(spark, sf_dir, ks: list[int]) -> DataFrame:
    """Flags for every item and k; one without a hit or without a file counts as a miss."""
    hits = recall.cut_at(document_hits(spark, sf_dir, max(ks)), ks)
    tests = test_set_by_content(spark, sf_dir)
    runs = spark.createDataFrame([(k,) for k in ks], "top_k int")
    flags = recall.question_recall(hits, tests, ["top_k"], measure="verbatim", concat=False, runs=runs)
    return flags.join(tests.select("query_id", F.size("ref_files").alias("n_ref_files")), "query_id")


@query("recall_per_question_by_content", f"""WITH {MODEL}, {sparse_sql(5)}, {TEST_SET_BY_CONTENT},
{content_flags_sql('r', 'ts', 'sparse', 'query_id')}
SELECT query_id, n_ref_files, hit_rank, file_rank, single, "file", merged FROM r""")
def recall_per_question_by_content(spark, sf_dir):
    return content_recall(spark, sf_dir, [5]).drop("top_k")


@query("recall_rollup_by_content", f"""WITH {MODEL}, {sparse_sql(10)}, {TEST_SET_BY_CONTENT},
ks AS (SELECT ts.*, top_k FROM ts, (SELECT unnest([1, 3, 5, 10])::INTEGER AS top_k)),
cut AS (SELECT query_id, chunk_id, rank, top_k FROM sparse, (SELECT unnest([1, 3, 5, 10])::INTEGER AS top_k) WHERE rank <= top_k),
{content_flags_sql('r', 'ks', 'cut', 'top_k, query_id')}
{rates_sql('r', 'top_k')}""")
def recall_rollup_by_content(spark, sf_dir):
    return recall.rollup(content_recall(spark, sf_dir, [1, 3, 5, 10]), ["top_k"])


def window_chunks(spark, sf_dir, size: int = 1100) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("section_text"))
    # A number is cheaper to group by than a string; no document has 2^20 windows.
    return chunkers.char_windows(docs, size).withColumn(
        "chunk_id", F.shiftleft("doc_id", 20) + F.col("ord"))


def blocks_sql(pairs: str) -> str:
    """CTEs ending in ``covered``: pid and the share of ``a`` in matching blocks with ``b``, for ``pairs`` (pid, a, b, junk).

    Equal characters lie on diagonals; a run on one is a common block. The longest run inside a
    range is taken, the first by row and column, and the ranges left and right of it go on.
    """
    island = "SELECT pid, d, min(i) AS s, max(i) AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY pid, d ORDER BY i) AS g FROM {}) GROUP BY pid, d, g"
    return f"""ca AS (SELECT pid, generate_subscripts(string_split(a, ''), 1) - 1 AS i, unnest(string_split(a, '')) AS ch FROM {pairs} WHERE a <> ''),
cb AS (SELECT pid, generate_subscripts(string_split(b, ''), 1) - 1 AS j, unnest(string_split(b, '')) AS ch FROM {pairs} WHERE b <> ''),
pop AS (SELECT pid, ch FROM cb JOIN {pairs} USING (pid) WHERE junk AND length(b) >= 200
        GROUP BY pid, ch, b HAVING count(*) > length(b) // 100 + 1),
eq AS (SELECT pid, i - j AS d, i, pop.ch IS NULL AS seed FROM ca JOIN cb USING (pid, ch) LEFT JOIN pop USING (pid, ch)),
er AS ({island.format('eq')}), sr AS ({island.format('(FROM eq WHERE seed)')}),
x AS (SELECT er.pid, er.d, er.s AS es, er.e AS ee, sr.s, sr.e FROM er JOIN sr ON sr.pid = er.pid AND sr.d = er.d AND sr.s BETWEEN er.s AND er.e
      UNION ALL SELECT pid, d, s, e, NULL, NULL FROM er SEMI JOIN pop USING (pid)),
rec AS (SELECT pid, false AS done, 0::BIGINT AS a0, length(a)::BIGINT AS a1, 0::BIGINT AS b0, length(b)::BIGINT AS b1, d, s, e, es, ee
        FROM x JOIN {pairs} USING (pid)
  UNION ALL
  SELECT pid, w.done, w.a0, w.a1, w.b0, w.b1, d, CASE WHEN s IS NOT NULL THEN greatest(s, w.a0, w.b0 + d) END,
         CASE WHEN s IS NOT NULL THEN least(e, w.a1 - 1, w.b1 - 1 + d) END, es, ee FROM (
    SELECT pid, d, s, e, es, ee, unnest([
             {{'done': true, 'use': place = 1, 'a0': t.l, 'a1': t.h + 1, 'b0': t.l - t.d, 'b1': t.h + 1 - t.d}},
             {{'done': false, 'use': true, 'a0': a0, 'a1': t.l, 'b0': b0, 'b1': t.l - t.d}},
             {{'done': false, 'use': true, 'a0': t.h + 1, 'a1': a1, 'b0': t.h + 1 - t.d, 'b1': b1}}]) AS w
    FROM (SELECT *, first_value({{'d': d, 'l': greatest(es, a0, b0 + d), 'h': least(ee, a1 - 1, b1 - 1 + d), 'size': size}}) OVER o AS t, row_number() OVER o AS place
          FROM (SELECT *, CASE WHEN s IS NOT NULL THEN e - s + 1 WHEN d = a0 - b0 AND a0 BETWEEN es AND ee THEN 0 ELSE -1 END AS size FROM rec WHERE NOT done)
          WINDOW o AS (PARTITION BY pid, a0, a1, b0, b1 ORDER BY size DESC, coalesce(s, a0), coalesce(s, a0) - d))
    WHERE t.size >= 0)
  WHERE w.use AND (w.done OR (w.a0 < w.a1 AND w.b0 < w.b1
                              AND greatest(coalesce(s, es), w.a0, w.b0 + d) <= least(coalesce(e, ee), w.a1 - 1, w.b1 - 1 + d)))),
covered AS (SELECT p.pid, coalesce(sum(a1 - a0) FILTER (done), 0) / greatest(length(any_value(a)), 1) AS coverage
            FROM {pairs} p LEFT JOIN rec USING (pid) GROUP BY p.pid)"""


WINDOW_MODEL = MODEL.replace("doc_id AS chunk_id", "(doc_id << 20) + ord AS chunk_id").replace(
    tokens_sql("text"), tokens_sql("index_text")).replace("FROM documents)", "FROM wc)", 1)
_ALNUM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query("recall_coverage", f"""WITH RECURSIVE wc AS ({window_sql(1100, 0)}), {WINDOW_MODEL}, {sparse_sql(5)}, {TEST_SET},
h AS (SELECT query_id, rank, gold, ref, source, {_ALNUM.format('gold')} AS a, {_ALNUM.format('index_text')} AS b
      FROM sparse JOIN wc ON sparse.chunk_id = (wc.doc_id << 20) + wc.ord JOIN documents d ON d.doc_id = wc.doc_id JOIN ts USING (query_id)),
pr AS (SELECT row_number() OVER () AS pid, * FROM (
  SELECT query_id, rank, a, b, true AS junk FROM h
  UNION ALL SELECT query_id, 0, any_value(a), string_agg(b, '' ORDER BY rank), false FROM h GROUP BY query_id)),
{blocks_sql('pr')},
ok AS (SELECT query_id, rank, coverage >= 0.7 AS ok FROM pr JOIN covered USING (pid)),
f AS (SELECT query_id, coalesce(min(rank) FILTER (contains(source, ref) OR contains(ref, source)), 0)::INTEGER AS file_rank FROM h GROUP BY query_id)
SELECT 'bm25' AS pipeline, 5::INTEGER AS top_k, query_id, coalesce(min(rank) FILTER (ok AND rank > 0), 0)::INTEGER AS hit_rank,
       any_value(file_rank) AS file_rank, bool_or(ok AND rank > 0)::INTEGER AS single, (any_value(file_rank) > 0)::INTEGER AS "file",
       bool_or(ok AND rank > 0)::INTEGER AS merged, bool_or(ok AND rank = 0)::INTEGER AS concat
FROM ok JOIN f USING (query_id) GROUP BY query_id""")
def recall_coverage(spark, sf_dir):
    """All four recall flags by matching blocks, on retrieved chunks."""
    chunks = window_chunks(spark, sf_dir)
    hits = bm25.sparse_topk(bm25.fit(chunks), questions(spark, sf_dir), 5)
    full = search.with_payload(hits, chunks, questions(spark, sf_dir)).withColumn("pipeline", F.lit("bm25")).withColumn(
        "top_k", F.lit(5))
    return recall.question_recall(full, test_set(spark, sf_dir), charset="alnum")


@query("coverage_bound", f"""WITH {MODEL}, {sparse_sql(5)},
t AS (SELECT query_id, chunk_id, regexp_replace(lower(b.text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS a,
        regexp_replace(lower(d.text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS h
      FROM sparse JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
na AS (SELECT query_id, chunk_id, ch, count(*) AS n FROM (
  SELECT query_id, chunk_id, unnest(string_split(a, '')) AS ch FROM t WHERE a <> '') GROUP BY ALL),
nh AS (SELECT query_id, chunk_id, ch, count(*) AS m FROM (
  SELECT query_id, chunk_id, unnest(string_split(h, '')) AS ch FROM t WHERE h <> '') GROUP BY ALL)
SELECT query_id, chunk_id, round(sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n), 6) AS bound
FROM na LEFT JOIN nh USING (query_id, chunk_id, ch) GROUP BY ALL""")
def coverage_bound(spark, sf_dir):
    """The share of gold characters that a text could cover at most."""
    hits = document_hits(spark, sf_dir, 5).join(
        broadcast_if_small(questions(spark, sf_dir)), "query_id")
    asked = keep_charset(F.col("question"), "alnum")
    found = keep_charset(F.col("content_text"), "alnum")
    chars = F.array_distinct(F.split(asked, ""))
    pairs = hits.select("query_id", "chunk_id", asked.alias("a"), found.alias("h"),
                        F.explode(F.filter(chars, lambda c: c != "")).alias("ch"))

    def times(text):
        return F.length(text) - F.length(F.replace(F.col(text), F.col("ch"), F.lit("")))

    return pairs.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.least(times("a"), times("h"))) / F.sum(times("a")), 6).alias("bound"))


@query("multi_query_vs_direct", f"""WITH {MQ_ROUTES}, {TEST_SET},
mqh AS ({fused_sql_ranked('1.0::DOUBLE / (60 + rank)', 'sum')}),
both_groups AS (SELECT 'MQ' AS grp, query_id, rank, chunk_id FROM mqh
                UNION ALL SELECT 'direct', query_id, rank, chunk_id FROM routes WHERE route = 0),
{flags_sql('r', 'both_groups', 'grp, query_id')}, rates AS ({rates_sql('r', 'grp')})
SELECT 'whole' AS chunker, 5 AS top_k, a.single_rate AS "MQ_single_rate", a.merged_rate AS "MQ_merged_rate",
  a.file_rate AS "MQ_file_rate", a.avg_hit_rank AS "MQ_avg_hit_rank", b.single_rate AS direct_single_rate,
  b.merged_rate AS direct_merged_rate, b.file_rate AS direct_file_rate, b.avg_hit_rank AS direct_avg_hit_rank,
  round(a.single_rate - b.single_rate, 6) AS single_rate_delta, round(a.file_rate - b.file_rate, 6) AS file_rate_delta
FROM rates a, rates b WHERE a.grp = 'MQ' AND b.grp = 'direct'""")
def multi_query_vs_direct(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    index = search.Index(chunks, bm25.fit(chunks))
    asked = questions(spark, sf_dir)
    groups = {"MQ": search.multi_query(index, asked, half_rewrites(spark, sf_dir), "bm25", 5),
              "direct": search.retrieve(index, asked, "bm25", 5)}
    hits = None
    for group, found in groups.items():
        part = found.select(F.lit(group).alias("group"), F.lit("whole").alias("chunker"),
                            F.lit(5).alias("top_k"), "query_id", "chunk_id", "rank")
        hits = part if hits is None else hits.unionByName(part)
    full = search.with_payload(hits, chunks, asked, 2 * 5)
    run = ["chunker", "top_k", "group"]
    flags = recall.question_recall(full, test_set(spark, sf_dir), run, measure="verbatim", concat=False)
    return recall.group_delta(recall.rollup(flags, run))


ARM_CHARS = 600


def study_arms(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    """Chunks of the four arms: split by section or not, with metadata or not. ``of`` (``doc_id``) names the only documents wanted."""
    docs = documents_with_headings(spark, sf_dir)
    if of is not None:
        docs = docs.join(of, "doc_id", "left_semi")
    split = sections.detect_sections(docs).withColumn("section_mode", F.lit("presplit"))
    raw = sections.whole_document(docs).withColumn("section_mode", F.lit("raw"))
    chunks = chunkers.char_windows(split.unionByName(raw), ARM_CHARS)
    chunks = chunks.withColumns({
        "file_type": F.col("lang"), "section_summary": F.lit(""), "file_summary": F.col("source")})
    # Both texts of a chunk come from one row, so that sections are detected once.
    meta = enrich.inject_metadata(chunks.withColumn("_pure", F.col("index_text")))
    both = F.array(*[F.struct(F.lit(m).alias("with_meta"), F.col(c).alias("index_text")) for m, c in ((False, "_pure"), (True, "index_text"))])
    arms = meta.withColumn("_arm", F.explode(both)).drop("index_text", "_pure").select("*", "_arm.*").drop("_arm")
    return arms.withColumn("chunk_id", F.concat_ws(
        "#", "section_mode", F.col("with_meta").cast("string"), "doc_id", "section_idx", "ord"))


@query("effect_decomposition", f"""WITH {DOCS_MD}, {SECTIONS},
se2 AS (SELECT 'presplit' AS section_mode, doc_id, section_idx::INTEGER AS section_idx, title, section_text
        FROM se WHERE length(section_text) >= 50
        UNION ALL SELECT 'raw', doc_id, 0, '正文', trim(text, chr(10) || chr(9) || chr(13) || ' ') FROM md),
ch AS (SELECT section_mode, doc_id, section_idx, title, (s / {ARM_CHARS})::INTEGER AS ord,
         substr(section_text, s::BIGINT + 1, {ARM_CHARS}) AS content
  FROM (SELECT *, unnest(generate_series(0, length(section_text) - 1, {ARM_CHARS})) AS s FROM se2)),
arms AS (
  SELECT section_mode, false AS with_meta, doc_id, section_idx, ord, content, content AS txt FROM ch
  UNION ALL SELECT section_mode, true, c.doc_id, section_idx, ord, content,
    '文件类型：' || lang || '；章节：' || title || '；文件摘要：' || source || chr(10) || content
  FROM ch c JOIN documents d USING (doc_id)),
ct AS (SELECT section_mode, with_meta, content,
         section_mode || '#' || with_meta || '#' || doc_id || '#' || section_idx || '#' || ord AS chunk_id,
         {tokens_sql('txt')} AS tokens FROM arms),
st AS (SELECT section_mode, with_meta, count(*) AS n, sum(len(tokens))::DOUBLE / count(*) AS avgdl FROM ct GROUP BY ALL),
tf AS (SELECT section_mode, with_meta, chunk_id, dl, token, count(*) AS tf FROM (
  SELECT section_mode, with_meta, chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM ct) GROUP BY ALL),
df AS (SELECT section_mode, with_meta, token, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT query_id, token, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM benchmark) GROUP BY ALL),
scored AS (SELECT section_mode, with_meta, query_id, chunk_id,
         round(sum(qtf * (1 + ln(greatest(qtf, 1))) * ln((n - df + 0.5) / (df + 0.5) + 1)
               * tf / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score
  FROM q JOIN tf USING (token) JOIN df USING (section_mode, with_meta, token)
  JOIN st USING (section_mode, with_meta) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY section_mode, with_meta, query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored QUALIFY rank <= 5),
fl AS (SELECT section_mode, with_meta, query_id, max(contains(content, b.text)::INTEGER) AS single
  FROM top JOIN ct USING (section_mode, with_meta, chunk_id) JOIN benchmark b ON b.item_id = query_id GROUP BY ALL),
c AS (SELECT avg(single) FILTER (section_mode = 'presplit' AND with_meta) * 100 AS pm,
        avg(single) FILTER (section_mode = 'presplit' AND NOT with_meta) * 100 AS pp,
        avg(single) FILTER (section_mode = 'raw' AND with_meta) * 100 AS rm,
        avg(single) FILTER (section_mode = 'raw' AND NOT with_meta) * 100 AS rp FROM fl)
SELECT round(pm, 6) AS presplit_meta, round(pp, 6) AS presplit_pure, round(rm, 6) AS raw_meta, round(rp, 6) AS raw_pure,
  round(rm - pm, 6) AS split_effect_meta, round(rp - pp, 6) AS split_effect_pure,
  round(pm - pp, 6) AS meta_effect_presplit, round(rm - rp, 6) AS meta_effect_raw FROM c""")
def effect_decomposition(spark, sf_dir):
    """The 2x2 study in one plan: four indexes are fitted and searched side by side."""
    arm = ["section_mode", "with_meta"]
    chunks = study_arms(spark, sf_dir)
    asked = questions(spark, sf_dir)
    hits = staged(bm25.sparse_topk(bm25.fit(chunks, by=arm), asked, 5), "study-hits").drop(*arm)
    # Only documents with a hit are cut again; there are at most as many as hits.
    cut = hits.select(F.split("chunk_id", "#")[2].cast(chunks.schema["doc_id"].dataType).alias("doc_id")).distinct()
    cut = F.broadcast(cut) if is_small(asked, BROADCAST_MAX_ROWS // (4 * 5)) else cut
    full = search.with_payload(hits, study_arms(spark, sf_dir, cut), asked, 4 * 5)
    flags = recall.question_recall(full, test_set(spark, sf_dir), arm, measure="verbatim", concat=False)
    return recall.effects(flags)


# --- scoring ------------------------------------------------------------------


def reasons(spark, sf_dir) -> DataFrame:
    """Grading reasons written from the values of each event: one event is one run."""
    v = F.col("value")

    def verdict(hit):
        return F.when(hit, "得分").otherwise("0分")

    text = F.concat(
        F.lit("[必答]1: "), verdict(v > 10), F.lit("\n[必答]2: "), verdict(v > 20),
        F.when(F.col("event_type") != "view", F.concat(F.lit("\n[选答]3: "), verdict(v > 30)))
        .otherwise(""),
        F.when(F.col("event_type") == "click", F.lit("\n[参考文件]4: 10分 得分")).otherwise(
            F.concat(F.lit("\n[参考文件]4: "), verdict(v < 60))),
        F.repeat(F.lit("\n(surplus)"), F.floor(v / 10).cast("int")),
        F.when(v > 90, F.lit("\n[冲突点]")).otherwise(""))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("strategy"), F.col("user_id").alias("query_id"),
        F.col("event_id").alias("run"), text.alias("reason"))


REASONS = """rs AS (SELECT event_id, event_type AS strategy, user_id AS query_id, event_id AS run,
  '[必答]1: ' || CASE WHEN value > 10 THEN '得分' ELSE '0分' END || chr(10) || '[必答]2: '
  || CASE WHEN value > 20 THEN '得分' ELSE '0分' END
  || CASE WHEN event_type <> 'view' THEN chr(10) || '[选答]3: ' || CASE WHEN value > 30 THEN '得分' ELSE '0分' END ELSE '' END
  || CASE WHEN event_type = 'click' THEN chr(10) || '[参考文件]4: 10分 得分'
          ELSE chr(10) || '[参考文件]4: ' || CASE WHEN value < 60 THEN '得分' ELSE '0分' END END
  || repeat(chr(10) || '(surplus)', floor(value / 10)::BIGINT)
  || CASE WHEN value > 90 THEN chr(10) || '[冲突点]' ELSE '' END AS reason FROM events),
vd AS (SELECT *, regexp_extract_all(reason, '\\[必答\\](\\d+):.*?(得分|0分)', 2) AS rq,
         regexp_extract_all(reason, '\\[选答\\](\\d+):.*?(得分|0分)', 2) AS op,
         regexp_extract_all(reason, '\\[参考文件\\](\\d+):.*?(得分|0分)', 2) AS rf,
         (length(reason) - length(replace(reason, '(surplus)', ''))) // 9 AS extra FROM rs),
ls AS (SELECT *, CASE WHEN len(rq) = 0 THEN 0 ELSE 70.0::DOUBLE / len(rq) * len(list_filter(rq, lambda x: x = '0分')) END AS lq,
         CASE WHEN len(op) = 0 THEN 0 ELSE 20.0::DOUBLE / len(op) * len(list_filter(op, lambda x: x = '0分')) END AS lo,
         CASE WHEN len(rf) = 0 THEN 0 ELSE 10.0::DOUBLE / len(rf) * len(list_filter(rf, lambda x: x = '0分')) END AS lf FROM vd),
graded AS (SELECT event_id, strategy, query_id, run,
  CASE WHEN contains(reason, '[冲突点]') THEN 0 ELSE round(greatest(100 - (lq + lo + lf) - least(extra * 5, 30), 0), 2) END::DOUBLE AS total,
  CASE WHEN len(rq) = 0 THEN 0 ELSE round(70 - lq, 2) END::DOUBLE AS required,
  CASE WHEN len(op) = 0 THEN 0 ELSE round(20 - lo, 2) END::DOUBLE AS optional,
  CASE WHEN len(rf) = 0 THEN 0 ELSE round(10 - lf, 2) END::DOUBLE AS reference FROM ls)"""


@query("score_compute", f"WITH {REASONS} SELECT event_id, total, required, optional, reference FROM graded")
def score_compute(spark, sf_dir):
    return scores.score_reasons(reasons(spark, sf_dir)).select(
        "event_id", "total", "required", "optional", "reference")


@query("score_rollup", f"""WITH {REASONS},
b AS (SELECT strategy, query_id, max(total) AS best, sum(total) AS s, count(total) AS n FROM graded GROUP BY ALL)
SELECT strategy, round(avg(best), 6) AS best_avg, round(sum(s) / sum(n), 6) AS all_avg, count(*) AS n_questions
FROM b GROUP BY strategy""")
def score_rollup(spark, sf_dir):
    return scores.score_rollup(scores.score_reasons(reasons(spark, sf_dir)))


@query("score_breakdown", f"""WITH {REASONS}
SELECT strategy, round(avg(required), 6) AS mean_required, round(avg(optional), 6) AS mean_optional,
  round(avg(reference), 6) AS mean_reference FROM graded WHERE strategy IN ('click', 'purchase') GROUP BY strategy""")
def score_breakdown(spark, sf_dir):
    graded = scores.score_reasons(reasons(spark, sf_dir))
    return compare.score_breakdown(graded, "click", "purchase")


@query("score_reply_parse", f"WITH {REASONS} SELECT event_id, reason FROM rs")
def score_reply_parse(spark, sf_dir):
    """Reasons read back from model replies: JSON lists, Python literals for one strategy, and for others
    the JSON between code fences or behind some words."""
    from ..functions.scoring import REASON_KEY, score_reason

    src = reasons(spark, sf_dir)
    items = F.split("reason", "\n")
    as_json = F.to_json(F.struct(items.alias(REASON_KEY), F.lit(50).alias("总分")))
    as_literal = F.concat(F.lit("{'" + REASON_KEY + "': ['"), F.array_join(items, "', '"), F.lit("']}"))
    fenced = F.concat(F.lit("```json\n"), as_json, F.lit("\n```"))
    reply = (F.when(F.col("strategy") == "error", as_literal).when(F.col("strategy") == "purchase", fenced)
             .when(F.col("strategy") == "click", F.concat(F.lit("My grades: "), as_json)).otherwise(as_json))
    return src.select("event_id", reply.alias("reply")).select(
        "event_id", score_reason(F.col("reply")).alias("reason"))


@query("answers_to_grade", """SELECT event_id AS run, event_type AS strategy, user_id AS query_id FROM events e
WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id)""")
def answers_to_grade(spark, sf_dir):
    """Runs with an answer and no earlier grade."""
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run"), F.col("event_type").alias("strategy"),
        F.col("user_id").alias("query_id"),
        F.when(F.col("value") > 0, F.col("props")).otherwise("  ").alias("answer"))
    before = runs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run")), "run", "left_semi")
    return scores.to_grade(runs, before).select("run", "strategy", "query_id")


# --- comparison ---------------------------------------------------------------


def strategy_results(spark, sf_dir) -> DataFrame:
    """Best score, recall flag and hit position per question of both strategies."""
    out = None
    for name, params in STRATEGIES.items():
        hits = document_hits(spark, sf_dir, 5, **params).withColumn("strategy", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    flags = recall.question_recall(out, test_set(spark, sf_dir), ["strategy"], measure="verbatim",
                                   concat=False, with_score=True)
    return flags.select("query_id", "strategy", F.col("top_score").alias("score"),
                        F.col("single").alias("recall"), "hit_rank")


RESULTS = f"""{MODEL}, {sparse_sql(5, 'sa')}, {sparse_sql(5, 'sb', b=0.0)}, {TEST_SET},
both_s AS (SELECT 'default' AS strategy, * FROM sa UNION ALL SELECT 'no_length_norm', * FROM sb),
{flags_sql('r', 'both_s', 'strategy, query_id')},
res AS (SELECT r.strategy, r.query_id, single, hit_rank, m.score FROM r
  JOIN (SELECT strategy, query_id, max(score) AS score FROM both_s GROUP BY ALL) m USING (strategy, query_id)),
pr AS (SELECT query_id, coalesce(max(score) FILTER (strategy = 'default'), 0) AS score_a,
  coalesce(max(score) FILTER (strategy = 'no_length_norm'), 0) AS score_b,
  coalesce(max(single) FILTER (strategy = 'default'), 0) AS recall_a,
  coalesce(max(single) FILTER (strategy = 'no_length_norm'), 0) AS recall_b,
  coalesce(max(hit_rank) FILTER (strategy = 'default'), 0) AS rank_a,
  coalesce(max(hit_rank) FILTER (strategy = 'no_length_norm'), 0) AS rank_b FROM res GROUP BY query_id)"""


def pairs(spark, sf_dir) -> DataFrame:
    return compare.side_by_side(strategy_results(spark, sf_dir), *STRATEGIES)


@query("compare_win_draw_lose", f"""WITH {RESULTS}
SELECT count(*) FILTER (score_a > score_b) AS a_wins,
  round(coalesce(avg(score_a - score_b) FILTER (score_a > score_b), 0), 6) AS a_mean_lead,
  count(*) FILTER (score_a = score_b) AS draws, count(*) FILTER (score_a < score_b) AS b_wins,
  round(coalesce(avg(score_b - score_a) FILTER (score_a < score_b), 0), 6) AS b_mean_lead FROM pr""")
def compare_win_draw_lose(spark, sf_dir):
    return compare.win_draw_lose(pairs(spark, sf_dir))


@query("compare_diff", f"WITH {RESULTS} SELECT *, round(score_a - score_b, 6) AS diff FROM pr")
def compare_diff(spark, sf_dir):
    return compare.score_diff(pairs(spark, sf_dir))


@query("compare_recall_cross", f"""WITH {RESULTS},
c AS (SELECT CASE WHEN recall_a > 0 AND recall_b > 0 THEN '双召' WHEN recall_a > 0 THEN 'A独召'
                  WHEN recall_b > 0 THEN 'B独召' ELSE '双失' END AS bucket, score_a, score_b FROM pr)
SELECT l.bucket, count(score_a) AS n, coalesce(round(avg(score_a), 6), 0) AS mean_a,
  coalesce(round(avg(score_b), 6), 0) AS mean_b
FROM (SELECT unnest(['双召', 'A独召', 'B独召', '双失']) AS bucket) l LEFT JOIN c USING (bucket) GROUP BY l.bucket""")
def compare_recall_cross(spark, sf_dir):
    return compare.recall_cross(pairs(spark, sf_dir))


@query("compare_top_divergence", f"""WITH {RESULTS}
SELECT *, round(score_a - score_b, 6) AS diff FROM pr ORDER BY abs(diff) DESC, query_id LIMIT 5""")
def compare_top_divergence(spark, sf_dir):
    return compare.top_divergence(pairs(spark, sf_dir), 5)


# --- reports ------------------------------------------------------------------

REPORT_KS = (1, 3, 5)


def report_flags(spark, sf_dir) -> DataFrame:
    out = None
    for name, params in STRATEGIES.items():
        hits = recall.cut_at(document_hits(spark, sf_dir, max(REPORT_KS), **params), REPORT_KS)
        hits = hits.withColumn("pipeline", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    return recall.question_recall(out, test_set(spark, sf_dir), measure="verbatim", concat=False)


REPORT = f"""{MODEL}, {sparse_sql(5, 'sa')}, {sparse_sql(5, 'sb', b=0.0)}, {TEST_SET},
both_s AS (SELECT 'default' AS pipeline, * FROM sa UNION ALL SELECT 'no_length_norm', * FROM sb),
cut AS (SELECT b.*, top_k FROM both_s b, (SELECT unnest([1, 3, 5])::INTEGER AS top_k) WHERE rank <= top_k),
{flags_sql('r', 'cut', 'pipeline, top_k, query_id')},
rates AS ({rates_sql('r', 'pipeline, top_k')})"""


@query("ranking_report", f"""WITH {REPORT}
SELECT *, row_number() OVER (PARTITION BY top_k ORDER BY single_rate DESC, pipeline)::INTEGER AS place FROM rates""")
def ranking_report(spark, sf_dir):
    rates = recall.rollup(report_flags(spark, sf_dir))
    return reports.ranking(rates, "single_rate", "pipeline", ["top_k"])


@query("topk_matrix", f"""WITH {REPORT}, w AS (SELECT pipeline,
  {', '.join(f'max({m}) FILTER (top_k = {k}) AS {m}_top{k}' for m in ('single_rate', 'merged_rate', 'file_rate', 'avg_hit_rank') for k in REPORT_KS)}
  FROM rates GROUP BY pipeline)
SELECT *, row_number() OVER (ORDER BY single_rate_top1 DESC, pipeline)::INTEGER AS place FROM w""")
def topk_matrix(spark, sf_dir):
    return reports.topk_matrix(recall.rollup(report_flags(spark, sf_dir)), REPORT_KS)


GRID = f"""{REPORT}, grid AS (SELECT query_id, {', '.join(
    f"max({c}) FILTER (pipeline = '{p}') AS {p}_{c}" for p in STRATEGIES
    for c in ('single', 'hit_rank', 'merged', '"file"')).replace('_"file"', '_file')}
  FROM r WHERE top_k = 5 GROUP BY query_id)"""


@query("result_grid", f"WITH {GRID} SELECT * FROM grid")
def result_grid(spark, sf_dir):
    flags = report_flags(spark, sf_dir).where("top_k = 5")
    return reports.result_grid(flags, list(STRATEGIES))


@query("sheet_to_long", f"""WITH {GRID}
SELECT query_id, 'default' AS strategy, default_hit_rank::VARCHAR AS hit_rank, default_merged::VARCHAR AS merged,
  default_file::VARCHAR AS "file", default_single::VARCHAR AS recall FROM grid
UNION ALL SELECT query_id, 'no_length_norm', no_length_norm_hit_rank::VARCHAR, no_length_norm_merged::VARCHAR,
  no_length_norm_file::VARCHAR, no_length_norm_single::VARCHAR FROM grid""")
def sheet_to_long(spark, sf_dir):
    """The wide sheet under its exported headers, read back as rows."""
    flags = report_flags(spark, sf_dir).where("top_k = 5")
    sheet = reports.result_grid(flags, list(STRATEGIES))
    suffix = {"single": "_召回", "hit_rank": "_召回位置", "merged": "_合并召回", "file": "_文件召回"}
    sheet = sheet.withColumnsRenamed({f"{p}_{c}": f"{p}{s}" for p in STRATEGIES for c, s in suffix.items()})
    return reports.sheet_to_long(sheet, ["query_id"])


@query("cost_report", """SELECT event_type AS task, count(*) AS calls, round(sum(value), 6) AS cost
FROM events GROUP BY event_type""")
def cost_report(spark, sf_dir):
    ledger = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("task"), F.col("value").alias("cost"))
    return reports.cost_report(ledger)
