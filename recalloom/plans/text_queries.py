"""Queries on cleaning, sections, chunking and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (clean_markdown, file_match, normalise_file_ref, salvage_json, strip)
from ..operators import chunkers, enrich, prepare, sections
from .catalog import query, table

HEADING_LINE_CHARS = 30


def pages_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with links, headings and paragraphs written as Markdown."""
    t = F.col("html")
    for pattern, to in (
        (r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""),
        (r'<a href="([^"]*)">([^<]*)</a>', r"[$2]($1)"),
        (r"<h1[^>]*>", "\n# "),
        (r"</?(h1|p|div|li|ul|nav|article|br)[^>]*>", "\n\n"),
        (r"<[^>]+>", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    return table(spark, sf_dir, "pages").select("page_id", "url", t.alias("text"))


PAGES_MD = r"""md AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),
    '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g'),
    '<h1[^>]*>', chr(10) || '# ', 'g'),
    '</?(h1|p|div|li|ul|nav|article|br)[^>]*>', chr(10) || chr(10), 'g'),
    '<[^>]+>', '', 'g') AS text FROM pages)"""


def documents_with_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with every short line written as a heading of level 1 to 3."""
    def mark(line: Column) -> Column:
        n = F.length(line)
        head = F.concat(F.repeat(F.lit("#"), 1 + n % 3), F.lit(" "), line)
        return F.when(n.between(1, HEADING_LINE_CHARS), head).otherwise(line)

    text = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.alias("text"))


DOCS_MD = """md AS (
  SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)),
    lambda l: CASE WHEN length(l) BETWEEN 1 AND 30
                   THEN repeat('#', 1 + length(l) % 3) || ' ' || l ELSE l END), chr(10)) AS text
  FROM documents)"""

SECTIONS = r"""ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
hd AS (
  SELECT *, regexp_matches(line, '^#{1,6}\s+.+$') AS is_head,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS pos
  FROM ln),
sc AS (
  SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s,
         sum(is_head::INT) OVER (PARTITION BY doc_id) AS heads FROM hd),
se AS (
  SELECT doc_id, CASE WHEN heads <= 1 THEN 0 ELSE s - 1 END AS section_idx,
         CASE WHEN heads <= 1 THEN '正文'
              ELSE trim(regexp_replace(arg_min(line, i), '^#+\s+', '')) END AS title,
         CASE WHEN heads <= 1 THEN 1
              ELSE length(regexp_extract(arg_min(line, i), '^#+')) END AS level,
         min(pos) AS "start", trim(string_agg(line, chr(10) ORDER BY i), chr(10) || chr(9) || chr(13) || ' ') AS section_text,
         max(pos + length(line)) + CASE WHEN max(i) = max(last_i) THEN 0 ELSE 1 END AS "end"
  FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last_i FROM sc)
  WHERE heads <= 1 OR s > 0
  GROUP BY doc_id, heads, CASE WHEN heads <= 1 THEN 0 ELSE s - 1 END,
           CASE WHEN heads <= 1 THEN 0 ELSE s END)"""


@query("clean_markup", f"""WITH {PAGES_MD}
SELECT page_id, regexp_replace(regexp_replace(text, '!\\[.*?\\]\\(.*?\\)', '', 'g'),
                               '\\[.*?\\]\\(.*?\\)', '', 'g') AS cleaned,
       length(text)::INTEGER AS n_before FROM md""")
def clean_markup(spark, sf_dir):
    return pages_as_markdown(spark, sf_dir).select(
        "page_id", clean_markdown(F.col("text")).alias("cleaned"),
        F.length("text").alias("n_before"))


@query("sections_headed", f"""WITH {DOCS_MD}, {SECTIONS}
SELECT doc_id, section_idx::INTEGER AS section_idx, title, level::INTEGER AS level,
       "start"::INTEGER AS start_pos, "end"::INTEGER AS end_pos,
       length(section_text)::INTEGER AS n_chars
FROM se WHERE length(section_text) >= 50""")
def sections_headed(spark, sf_dir):
    docs = documents_with_headings(spark, sf_dir).select("doc_id", "text")
    return sections.detect_sections(docs).select(
        "doc_id", "section_idx", "title", "level", F.col("start").alias("start_pos"),
        F.col("end").alias("end_pos"), F.length("section_text").alias("n_chars"))


@query("sections_from_pages", f"""WITH {PAGES_MD}
SELECT page_id, '正文' AS title, 0::INTEGER AS section_idx,
       length(trim(text, chr(10) || chr(9) || chr(13) || ' '))::INTEGER AS n_chars
FROM md WHERE length(trim(text, chr(10) || chr(9) || chr(13) || ' ')) >= 50""")
def sections_from_pages(spark, sf_dir):
    """Pages have one heading each, so they exercise the single-section rule."""
    pages = pages_as_markdown(spark, sf_dir).select("page_id", "text")
    return sections.detect_sections(pages).select(
        "page_id", "title", "section_idx", F.length("section_text").alias("n_chars"))


def whole(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("section_text"))


def window_sql(size: int, overlap: int, text: str = "text", key: str = "doc_id",
               src: str = "documents") -> str:
    step = size - overlap
    return f"""SELECT {key}, (s / {step})::INTEGER AS ord,
       substr({text}, s::BIGINT + 1, {size}) AS index_text
FROM (SELECT {key}, {text}, unnest(generate_series(0, length({text}) - 1, {step})) AS s FROM {src})
WHERE s = 0 OR s + {overlap} < length({text})"""


@query("chunk_char_window", window_sql(1100, 0))
def chunk_char_window(spark, sf_dir):
    return chunkers.char_windows(whole(spark, sf_dir), 1100).select("doc_id", "ord", "index_text")


@query("chunk_char_window_overlap", window_sql(1500, 150))
def chunk_char_window_overlap(spark, sf_dir):
    return chunkers.char_windows(whole(spark, sf_dir), 1500, 150).select(
        "doc_id", "ord", "index_text")


def token_sql(size: int, overlap: int) -> str:
    return f"""SELECT doc_id, (s / {size - overlap})::INTEGER AS ord,
       array_to_string(list_slice(ts, s + 1, s + {size}), '') AS index_text
FROM (SELECT doc_id, ts, unnest(generate_series(0, len(ts) - 1, {size - overlap})) AS s
      FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+[ \\t\\n\\r]*') AS ts FROM documents))
WHERE s = 0 OR s + {overlap} < len(ts)"""


@query("chunk_token_window", token_sql(1024, 0))
def chunk_token_window(spark, sf_dir):
    return chunkers.token_windows(whole(spark, sf_dir), 1024).select("doc_id", "ord", "index_text")


@query("chunk_token_window_overlap", token_sql(1536, 150))
def chunk_token_window_overlap(spark, sf_dir):
    return chunkers.token_windows(whole(spark, sf_dir), 1536, 150).select(
        "doc_id", "ord", "index_text")


@query("chunk_paragraph", f"""WITH {PAGES_MD}, parts AS (
  SELECT page_id, trim(p, chr(10) || chr(9) || chr(13) || ' ') AS p, i
  FROM (SELECT page_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p,
               generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) AS i FROM md))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS paragraph_idx,
       p AS content_text
FROM parts WHERE p <> ''""")
def chunk_paragraph(spark, sf_dir):
    pages = pages_as_markdown(spark, sf_dir).select("page_id", "text")
    return chunkers.paragraphs(pages, "text").select("page_id", "paragraph_idx", "content_text")


@query("chunk_parent_child", f"""WITH p AS (
  SELECT doc_id, ord AS parent_idx, index_text AS content_text FROM ({window_sql(1100, 150)}))
SELECT doc_id, parent_idx, content_text, (s / 150)::INTEGER AS ord,
       substr(content_text, s::BIGINT + 1, 150) AS index_text
FROM (SELECT *, unnest(generate_series(0, length(content_text) - 1, 150)) AS s FROM p)""")
def chunk_parent_child(spark, sf_dir):
    return chunkers.parent_child(
        whole(spark, sf_dir), lambda c: chunkers.char_window_array(c, 1100, 150),
        lambda c: chunkers.char_window_array(c, 150)).select(
        "doc_id", "parent_idx", "content_text", "ord", "index_text")


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return chunkers.recursive(whole(spark, sf_dir), 1100, 150).select("doc_id", "ord", "index_text")


@query("chunk_recursive_parent_child")
def chunk_recursive_parent_child(spark, sf_dir):
    return chunkers.recursive_parent_child(whole(spark, sf_dir)).select(
        "doc_id", "parent_idx", "content_text", "ord", "index_text")


@query("chunk_header_chain", f"""WITH {DOCS_MD}, ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
hd AS (
  SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.+$')
                 THEN length(regexp_extract(line, '^#+')) END AS level FROM ln),
w AS (
  SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS s,
    max(CASE WHEN level = 1 THEN i END) OVER u AS i1,
    max(CASE WHEN level <= 2 THEN i END) OVER u AS i2,
    max(CASE WHEN level <= 3 THEN i END) OVER u AS i3,
    max(CASE WHEN level <= 4 THEN i END) OVER u AS i4,
    max(CASE WHEN level <= 5 THEN i END) OVER u AS i5,
    max(CASE WHEN level <= 6 THEN i END) OVER u AS i6
  FROM hd WINDOW u AS (PARTITION BY doc_id ORDER BY i)),
h AS (
  SELECT w.*, list_distinct(list_filter([i1, i2, i3, i4, i5, i6], lambda x: x IS NOT NULL)) AS ids FROM w
  WHERE level IS NOT NULL)
SELECT h.doc_id, h.s::INTEGER AS section_idx,
       string_agg(regexp_extract(x.line, '^#+') || ' ' || trim(regexp_replace(x.line, '^#+\\s+', '')),
                  ' > ' ORDER BY x.i) AS chain
FROM h JOIN hd x ON x.doc_id = h.doc_id AND list_contains(h.ids, x.i)
GROUP BY h.doc_id, h.s""")
def chunk_header_chain(spark, sf_dir):
    docs = documents_with_headings(spark, sf_dir).select("doc_id", "text")
    headed = sections.header_sections(docs).where(F.size("headers") > 0)
    return headed.select("doc_id", F.col("section_idx").cast("int").alias("section_idx"),
                         chunkers.header_prefix(F.col("headers")).alias("chain"))


@query("chunk_header_chain_all", f"""WITH {DOCS_MD}, ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
hd AS (
  SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.+$')
                 THEN length(regexp_extract(line, '^#+')) END AS level FROM ln),
w AS (
  SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS s,
    max(CASE WHEN level = 1 THEN i END) OVER u AS i1,
    max(CASE WHEN level <= 2 THEN i END) OVER u AS i2,
    max(CASE WHEN level <= 3 THEN i END) OVER u AS i3,
    max(CASE WHEN level <= 4 THEN i END) OVER u AS i4,
    max(CASE WHEN level <= 5 THEN i END) OVER u AS i5,
    max(CASE WHEN level <= 6 THEN i END) OVER u AS i6
  FROM hd WINDOW u AS (PARTITION BY doc_id ORDER BY i)),
h AS (
  SELECT w.*, list_distinct(list_filter([i1, i2, i3, i4, i5, i6], lambda x: x IS NOT NULL)) AS ids FROM w
  WHERE level IS NOT NULL)
SELECT h.doc_id, h.s::INTEGER AS section_idx,
       string_agg(regexp_extract(x.line, '^#+') || ' ' || trim(regexp_replace(x.line, '^#+\\s+', '')),
                  ' > ' ORDER BY x.i) AS chain
FROM h JOIN hd x ON x.doc_id = h.doc_id AND list_contains(h.ids, x.i)
GROUP BY h.doc_id, h.s
UNION ALL
SELECT doc_id, 0::INTEGER AS section_idx, '' AS chain FROM w WHERE s = 0 GROUP BY doc_id
HAVING trim(string_agg(line, chr(10) ORDER BY i), chr(10) || chr(9) || chr(13) || ' ') <> ''""")
def chunk_header_chain_all(spark, sf_dir):
    """Every section: documents without a heading and text before the first one have an empty chain."""
    docs = documents_with_headings(spark, sf_dir).select("doc_id", "text")
    return sections.header_sections(docs).select(
        "doc_id", F.col("section_idx").cast("int").alias("section_idx"),
        chunkers.header_prefix(F.col("headers")).alias("chain"))


@query("chunk_header_aware")
def chunk_header_aware(spark, sf_dir):
    docs = documents_with_headings(spark, sf_dir).select("doc_id", "text")
    return chunkers.header_aware(sections.header_sections(docs)).select(
        "doc_id", "section_idx", "ord", "index_text")


@query("chunk_stats", "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS chunker, count(*) AS n_chunks, sum(length(index_text))::BIGINT AS sum_chars,
       min(length(index_text))::INTEGER AS min_chars, max(length(index_text))::INTEGER AS max_chars
FROM ({sql})""" for name, sql in (
        ("window_1100", window_sql(1100, 0)), ("window_1100_ovl150", window_sql(1100, 150)),
        ("window_1500", window_sql(1500, 0)), ("window_1500_ovl150", window_sql(1500, 150)),
        ("token_1024", token_sql(1024, 0)), ("token_1024_ovl100", token_sql(1024, 100)))))
def chunk_stats(spark, sf_dir):
    """All arrays of one document are built in one pass over the table."""
    text = F.col("section_text")
    tokens = F.regexp_extract_all(text, F.lit(chunkers.BLANK_TOKEN), F.lit(0))
    arms = {"window_1100": chunkers.char_window_array(text, 1100),
            "window_1100_ovl150": chunkers.char_window_array(text, 1100, 150),
            "window_1500": chunkers.char_window_array(text, 1500),
            "window_1500_ovl150": chunkers.char_window_array(text, 1500, 150),
            "token_1024": chunkers.token_window_array(tokens, 1024),
            "token_1024_ovl100": chunkers.token_window_array(tokens, 1024, 100)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("chunker"), a.alias("chunks"))
                               for n, a in arms.items()])).alias("arm")
    chunks = whole(spark, sf_dir).select(each).select(
        "arm.chunker", F.explode("arm.chunks").alias("index_text"))
    return chunkers.chunk_lengths(chunks, ["chunker"])


@query("inject_metadata", """SELECT doc_id,
  concat_ws('；', '文件类型：' || lang, '章节：正文',
            CASE WHEN lang = 'en' THEN '章节摘要：' || substr(text, 1, 80) END,
            CASE WHEN source <> '' THEN '文件摘要：' || source END) || chr(10) || text AS index_text
FROM documents""")
def inject_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("file_type"), F.col("source").alias("file_summary"),
        F.lit("正文").alias("title"),
        F.when(F.col("lang") == "en", F.substring("text", 1, 80)).otherwise("")
        .alias("section_summary"), F.col("text").alias("index_text"))
    return enrich.inject_metadata(docs).select("doc_id", "index_text")


@query("attach_metadata", """SELECT d.doc_id, w.ord, coalesce(f.file_type, '') AS file_type,
  coalesce(f.file_summary, '') AS file_summary, coalesce(s.section_summary, '') AS section_summary
FROM documents d
JOIN (SELECT doc_id, unnest(generate_series(0, (length(text) - 1) // 1100))::INTEGER AS ord FROM documents
      WHERE length(text) > 0) w USING (doc_id)
LEFT JOIN (SELECT doc_id, 'quality ' || quality AS file_type, 'toxic ' || toxic AS file_summary
           FROM labels) f USING (doc_id)
LEFT JOIN (SELECT conv_id AS doc_id, substr(text, 1, 80) AS section_summary FROM conversations
           WHERE turn = 0) s USING (doc_id)""")
def attach_metadata(spark, sf_dir):
    chunks = chunkers.char_windows(whole(spark, sf_dir).withColumn("section_idx", F.lit(0)), 1100)
    file_meta = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("file_type"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("file_summary"))
    section_meta = table(spark, sf_dir, "conversations").where("turn = 0").select(
        F.col("conv_id").alias("doc_id"), F.lit(0).alias("section_idx"),
        F.substring("text", 1, 80).alias("section_summary"))
    return enrich.attach_metadata(chunks, file_meta, section_meta, "doc_id").select(
        "doc_id", "ord", "file_type", "file_summary", "section_summary")


# A text of any length and language as 32 hex digits, for want of a model that reads it.
@query("inject_metadata_whole", """SELECT doc_id,
  concat_ws('；', '文件类型：' || lang, '章节：正文', '章节摘要：' || md5(text),
            CASE WHEN source <> '' THEN '文件摘要：' || source END) || chr(10) || text AS index_text
FROM documents""")
def inject_metadata_whole(spark, sf_dir):
    """The digest of the whole text, in every language, as section summary."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("file_type"), F.col("source").alias("file_summary"),
        F.lit("正文").alias("title"), F.md5(F.col("text").cast("binary")).alias("section_summary"),
        F.col("text").alias("index_text"))
    return enrich.inject_metadata(docs).select("doc_id", "index_text")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """``doc_id, section_idx, section_summary``: all turns of each conversation and their whole texts.

    The summary is the count of the turns and the sum of their digests, so partial aggregation
    leaves one row per task and conversation, however many turns it has.
    """
    turn = F.concat_ws("|", F.col("turn").cast("string"), "role", "text")
    number = F.conv(F.substring(F.md5(turn.cast("binary")), 1, 15), 16, 10).cast("decimal(28,0)")
    return turns.groupBy(F.col("conv_id").alias("doc_id"), F.lit(0).alias("section_idx")).agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" turns "),
                 F.sum(number).cast("string")).alias("section_summary"))


@query("attach_metadata_turns", """SELECT d.doc_id, w.ord, coalesce(f.file_type, '') AS file_type,
  coalesce(f.file_summary, '') AS file_summary, coalesce(s.section_summary, '') AS section_summary
FROM documents d
JOIN (SELECT doc_id, unnest(generate_series(0, (length(text) - 1) // 1100))::INTEGER AS ord FROM documents
      WHERE length(text) > 0) w USING (doc_id)
LEFT JOIN (SELECT doc_id, 'quality ' || quality AS file_type, 'toxic ' || toxic AS file_summary
           FROM labels) f USING (doc_id)
LEFT JOIN (SELECT conv_id AS doc_id, count(*) || ' turns ' ||
             sum(('0x' || substr(md5(concat_ws('|', turn::VARCHAR, role, text)), 1, 15))::BIGINT) AS section_summary
           FROM conversations GROUP BY conv_id) s USING (doc_id)""")
def attach_metadata_turns(spark, sf_dir):
    """As attach_metadata, with a digest over all turns of the conversation and their whole texts."""
    chunks = chunkers.char_windows(whole(spark, sf_dir).withColumn("section_idx", F.lit(0)), 1100)
    file_meta = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("file_type"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("file_summary"))
    section_meta = conversation_digests(table(spark, sf_dir, "conversations"))
    return enrich.attach_metadata(chunks, file_meta, section_meta, "doc_id").select(
        "doc_id", "ord", "file_type", "file_summary", "section_summary")


@query("summary_windows", """SELECT doc_id, i::INTEGER AS window_idx,
  CASE WHEN length(text) > 3000 THEN substr(text, i * 2000 + 1, 2000) ELSE text END AS window_text
FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) > 3000
        THEN generate_series(0, (length(text) - 1) // 2000) ELSE [0::BIGINT] END) AS i FROM documents)""")
def summary_windows(spark, sf_dir):
    return enrich.summary_windows(whole(spark, sf_dir)).select("doc_id", "window_idx", "window_text")


@query("merge_pages", """SELECT conv_id, string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS text,
  count(*) AS n_pages FROM conversations GROUP BY conv_id""")
def merge_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return sections.merge_pages(turns, "conv_id", "turn").select("conv_id", "text", "n_pages")


@query("cache_misses", """SELECT doc_id, source FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")
def cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return enrich.cache_misses(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query("json_salvage", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
  ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events""")
def json_salvage(spark, sf_dir):
    """Replies in four shapes: plain, fenced, with chatter around, and broken."""
    props = F.col("props")
    reply = (F.when(F.col("event_type") == "view", props)
             .when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
             .when(F.col("event_type") == "error", F.regexp_replace(props, ":", ""))
             .otherwise(F.concat(F.lit("reply: "), props, F.lit(" end"))))
    return table(spark, sf_dir, "events").select(
        "event_id", salvage_json(reply, "k bigint")["k"].alias("k"))


@query("rewrite_lines", """SELECT conv_id, turn, list_slice(list_filter(list_transform(
  string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 4), 1, 3) AS rewrites
FROM conversations""")
def rewrite_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", enrich.rewrite_lines(F.col("text")).alias("rewrites"))


@query("file_ref_match", """WITH n AS (
  SELECT page_id, regexp_extract(url, '([^/?#]+)(\\?|#|$)', 1) || '.md' AS ref,
         regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages)
SELECT page_id, regexp_replace(ref, '\\.(pdf|md|docx?)$', '') AS ref_norm,
       (regexp_replace(ref, '\\.(pdf|md|docx?)$', '') <> '' AND
        contains(regexp_replace(url, '\\.(pdf|md|docx?)$', ''),
                 regexp_replace(ref, '\\.(pdf|md|docx?)$', ''))) AS in_url,
       (regexp_replace(ref, '\\.(pdf|md|docx?)$', '') <> '' AND host <> '' AND
        (contains(host, regexp_replace(ref, '\\.(pdf|md|docx?)$', '')) OR
         contains(regexp_replace(ref, '\\.(pdf|md|docx?)$', ''), host))) AS in_host
FROM n""")
def file_ref_match(spark, sf_dir):
    url = F.col("url")
    ref = F.concat(F.lit(" "), F.regexp_extract(url, r"([^/?#]+)(\?|#|$)", 1), F.lit(".md "))
    norm = table(spark, sf_dir, "pages").select(
        "page_id", normalise_file_ref(ref).alias("r"), normalise_file_ref(url).alias("u"),
        normalise_file_ref(F.regexp_extract(url, "^https?://([^/]+)", 1)).alias("h"))
    return norm.select("page_id", F.col("r").alias("ref_norm"),
                       file_match(F.col("r"), F.col("u")).alias("in_url"),
                       file_match(F.col("r"), F.col("h")).alias("in_host"))


@query("points_validate", """WITH p AS (
  SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                                    lambda x: x <> '') AS pts FROM conversations),
v AS (SELECT *, len(pts) AS n FROM p WHERE len(pts) > 0)
SELECT conv_id, turn,
  list_transform(pts, lambda x, i: CASE WHEN starts_with(x, i::VARCHAR || '.') THEN x
                                        ELSE i::VARCHAR || '. ' || x END) AS points,
  list_filter([1, turn + 1, 99], lambda x: x <= n)::INTEGER[] AS required,
  list_filter(list_filter([0, 1, 2, 3], lambda x: x >= 1 AND x <= n),
              lambda x: x <> 1 AND x <> turn + 1)::INTEGER[] AS optional,
  [n]::INTEGER[] AS ref_idx
FROM v""")
def points_validate(spark, sf_dir):
    """Replies listing the lines of each turn as points, with stray and doubled references."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: strip(x)), lambda x: x != "")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(
        lines.alias("points"), F.array(F.lit(1), F.col("turn") + 1, F.lit(99)).alias("required"),
        F.array(*[F.lit(i) for i in (0, 1, 2, 3)]).alias("optional"),
        F.array(F.size(lines)).alias("ref_idx"))), F.lit("\n```"))
    parsed = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prepare.validate_points(prepare.parse_points(reply)).alias("p"))
    return parsed.where(F.col("p").isNotNull()).select("conv_id", "turn", "p.*")


@query("prepared_test_set", """WITH t AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT text AS question, answer AS gold_answer, '1. ' || length(answer) || '; 2. 参考依据：conv' || conv_id AS point,
       '1' AS required, '' AS optional, '2' AS reference
FROM t WHERE role = 'user' AND next_role = 'assistant'""")
def prepared_test_set(spark, sf_dir):
    """Question/answer rows enriched by a stand-in model that names one point per answer."""
    rows = qa_pairs(spark, sf_dir).select(
        F.col("question").alias("问题"), F.col("gold_answer").alias("标准答案"),
        F.concat(F.lit(" conv"), F.col("conv_id").cast("string")).alias("文件来源"))

    def model(prompt):
        answer = F.get_json_object(prompt, "$.answer")
        return F.concat(F.lit('{"points":["'), F.length(answer).cast("string"),
                        F.lit('"],"required":[1],"optional":[1,7],"ref_idx":[]}'))

    out = prepare.enrich_test_set(rows, model)
    return out.toDF("question", "gold_answer", "point", "required", "optional", "reference")


def qa_pairs(spark, sf_dir) -> DataFrame:
    """User turns followed by an assistant turn, as questions and gold answers."""
    turns = table(spark, sf_dir, "conversations")
    ask = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold_answer"))
    return ask.join(reply, ["conv_id", "turn"])


@query("qa_pairs_from_conversations", """SELECT conv_id, turn, text AS question, answer AS gold_answer FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def qa_pairs_from_conversations(spark, sf_dir):
    return qa_pairs(spark, sf_dir)
