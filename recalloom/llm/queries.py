"""One query per operator over its whole table, and the SQL that states the result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, jaccard_join, langid, line_dedup, packing, toxicity, url_filter, warc
from .common import crc_mod, ready, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_exact_dedup", r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exact_dedup.deduplicate(docs, exact_dedup.run_index(spark))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


# The three replacements that end a line, hide and drop markup, as in line_dedup.
_DUCK_LINES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(coalesce(html, ''), '[\x20\x09-\x0D]+', ' ', 'g'),
    '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g'),
    '(?i)</?(p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|article|nav|aside|main|section|header|footer|title|head|body|html|form|blockquote|pre)\b[^>]*>', chr(10), 'g'),
    '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"""
_DUCK_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _counted(cut: DataFrame) -> DataFrame:
    """What is left of each page, as text, and how many lines it had and lost."""
    return cut.select(F.col("id").alias("page_id"), "host", F.size("lines").cast("bigint").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
                      F.array_join("kept", "\n").alias("text"))


@query("op2_line_dedup", f"""
WITH p AS (SELECT page_id, {_DUCK_HOST} AS host, {_DUCK_LINES} AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM p WHERE host <> '' GROUP BY host),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host <> '')
      GROUP BY host, line),
b AS (SELECT host, list(line) AS common FROM l JOIN t USING (host) WHERE n >= 2 AND n > 0.5 * pages GROUP BY host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines,
       (len(lines) - len(list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x))))::BIGINT AS n_dropped,
       array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)), chr(10)) AS text
FROM p LEFT JOIN b USING (host)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))
    return _counted(cut)


@query("op2_line_dedup_rotating", f"""
WITH p AS (SELECT page_id, {_DUCK_HOST} AS host, {_DUCK_LINES} AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM p WHERE host <> '' GROUP BY host),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host <> '')
      GROUP BY host, line),
b AS (SELECT host, list(line) AS common FROM l JOIN t USING (host) WHERE (n >= 2 AND n > 0.5 * pages) OR (n >= {line_dedup.ROTATING_PAGES} AND n > {line_dedup.ROTATING_RATIO}::DOUBLE * pages) GROUP BY host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines,
       (len(lines) - len(list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x))))::BIGINT AS n_dropped,
       array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)), chr(10)) AS text
FROM p LEFT JOIN b USING (host)""")
def op2_rotating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also lines on over a tenth of a site's pages, five at least: what rotates is on few of them."""
    pages = table(spark, sf_dir, "pages")
    return _counted(line_dedup.drop_boilerplate(pages, rotating_ratio=line_dedup.ROTATING_RATIO))


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query("op5_url_filter", f"""
WITH u AS (SELECT page_id, {_DUCK_HOST} AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                            ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT u.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC) AS place
      FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE place = 1""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).drop("url")


@query("op10_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
           ('0x' || substr(hexed, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path).where(F.col("kind") == "record")
    response = F.col("record_type") == "response"
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, warc.sha1_base32(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs, tokenizer).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))
    encoded = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = bpe.decode(encoded, tokenizer)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame, cached_words: int = packing.CACHED_WORDS) -> DataFrame:
    tokens = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=cached_words)
    pieces = packing.cut(tokens, 2048).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, 2048).drop("gap")


def toxicity_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> bytes:
    """Learned from labels of rows outside the held-out fold only."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.train(toxicity.sample(docs, labels, "toxic"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_machine(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def language_model(docs: DataFrame) -> bytes:
    """Learned from rows outside the held-out fold only."""
    return langid.train(langid.sample(docs.where(crc_mod("doc_id", 4) != 2)))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.drop("lang"), language_model(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


# No SQL: the sums of another engine differ in the last place of a double.
@query("op7_one_bit_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, codec = ann.build(table(spark, sf_dir, "embeddings"))
    return ann.search(index, codec, index.where(F.col("vec_id") % 50 == 0).select("vec_id", "vector"), 5)


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


from . import audit_queries  # noqa: E402, F401  (registers its queries here)
