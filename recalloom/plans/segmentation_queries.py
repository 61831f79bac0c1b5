"""Queries on dictionary segmentation: texts without blanks, cut by the words of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.segmentation import SCALE
from ..operators import bm25, segmentation
from .catalog import once, query, table
from .retrieval_queries import MODEL, weight_sql

LEAST = 2


def unspaced(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x20\x09-\x0D]+", "")


@once
def dictionary(spark, sf_dir):
    """The words of all documents, each where at least ``WORD_SHARE`` of the texts hold it."""
    return segmentation.fit(segmentation.word_counts(table(spark, sf_dir, "documents")))


@once
def turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as chunks."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), unspaced(F.col("text")).alias("index_text"))


def runs_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


WORDS = f"""counted AS (SELECT word, count(DISTINCT doc_id) AS texts, count(*) AS n
  FROM (SELECT doc_id, unnest({runs_sql("text")}) AS word FROM documents) GROUP BY word),
kept AS (SELECT * FROM counted WHERE texts >= {segmentation.WORD_SHARE} * (SELECT count(*) FROM documents)),
total AS (SELECT sum(n) AS total FROM kept),
words AS (SELECT word, texts, n, round(ln(n / total) * {SCALE})::BIGINT AS weight FROM kept, total)"""

# The likeliest path of every different run of the table ``asked (id, text)``, folded from its end backwards. The state of a
# run holds for every distance from the end the best weight and the first word; of equal weights the longest wins.
PATHS = f"""spelt AS (SELECT id, unnest({runs_sql(r"regexp_replace(text, '[ \x09-\x0D]+', '', 'g')")}) AS run,
    generate_subscripts({runs_sql(r"regexp_replace(text, '[ \x09-\x0D]+', '', 'g')")}, 1) AS place FROM asked),
runs AS (SELECT DISTINCT run, length(run) AS size FROM spelt),
places AS (SELECT run, size, unnest(range(1, size + 1)) AS spot FROM runs),
spans AS (SELECT run, size, spot, unnest(range(1, least(size - spot + 1, (SELECT max(length(word)) FROM words)) + 1)) AS len FROM places),
edges AS (SELECT run, size - spot + 1 AS distance, len, weight, true AS known FROM spans JOIN words ON word = run[spot:spot + len - 1]
  UNION ALL
  SELECT run, size - spot + 1, 1, (SELECT round(ln(1 / total) * {SCALE})::BIGINT FROM total), false FROM places
  WHERE run[spot] NOT IN (SELECT word FROM words)),
choices AS (SELECT run, distance, list({{'len': len, 'weight': weight, 'known': known}} ORDER BY len) AS options FROM edges GROUP BY ALL),
solved AS (SELECT run, list_reduce(list({{'best': []::BIGINT[], 'first': []::STRUCT(len BIGINT, weight BIGINT, known BOOLEAN)[], 'options': options}} ORDER BY distance),
    lambda s, o: {{'best': list_append(s.best, list_max(list_transform(o.options, lambda x: x.weight + s.best[len(s.best) - x.len + 1]))),
      'first': list_append(s.first, list_last(list_filter(o.options, lambda x: x.weight + s.best[len(s.best) - x.len + 1]
        = list_max(list_transform(o.options, lambda y: y.weight + s.best[len(s.best) - y.len + 1]))))), 'options': o.options}},
    {{'best': [0::BIGINT], 'first': []::STRUCT(len BIGINT, weight BIGINT, known BOOLEAN)[], 'options': []::STRUCT(len BIGINT, weight BIGINT, known BOOLEAN)[]}}).first AS first
  FROM choices GROUP BY run),
heads AS (SELECT run, unnest(first).len AS len, unnest(first).known AS known, generate_subscripts(first, 1) AS distance FROM solved),
trace AS (SELECT run, size, size AS distance FROM runs
  UNION ALL
  SELECT run, size, distance - len FROM trace JOIN heads USING (run, distance) WHERE distance > len),
steps AS (SELECT run, distance, run[size - distance + 1:size - distance + len] AS word, known FROM trace JOIN heads USING (run, distance)),
pieces AS (SELECT run, distance, word, sum(CASE WHEN known OR coalesce(prior, true) THEN 1 ELSE 0 END)
    OVER (PARTITION BY run ORDER BY distance DESC) AS piece
  FROM (SELECT *, lag(known) OVER (PARTITION BY run ORDER BY distance DESC) AS prior FROM steps)),
joined AS (SELECT run, piece, string_agg(word, '' ORDER BY distance DESC) AS word FROM pieces GROUP BY ALL),
cut AS (SELECT run, list(word ORDER BY piece) FILTER (length(word) >= {LEAST}) AS words FROM joined GROUP BY run),
tokens AS (SELECT id, flatten(list(coalesce(words, []) ORDER BY place) FILTER (words IS NOT NULL)) AS tokens
  FROM asked LEFT JOIN spelt USING (id) LEFT JOIN cut USING (run) GROUP BY id)"""


@query("dictionary_words", f"WITH {WORDS} SELECT word, texts, n, weight FROM words")
def dictionary_words(spark, sf_dir):
    return segmentation.word_counts(table(spark, sf_dir, "documents"))


@query("segment_unspaced", f"""WITH RECURSIVE {WORDS},
asked AS (SELECT concat_ws(':', conv_id, turn) AS id, text FROM conversations), {PATHS}
SELECT id AS chunk_id, len(coalesce(tokens, [])) AS n_tokens, md5(coalesce(array_to_string(tokens, ' '), '')) AS tokens_md5 FROM tokens""")
def segment_unspaced(spark, sf_dir):
    """Every conversation turn without its blanks, cut into words again."""
    cut = bm25.tokenise(turns(spark, sf_dir), tokenizer=segmentation.dictionary_tokenizer(dictionary(spark, sf_dir), LEAST))
    return cut.select("chunk_id", F.col("dl").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("search_segmented", f"""WITH RECURSIVE {WORDS},
asked AS (SELECT 't' || concat_ws(':', conv_id, turn) AS id, text FROM conversations
  UNION ALL SELECT 'q' || item_id, text FROM benchmark), {PATHS},
ct AS (SELECT id[2:] AS chunk_id, coalesce(tokens, []) AS tokens FROM tokens WHERE id[1] = 't'),
{MODEL[MODEL.index("st AS"):]},
terms AS (SELECT query_id, token, count(*) AS qtf FROM (
  SELECT id[2:]::BIGINT AS query_id, unnest(tokens) AS token FROM tokens WHERE id[1] = 'q') GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(sum(qtf * (1 + ln(greatest(qtf, 1))) * {weight_sql()}), 6) AS score
  FROM terms JOIN tf USING (token) JOIN voc USING (token), st GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
FROM scored QUALIFY rank <= {config.TOP_K}""")
def search_segmented(spark, sf_dir):
    """The five best conversation turns per benchmark question, both without blanks."""
    tokenizer = segmentation.dictionary_tokenizer(dictionary(spark, sf_dir), LEAST)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), unspaced(F.col("text")).alias("question"))
    hits = bm25.sparse_topk(bm25.fit(turns(spark, sf_dir), tokenizer=tokenizer), asked, config.TOP_K, tokenizer=tokenizer)
    return hits.select("query_id", "chunk_id", "score", "rank")
