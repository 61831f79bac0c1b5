"""Dictionary segmentation as Spark jobs: a dictionary counted over a corpus, and a tokenizer that cuts by it.

    words = segmentation.word_counts(docs)             # or read_dictionary(spark, path)
    tokenizer = segmentation.dictionary_tokenizer(segmentation.fit(words))
    index = bm25.fit(chunks, tokenizer=tokenizer)
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.segmentation import SCALE, Trie, segment_lists
from ..functions.text import WORD_BREAK, Tokenizer, let

# A dictionary holds the words of at least this share of the texts. A text holds a limited number of distinct words, so
# (mean distinct words per text / share) bounds the dictionary however many texts there are.
WORD_SHARE = 0.001
# What one task can hold of a dictionary, in characters of its words; a larger one is refused, never cut.
MAX_CHARS = 64_000_000


def runs(c: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WORD_BREAK), lambda r: r != "")


def word_counts(docs: DataFrame, text: str = "text", share: float = WORD_SHARE) -> DataFrame:
    """``word, texts, n, weight``: words of at least ``share`` of the texts, with how many texts and how often in all.

    ``weight`` is the logarithm of the word's part of all words counted here, in whole units of 1 / ``SCALE``. Words are
    counted inside each text before the shuffle, so a word found everywhere sends one row per partition.
    """
    marked = let(F.array_sort(runs(F.col(text))), lambda sorted_runs: F.transform(
        sorted_runs, lambda r, i: F.struct(r.alias("word"), F.when((i == 0) | (F.get(sorted_runs, i - 1) != r), 1).alias("first"))))
    # The outer explode keeps Spark from filtering on the array, which would cut every text a second time.
    counted = docs.select(F.explode_outer(marked).alias("_r")).where(F.col("_r").isNotNull()).groupBy(F.col("_r.word").alias("word")).agg(
        F.count("_r.first").alias("texts"), F.count(F.lit(1)).alias("n"))
    corpus = docs.agg(F.count(F.lit(1)).alias("_texts"))
    kept = counted.where(F.col("texts") >= F.lit(share) * corpus.scalar())
    total = kept.agg(F.sum("n")).scalar()
    return kept.withColumn("weight", word_weight(F.col("n"), total))


def word_weight(n: Column, total: Column) -> Column:
    return F.round(F.log(n / total) * SCALE).cast("long")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word, n`` of text files that hold a word, a blank, its count, and possibly more on a line.

    Lines without a count count 1; empty lines are left out; of a word on several lines the largest count holds.
    """
    cells = F.split(F.btrim(F.col("value")), r"\s+")
    return spark.read.text(path).select(cells.alias("_cells")).where(F.col("_cells")[0] != "").groupBy(
        F.lower(F.col("_cells")[0]).alias("word")).agg(
        F.max(F.coalesce(F.try_element_at("_cells", F.lit(2)).try_cast("long"), F.lit(1))).alias("n"))


def fit(words: DataFrame) -> Broadcast:
    """The trie of ``word, n`` rows, shared with all tasks once.

    Counts below one count as one and words without letters are left out. An empty dictionary is allowed: every run is
    then one piece. One character that is no word weighs as much as a word seen once.
    """
    sized = words.select(F.col("word"), F.greatest(F.coalesce(F.col("n"), F.lit(1)), F.lit(1)).cast("long").alias("n")).where(
        F.coalesce(F.col("word"), F.lit("")) != "").groupBy("word").agg(F.max("n").alias("n"))
    chars = sized.agg(F.sum(F.length("word"))).first()[0] or 0
    if chars > MAX_CHARS:
        raise ValueError(f"a dictionary of {chars} characters is above {MAX_CHARS}; raise the share of texts it is taken from")
    found = sized.collect()
    total = max(1, sum(r["n"] for r in found))
    weights = [round(math.log(r["n"] / total) * SCALE) for r in found]
    trie = Trie.build([r["word"] for r in found], weights, round(math.log(1 / total) * SCALE))
    return words.sparkSession.sparkContext.broadcast(trie)


def dictionary_tokenizer(dictionary: Broadcast, least: int = 2) -> Tokenizer:
    """Words of at least ``least`` characters on the likeliest path through each run of letters and digits.

    Null and empty texts give an empty list. What no word explains stays together as a token. Row-local, no shuffle.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(found: pa.Array) -> pa.Array:
        return segment_lists(found, dictionary.value, least)

    return lambda c: cut(runs(c))
