"""The corpus pipeline: each stage is one operator, written as Parquet and read by the next.

Documents without a recognised language and toxic ones go, then exact and near copies; what is
left is packed into sequences. Every stage but the last returns the columns of documents. It has
no SQL: three of its stages can't be said in it. Tests hold it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recalloom.llm import exact_dedup, jaccard_join, langid, toxicity
from recalloom.llm.common import fresh_name, ready, stored
from recalloom.llm.queries import language_model, packed_documents, toxicity_machine
from recalloom.llm.ragged import CACHED_WORDS

ORACLE_SQL = None

# A document goes from this score on.
TOXIC = 0.5


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; those that switch language stay, however small the largest share.

    A model that has learned no language rejects nothing.
    """
    model = language_model(docs)
    if not langid.Model.unpack(model).labels:
        return docs
    copy, lang, share = (fresh_name(docs.columns, c) for c in ("_copy", "_language", "_share"))
    found = langid.identify(docs.withColumn(copy, F.col("text")), model, copy, lang, share)
    return found.where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above ``TOXIC`` go."""
    copy, score = (fresh_name(docs.columns, c) for c in ("_copy", "_score"))
    scored = toxicity.score(docs.withColumn(copy, F.col("text")), toxicity_machine(spark, docs, sf_dir), copy, score)
    return scored.where(F.col(score) < TOXIC).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.kept_rows(docs, exact_dedup.run_index(spark))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of at most 2048 tokens; one row per piece."""
    # After the join the executors' JVMs are at their full size, so workers hold fewer words; that costs time alone.
    return packed_documents(docs, CACHED_WORDS)


STAGES = [
    ("language_id", language_id_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
