"""Search functions for an application: what exists, and hits for questions."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from .. import config
from ..functions.embedding import Embedder
from ..functions.text import Tokenizer, word_tokens
from ..operators import search
from ..sources.index_store import IndexStore
from . import build


class SearchService:
    """Answers batches of questions from stored indexes."""

    def __init__(self, spark: SparkSession, store: IndexStore, tokenizer: Tokenizer = word_tokens,
                 embed: Embedder | None = None):
        self.spark, self.store, self.tokenizer, self.embed = spark, store, tokenizer, embed

    def knowledge_bases(self) -> list[str]:
        return self.store.knowledge_bases()

    def strategies(self, kb: str) -> list[str]:
        return self.store.strategies(kb)

    def search(self, questions: list[str], kb: str = config.DEFAULT_KB, chunker: str = "fixed_1100",
               retriever: str = "hybrid", top_k: int = 2 * config.TOP_K,
               section_mode: str = "presplit") -> dict:
        """Hits per question with the time spent. Blank questions are refused."""
        from pyspark.sql import functions as F

        if not questions or any(not q.strip() for q in questions):
            raise ValueError("the question is blank")
        start = time.perf_counter()
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")
        if self.embed is not None:
            asked = asked.withColumn("embedding", self.embed(F.col("question")))
        index = self.store.open(build.index_key(kb, chunker, section_mode), self.tokenizer)
        # At most top_k rows for each question of the caller's list.
        rows = search.search(index, asked, retriever, top_k).orderBy("query_id", "rank").collect()
        return {"results": [r.asDict() for r in rows],
                "elapsed_ms": round((time.perf_counter() - start) * 1000)}
