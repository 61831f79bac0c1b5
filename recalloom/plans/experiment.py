"""Experiments: one dimension varies, all pipelines are evaluated on the same questions."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import FullConfig, RecallConfig
from ..functions.models import Model
from ..functions.scoring import rerank_score
from ..operators import generation, recall, scores, search
from ..scale import broadcast_if_small, written
from ..session import checkpoint_dir
from ..sources.index_store import IndexStore
from . import build

VARIABLES = ("chunker", "retriever", "reranker")


def expand(cfg: RecallConfig) -> list[dict]:
    """One pipeline per value of the varied dimension."""
    if cfg.variable not in VARIABLES:
        raise ValueError(f"variable must be one of {', '.join(VARIABLES)}")
    fixed = {v: getattr(cfg, v) for v in VARIABLES}
    return [{**fixed, cfg.variable: value, "label": value} for value in cfg.values]


def missing_indexes(cfg: RecallConfig, pipelines: list[dict], store: IndexStore) -> list[dict]:
    """Needed and not there, each once."""
    needed = {json.dumps(k, sort_keys=True): k for k in (
        build.index_key(cfg.kb, p["chunker"], cfg.section_mode, cfg.with_meta) for p in pipelines)}
    return [k for k in needed.values() if not store.has(k)]


def ensure_built(cfg: RecallConfig, pipelines: list[dict], docs: DataFrame | None, setup: build.Build) -> None:
    """Build only what is missing; without documents a missing index is an error."""
    for key in missing_indexes(cfg, pipelines, setup.store):
        if docs is None:
            raise LookupError(f"no index {key} and no documents to build it from")
        build.build_index(docs, key, setup)


def rerank(hits: DataFrame, questions: DataFrame, name: str, model: Model | None = None,
           scorer: Callable | None = None, top_n: int = config.RERANK_TOP_N) -> DataFrame:
    """Apply a named reranker to full hits; a cross-encoder keeps ``top_n`` of them."""
    if name == "direct":
        return hits
    asked = hits.join(broadcast_if_small(questions.select("query_id", "question")), "query_id")
    if name == "llm_rerank":
        if model is None:
            raise ValueError("llm_rerank needs a model")
        prompt = F.concat(F.lit("Rate from 0 to 10 how relevant the text is to the query. Reply with "
                                "one number only.\nQuery: "), F.col("question"),
                          F.lit("\n\nText:\n"), F.col("content_text"))
        return search.relevance_order(asked, rerank_score(model(prompt))).drop(
            "question", "old_rank", "rerank_score")
    if name == "bge_reranker":
        score = (scorer or search.overlap_score)(F.col("question"), F.col("content_text"))
        return search.relevance_order(asked, score, top_n).drop(
            "question", "old_rank", "rerank_score")
    raise ValueError(f"unknown reranker {name!r}")


def embedded(questions: DataFrame, setup: build.Build) -> DataFrame:
    """Questions as a search takes them; embeddings that are there already are kept."""
    have = [c for c in questions.columns if c in ("query_id", "route", "question", "embedding")]
    asked = questions.select(*have)
    if setup.embed is None or "embedding" in have:
        return asked
    return asked.withColumn("embedding", setup.embed(F.col("question")))


def pipeline_hits(pipe: dict, cfg: RecallConfig, questions: DataFrame, setup: build.Build,
                  ks: list[int], model: Model | None = None, scorer=None) -> DataFrame:
    """Full hits of one pipeline at every k: ``pipeline, top_k, query_id, rank, ...``.

    A vector or keyword list is searched once at the largest k and cut. The candidates of a
    fused list depend on k, so it is searched per k.
    """
    key = build.index_key(cfg.kb, pipe["chunker"], cfg.section_mode, cfg.with_meta)
    index = setup.store.open(key, setup.tokenizer)
    asked = embedded(questions, setup)
    if pipe["retriever"] in ("vector", "bm25"):
        listed = recall.cut_at(search.retrieve(index, asked, pipe["retriever"], max(ks)), ks)
    else:
        listed = None
        for k in ks:
            part = search.retrieve(index, asked, pipe["retriever"], k).withColumn("top_k", F.lit(k))
            listed = part if listed is None else listed.unionByName(part)
    full = search.with_payload(listed, index.chunks, asked, sum(ks)).withColumn(
        "pipeline", F.lit(pipe["label"]))
    if pipe["reranker"] == "direct":
        return full
    by_k = full.withColumn("query_id", F.struct("query_id", "top_k"))
    by_q = questions.select(F.explode(F.array(*[F.struct("query_id", F.lit(k).alias("top_k"))
                                                for k in ks])).alias("query_id"), "question")
    # A list holds k hits: recall at k is measured on all of them.
    done = rerank(by_k.drop("top_k"), by_q, pipe["reranker"], model, scorer, max(config.RERANK_TOP_N, *ks))
    return done.withColumn("top_k", F.col("query_id.top_k")).withColumn(
        "query_id", F.col("query_id.query_id"))


RUN = ("pipeline", "top_k")


def keep(name: str, df: DataFrame, out: str | None, by=RUN) -> DataFrame:
    """Go on from a written table below ``out``, or else from a checkpoint."""
    if out is not None:
        return written(df, f"{out}/{name}", by)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def run_recall(cfg: RecallConfig, test_set: DataFrame, setup: build.Build, docs: DataFrame | None = None,
               model: Model | None = None, scorer=None, out: str | None = None) -> dict[str, DataFrame]:
    """A recall experiment: ``hits, recall, rates``, long over pipelines and k.

    Each table is written below ``out``, or checkpointed without it, and the next one made
    from it, so that the search runs once.
    """
    pipelines = expand(cfg)
    ensure_built(cfg, pipelines, docs, setup)
    # Embedded once, whatever the number of searches.
    asked = keep("questions", embedded(test_set, setup), out, ())
    hits = None
    for pipe in pipelines:
        part = pipeline_hits(pipe, cfg, asked, setup, cfg.top_k_values, model, scorer)
        hits = part if hits is None else hits.unionByName(part, allowMissingColumns=True)
    runs = test_set.sparkSession.createDataFrame(
        [(p["label"], k) for p in pipelines for k in cfg.top_k_values], "pipeline string, top_k int")
    hits = keep("hits", hits, out)
    flags = keep("recall", recall.question_recall(
        hits, test_set, threshold=cfg.threshold, charset=cfg.charset, runs=runs), out)
    return {"hits": hits, "recall": flags, "rates": keep("rates", recall.rollup(flags), out)}


def run_full(cfg: FullConfig, test_set: DataFrame, setup: build.Build, answer_model: Model,
             score_model: Model, docs: DataFrame | None = None, graded: DataFrame | None = None,
             rerank_model: Model | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """Retrieve, answer, measure recall and grade. ``runs`` answers every question that often."""
    cfg.top_k_values = [cfg.top_k]
    report = run_recall(cfg, test_set, setup, docs, rerank_model, out=out)
    cells = F.explode(F.array(*[F.struct(F.lit(p["label"]).alias("pipeline"), F.lit(i).alias("run"))
                                for p in expand(cfg) for i in range(1, cfg.runs + 1)])).alias("_c")
    grid = test_set.select("query_id", cells).select("query_id", "_c.*")
    answers = generation.fill_unanswered(generation.generate_answers(
        test_set, report["hits"], answer_model, runs=cfg.runs), grid).withColumnRenamed(
        "pipeline", "strategy")
    answers = keep("answers", answers, out, ("strategy",))
    todo = answers.join(test_set.drop("gold_answer"), "query_id")
    graded_now = keep("scores", scores.grade(todo, score_model, graded), out, ("strategy",))
    ranking = keep("ranking", scores.score_rollup(graded_now), out, ())
    return {**report, "answers": answers, "scores": graded_now, "ranking": ranking}


def save_config(cfg: RecallConfig, out: str) -> str:
    """Write the settings beside the results."""
    os.makedirs(out, exist_ok=True)
    path = os.path.join(out, "config.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(cfg), f, ensure_ascii=False, indent=2)
    return path
