"""Multi-query experiment: rewrites of every question against the question alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RecallConfig
from ..functions.models import Model
from ..operators import enrich, recall, search
from . import build, experiment

# --- fixed values -----------------------------------------------------------
GROUPS = ("MQ", "direct")
# ----------------------------------------------------------------------------


def make_rewrites(questions: DataFrame, model: Model) -> DataFrame:
    """``query_id, route, question``: up to three rewrites per question, routes from 1."""
    prompt = F.concat(F.lit("Rewrite the question in 3 different ways with the same meaning, one per "
                            "line and without numbering.\nQuestion: "), F.col("question"))
    lines = enrich.rewrite_lines(F.coalesce(model(prompt), F.lit("")))
    return questions.select("query_id", F.posexplode(lines).alias("_pos", "question")).select(
        "query_id", (F.col("_pos") + 1).alias("route"), "question")


def run_multi_query(cfg: RecallConfig, test_set: DataFrame, rewrites: DataFrame, setup: build.Build,
                    docs: DataFrame | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """Both groups over all chunkers and k: ``recall``, ``rates`` and their ``cross`` table.

    ``rewrites`` are made once, stored, and serve every chunker.
    """
    pipelines = experiment.expand(cfg)
    experiment.ensure_built(cfg, pipelines, docs, setup)
    # Embedded once, whatever the number of searches.
    asked = experiment.keep("questions", experiment.embedded(test_set.select("query_id", "question"), setup), out, ())
    more = experiment.keep("rewrites", experiment.embedded(rewrites, setup), out, ())
    hits = None
    for pipe in pipelines:
        index = setup.store.open(build.index_key(cfg.kb, pipe["chunker"], cfg.section_mode,
                                                 cfg.with_meta), setup.tokenizer)
        for k in cfg.top_k_values:
            found = {"MQ": search.multi_query(index, asked, more, pipe["retriever"], k, key="content_text"),
                     "direct": search.retrieve(index, asked, pipe["retriever"], k)}
            for group in GROUPS:
                part = search.with_payload(found[group], index.chunks, asked, k).select(
                    F.lit(pipe["chunker"]).alias("chunker"), F.lit(k).alias("top_k"),
                    F.lit(group).alias("group"), "query_id", "rank", "chunk_id", "score",
                    "content_text", "source")
                hits = part if hits is None else hits.unionByName(part)
    run = ["chunker", "top_k", "group"]
    runs = test_set.sparkSession.createDataFrame(
        [(p["chunker"], k, g) for p in pipelines for k in cfg.top_k_values for g in GROUPS],
        "chunker string, top_k int, group string")

    def keep(name, df):
        return experiment.keep(name, df, out, ("chunker", "top_k"))

    hits = keep("hits", hits)
    flags = keep("recall", recall.question_recall(hits, test_set, run, cfg.threshold, cfg.charset, runs=runs))
    rates = keep("rates", recall.rollup(flags, run))
    return {"hits": hits, "recall": flags, "rates": rates, "cross": keep("cross", recall.group_delta(rates))}
