"""Command line: python -m recalloom <command>."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import config
from .config import FullConfig, RecallConfig
from .functions.embedding import embedder
from .functions.models import chat_model
from .functions.text import TOKENIZERS
from .operators import compare, prepare, reports, scores, segmentation
from .plans import build, experiment, multi_query, registry
from .plans.service import SearchService
from .session import session
from .sources import demo, markdown, results, test_sets
from .sources.index_store import IndexStore


def _model(system: str | None = None):
    """The chat endpoint of the environment; None without one."""
    url = os.getenv("LLM_BASE_URL")
    if not url:
        return None
    fallbacks = [m for m in os.getenv("LLM_FALLBACK_MODELS", "").split(",") if m]
    return chat_model(url, os.getenv("LLM_MODEL", ""), os.getenv("LLM_API_KEY", ""), fallbacks,
                      system)


def _need_model():
    model = _model()
    if model is None:
        raise SystemExit("this command needs a model: set LLM_BASE_URL, LLM_MODEL and LLM_API_KEY")
    return model


def _setup(spark: SparkSession, args) -> build.Build:
    tokenizer = TOKENIZERS[args.tokenizer]
    if args.dictionary:
        tokenizer = segmentation.dictionary_tokenizer(segmentation.fit(segmentation.read_dictionary(spark, args.dictionary)))
    embed = embedder("hashing", tokenizer=tokenizer) if args.embedding == "hashing" else embedder(args.embedding)
    return build.Build(IndexStore(spark, args.store), tokenizer, embed, _model())


def _docs(spark: SparkSession, args):
    return markdown.read_markdown(spark, os.path.join(args.datasets, args.kb), args.kb)


def _list(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def _show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def cmd_strategies(spark, args):
    for name in registry.names(args.type):
        entry = registry.CHUNKERS.get(name)
        print(f"{name:28s} {entry.description if entry else registry.RERANKERS.get(name, '')}")


def cmd_demo(spark, args):
    demo.write_documents(os.path.join(args.datasets, args.kb))
    results.save_workbook({"test_set": demo.demo_questions(spark).drop("_row").coalesce(1)}, args.datasets)


def cmd_build(spark, args):
    setup, docs = _setup(spark, args), _docs(spark, args)
    if not args.pure:
        files, parts = build.stored_metadata(spark, docs, _need_model(), f"{args.store}/_metadata/{args.kb}")
        setup = build.Build(setup.store, setup.tokenizer, setup.embed, setup.model, files, parts)
    _show(build.build_all(docs, args.kb, setup, _list(args.chunker) or None, args.section_mode,
                          args.pure, args.force))


def cmd_search(spark, args):
    setup = _setup(spark, args)
    service = SearchService(spark, setup.store, setup.tokenizer, setup.embed)
    _show(service.search([args.query], args.kb, args.chunker, args.retriever, args.top_k, args.section_mode))


def _config(kind, args, **more):
    values = {"chunker": _list(args.chunkers), "retriever": _list(args.retrievers),
              "reranker": _list(args.rerankers)}[args.variable]
    return kind(name=args.name, kb=args.kb, variable=args.variable, values=values,
                chunker=(_list(args.chunkers) or ["fixed_1100"])[0], retriever=args.retriever,
                section_mode=args.section_mode, **more)


def cmd_recall(spark, args):
    ks = [int(k) for k in _list(args.top_k)]
    cfg, setup = _config(RecallConfig, args, top_k_values=ks), _setup(spark, args)
    tests = test_sets.read_test_set(spark, args.test_set)
    target = os.path.join(args.output, cfg.name)
    experiment.save_config(cfg, target)
    out = experiment.run_recall(cfg, tests, setup, _docs(spark, args), _model(), out=target)
    for k in ks:
        results.save_workbook(results.recall_sheets(out["recall"], out["rates"], tests, cfg.values, k),
                              f"{target}/top{k}")
    matrix = reports.topk_matrix(out["rates"], ks)
    print(results.html_report(matrix, cfg.name, f"{target}/report.html", [f"single_rate_top{min(ks)}"]))


def cmd_run(spark, args):
    model = _need_model()
    cfg = _config(FullConfig, args, top_k=int(args.top_k), score_mode=args.score_mode, runs=args.runs)
    tests = test_sets.read_test_set(spark, args.test_set)
    target = os.path.join(args.output, cfg.name)
    experiment.save_config(cfg, target)
    out = experiment.run_full(cfg, tests, _setup(spark, args), model, _model(scores.RUBRICS[cfg.score_mode]),
                              _docs(spark, args), rerank_model=model, out=target)
    ranking = reports.ranking(out["ranking"], "best_avg", "strategy")
    print(results.html_report(ranking, cfg.name, f"{target}/report.html", ["best_avg"], "strategy"))


def cmd_prepare(spark, args):
    rows = test_sets.read_gold_table(spark, args.input)
    done = prepare.enrich_test_set(rows, _need_model())
    results.save_workbook({"test_set": done}, args.output or f"{args.input.removesuffix('.xlsx')}_enhanced")


def cmd_compare(spark, args):
    scored = spark.read.parquet(f"{args.scored}/scores")
    flags = spark.read.parquet(f"{args.scored}/recall").withColumnRenamed("pipeline", "strategy")
    best = scored.groupBy("strategy", "query_id").agg({"total": "max"}).withColumnRenamed("max(total)", "score")
    table = best.join(flags, ["strategy", "query_id"], "left").withColumnRenamed("single", "recall")
    report = compare.compare(table, args.a, args.b, scored, args.top)
    for name, df in report.items():
        print(name)
        df.show(args.top, False)
    if args.output:
        results.save_workbook(report, args.output)


def cmd_report_summary(spark, args):
    rates = results.collect_results(spark, args.dir)
    ks = sorted(r[0] for r in rates.select("top_k").distinct().collect())
    matrix = reports.topk_matrix(rates, ks)
    print(results.html_report(matrix, args.title, os.path.join(args.dir, "summary.html"),
                              [f"single_rate_top{ks[0]}"]))


def cmd_mq_recall(spark, args):
    cfg = RecallConfig(name=args.name, kb=args.kb, values=_list(args.chunkers), retriever=args.retriever,
                       top_k_values=[int(k) for k in _list(args.top_k)], section_mode=args.section_mode)
    tests = test_sets.read_test_set(spark, args.test_set)
    target = os.path.join(args.output, cfg.name)
    results.save_jsonl(multi_query.make_rewrites(tests, _need_model()), f"{target}/rewrites")
    rewrites = spark.read.schema("query_id string, route int, question string").json(f"{target}/rewrites")
    out = multi_query.run_multi_query(cfg, tests, rewrites, _setup(spark, args), _docs(spark, args), target)
    out["cross"].show(100, False)


def cmd_budget(spark, args):
    ledger = results.Ledger(spark, f"{args.store}/_ledger")
    if args.reset:
        ledger.reset()
    reports.cost_report(ledger.read()).show(100, False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="recalloom")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--kb", default=config.DEFAULT_KB)
    common.add_argument("--store", default="index_store")
    common.add_argument("--datasets", default="datasets")
    common.add_argument("--tokenizer", default="cjk_bigram", choices=sorted(TOKENIZERS))
    common.add_argument("--dictionary", help="cut text by this file of words and counts instead")
    common.add_argument("--embedding", default="hashing")
    common.add_argument("--section-mode", default="presplit", choices=["presplit", "raw"])
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, fn):
        sub = commands.add_parser(name, parents=[common])
        sub.set_defaults(fn=fn)
        return sub

    add("strategies", cmd_strategies).add_argument("--type", default="chunker")
    add("demo", cmd_demo)
    p = add("build", cmd_build)
    p.add_argument("--chunker", default="")
    p.add_argument("--force", action="store_true")
    p.add_argument("--pure", action="store_true")
    p = add("search", cmd_search)
    p.add_argument("query")
    p.add_argument("--chunker", default="fixed_1100")
    p.add_argument("--retriever", default="hybrid")
    p.add_argument("--top-k", type=int, default=config.TOP_K)
    for name, fn, ks in (("recall", cmd_recall, "5,10"), ("run", cmd_run, "5")):
        p = add(name, fn)
        p.add_argument("--test-set", required=True)
        p.add_argument("--variable", default="chunker", choices=experiment.VARIABLES)
        p.add_argument("--chunkers", default="fixed_1100")
        p.add_argument("--retrievers", default="vector,bm25,hybrid")
        p.add_argument("--rerankers", default="direct")
        p.add_argument("--retriever", default="hybrid")
        p.add_argument("--top-k", default=ks)
        p.add_argument("--score-mode", default="rubric", choices=["rubric", "strict"])
        p.add_argument("--runs", type=int, default=1)
        p.add_argument("--name", default=name)
        p.add_argument("--output", default="output")
    p = add("prepare", cmd_prepare)
    p.add_argument("input")
    p.add_argument("--output", default="")
    p = add("compare", cmd_compare)
    p.add_argument("scored")
    p.add_argument("--a", required=True)
    p.add_argument("--b", required=True)
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--output", default="")
    p = add("report-summary", cmd_report_summary)
    p.add_argument("dir")
    p.add_argument("--title", default="recall summary")
    p = add("mq-recall", cmd_mq_recall)
    p.add_argument("--test-set", required=True)
    p.add_argument("--chunkers", default="fixed_1100")
    p.add_argument("--top-k", default="5,10")
    p.add_argument("--retriever", default="hybrid")
    p.add_argument("--name", default="multi_query")
    p.add_argument("--output", default="output")
    add("budget", cmd_budget).add_argument("--reset", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    args.fn(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
