import json

import pytest
from pyspark.sql import functions as F

from recalloom.config import FullConfig, RecallConfig
from recalloom.functions.embedding import hashing_embedder
from recalloom.functions.models import RateLimited, chat_model, scripted_model, with_retry
from recalloom.functions.text import TOKENIZERS
from recalloom.operators import bm25, compare, search
from recalloom.plans import build, experiment, multi_query, registry
from recalloom.sources import index_store, markdown, results, test_sets, xlsx
from recalloom.streaming import ingest

FILES = {
    "公积金管理办法": "# 公积金管理办法\n序言。\n## 第一章 缴存\n职工和单位按月缴存住房公积金，缴存比例不低于百分之五，不高于百分之十二，"
                "缴存基数为职工上一年度月平均工资，每年七月调整一次。\n## 第二章 提取\n职工购买、建造、翻建、大修自住住房的，可以提取"
                "账户内的存储余额，提取申请应当在三个工作日内作出决定并通知申请人，逾期视为同意。\n",
    "差旅费规定": "一、交通费用\n工作人员出差应当按照规定等级乘坐交通工具，未按规定等级乘坐的，超支部分由个人自理，不得报销任何额外费用。"
             "\n二、住宿标准\n省会城市住宿费标准为每人每天五百元，其他城市为每人每天三百五十元，凭发票在标准之内据实报销，超出部分自行承担。\n",
    "无标题说明": "本说明没有任何标题，只是一个很短的段落，[链接](http://x)用于检查清洗，以及没有章节时整篇文档作为一个章节处理的情况。",
}
TESTS = [("缴存比例是多少？", "缴存比例不低于百分之五，不高于百分之十二", "公积金管理办法.pdf"), ("", "x", "y"),
         ("省会城市住宿费标准是多少？", "省会城市住宿费标准为每人每天五百元", "差旅费规定"),
         ("火星上的天气如何", "没有答案可以参考的火星天气内容", "火星")]


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kb")
    for name, text in FILES.items():
        (path / f"{name}.md").write_text(text, encoding="utf-8")
    (path / "ignored.txt").write_text("no")
    return path


@pytest.fixture(scope="module")
def docs(spark, kb):
    return markdown.read_markdown(spark, str(kb), "demo")


@pytest.fixture(scope="module")
def tests(spark):
    rows = spark.createDataFrame([(i + 2, *t) for i, t in enumerate(TESTS)],
                                 "_row long, `问题` string, `参考答案` string, `文件来源` string")
    return test_sets.shape_test_set(rows, "_row")


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    store = index_store.IndexStore(spark, str(tmp_path_factory.mktemp("store")))
    tok = TOKENIZERS["cjk_bigram"]
    return build.Build(store, tok, hashing_embedder(32, tok), token_buckets=3)


def test_markdown_scan(docs):
    rows = {r.file_id: r.text for r in docs.collect()}
    assert set(rows) == set(FILES)
    assert "链接" not in rows["无标题说明"] and rows["无标题说明"].endswith("。\n\n")
    assert rows["差旅费规定"] == FILES["差旅费规定"] + "\n\n"


def test_test_set_rules(tests):
    rows = tests.orderBy("query_id").collect()
    assert [r.query_id for r in rows] == ["Q1", "Q3", "Q4"]
    assert rows[0].gold_answer == TESTS[0][1] and rows[0].ref_file == TESTS[0][2]


def test_build_is_idempotent_and_prunes(spark, docs, setup):
    key = build.index_key("demo", "fixed_1100")
    assert not setup.store.has(key)
    n = build.build_index(docs, key, setup)
    assert n == build.build_index(docs, key, setup) == build.build_index(docs, key, setup, force=True) == 5
    assert setup.store.knowledge_bases() == ["demo"] and setup.store.strategies("demo") == ["fixed_1100"]
    index = setup.store.open(key, setup.tokenizer)
    asked = spark.createDataFrame([("q", "住宿")], "query_id string, question string")
    stored = search.retrieve(index, asked, "bm25", 3).collect()
    fitted = bm25.sparse_topk(bm25.fit(index.chunks, tokenizer=setup.tokenizer), asked, 3,
                              tokenizer=setup.tokenizer).collect()
    assert len(stored) == 1 and [r.asDict() for r in stored] == [r.asDict() for r in fitted]
    vocab = setup.store.read("vocab", key)
    assert vocab.agg(F.max("token_id")).first()[0] == vocab.count() - 1
    with pytest.raises(LookupError):
        setup.store.read("chunks", build.index_key("demo", "fixed_1500"))
    assert setup.store.count(build.index_key("other", "fixed_1500")) == 0
    report = build.build_all(docs, "demo", setup, ["token_1024", "llm_index"], pure=True)
    assert report["token_1024"] == 5 and "needs a model" in report["llm_index"]


def test_index_identity():
    assert build.index_key("k", "fixed_1100_meta") == {
        "kb": "k", "chunker": "fixed_1100", "section_mode": "presplit", "with_meta": True}
    assert build.index_key("k", "fixed_1100_ovl150_pure", with_meta=True)["with_meta"] is False
    assert registry.names("reranker") == ["direct", "llm_rerank", "bge_reranker"]
    with pytest.raises(ValueError):
        build.index_key("k", "unknown")


@pytest.mark.parametrize("name", ["header_aware_h6", "parent_child_v1", "token_1024_ovl100"])
def test_chunk_ids_are_unique(docs, setup, name):
    chunks = build.chunk_documents(docs, build.index_key("demo", name), setup)
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0


def test_metadata_cache_asks_only_once(spark, docs, setup, tmp_path):
    calls = scripted_model(lambda p: '{"file_type": "办法", "file_summary": "概述"}' if p.startswith("- ") else "摘要")
    files, parts = build.stored_metadata(spark, docs, calls, str(tmp_path))
    assert {r.file_type for r in files.collect()} == {"办法"} and parts.count() == 5
    silent = scripted_model(lambda p: None)
    again, _ = build.stored_metadata(spark, docs, silent, str(tmp_path))
    assert {r.file_summary for r in again.collect()} == {"概述"}
    key = build.index_key("demo", "fixed_1100_meta")
    chunks = build.chunk_documents(docs, key, build.Build(setup.store, setup.tokenizer, None, None, files, parts))
    row = chunks.where("file_id = '差旅费规定'").orderBy("section_idx").first()
    assert row.index_text.startswith("文件类型：办法；章节：一、交通费用；章节摘要：摘要；文件摘要：概述\n")
    assert not row.content_text.startswith("文件类型")


def test_recall_experiment(spark, docs, setup, tests, tmp_path):
    cfg = RecallConfig(kb="demo", variable="retriever", values=["bm25", "hybrid"], top_k_values=[1, 3])
    out = experiment.run_recall(cfg, tests, setup, docs, out=str(tmp_path / "exp"))
    got = {(r.pipeline, r.top_k, r.query_id): (r.single, r.hit_rank, r.file) for r in out["recall"].collect()}
    assert len(got) == 2 * 2 * 3
    for k in (1, 3):
        assert got["bm25", k, "Q1"] == (1, 1, 1) and got["bm25", k, "Q3"] == (1, 1, 1)
        assert got["bm25", k, "Q4"] == (0, 0, 0)
    assert results.collect_results(spark, str(tmp_path)).count() == 4
    sheets = results.recall_sheets(out["recall"], out["rates"], tests, cfg.values, 3)
    results.save_workbook(sheets, str(tmp_path / "_book"))
    xlsx.register(spark)
    back = spark.read.format("xlsx").load(str(tmp_path / "_book" / "汇总"))
    assert back.where("`问题ID` = 'Q1'").first()["bm25_召回位置"] == "top1"
    assert json.load(open(experiment.save_config(cfg, str(tmp_path / "exp"))))["values"] == cfg.values


def test_rerankers(spark, setup, docs, tests):
    cfg = RecallConfig(kb="demo", variable="reranker", values=["direct", "bge_reranker", "llm_rerank"],
                       retriever="bm25", top_k_values=[3])
    model = scripted_model(lambda p: "9" if "五百元" in p else "1")
    out = experiment.run_recall(cfg, tests, setup, docs, model)
    first = {(r.pipeline, r.query_id): r.content_text for r in out["hits"].where("rank = 1").collect()}
    assert "五百元" in first["llm_rerank", "Q3"] and len(first) >= 6


def test_full_experiment_and_comparison(setup, docs, tests, tmp_path):
    cfg = FullConfig(kb="demo", variable="retriever", values=["bm25", "vector"], top_k=2, runs=2)
    answer = scripted_model(lambda p: "答：" + p[-20:])
    grade = scripted_model(lambda p: json.dumps({"评分理由": ["[必答]1: 得分"]}, ensure_ascii=False))
    out = experiment.run_full(cfg, tests, setup, answer, grade, docs, out=str(tmp_path))
    assert out["answers"].count() == 2 * 3 * 2
    assert {r.strategy: (r.best_avg, r.n_questions) for r in out["ranking"].collect()} == {
        "bm25": (100.0, 3), "vector": (100.0, 3)}
    table = out["scores"].groupBy("strategy", "query_id").agg(F.max("total").alias("score")).withColumns(
        {"recall": F.lit(0), "hit_rank": F.lit(0)})
    assert compare.win_draw_lose(compare.side_by_side(table, "bm25", "vector")).first().draws == 3


def test_multi_query_experiment(spark, setup, docs, tests):
    rewrites = multi_query.make_rewrites(tests, scripted_model(
        lambda p: "缴存的比例规定\n\nab\n住宿费报销的标准\n第三个改写问题\n第四个改写问题"))
    assert {r.route for r in rewrites.collect()} == {1, 2, 3}
    cfg = RecallConfig(kb="demo", values=["fixed_1100"], retriever="bm25", top_k_values=[2])
    out = multi_query.run_multi_query(cfg, tests, rewrites, setup, docs)
    row = out["cross"].first()
    assert row.chunker == "fixed_1100" and row["direct_single_rate"] == pytest.approx(200 / 3, abs=1e-5)
    assert row.single_rate_delta == pytest.approx(row["MQ_single_rate"] - row["direct_single_rate"], abs=1e-5)


def test_xlsx_round_trip(spark, tmp_path, monkeypatch):
    xlsx.register(spark)
    df = spark.createDataFrame([("a<b&c", 1, 2.5, True), (None, 2, None, False), (" 空 格 ", 3, -1.0, None)],
                               "s string, i int, d double, b boolean")
    monkeypatch.setattr(xlsx, "MAX_SHEET_ROWS", 1_048_576)
    df.coalesce(1).write.format("xlsx").option("sheet", "表 1").mode("overwrite").save(str(tmp_path / "w"))
    got = spark.read.format("xlsx").option("sheet", "表 1").load(str(tmp_path / "w"))
    assert got.columns == ["_row", "s", "i", "d", "b"]
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == [
        ("a<b&c", "1", "2.5", "TRUE"), (None, "2", None, "FALSE"), (" 空 格 ", "3", "-1.0", None)]
    book = next((tmp_path / "w").glob("*.xlsx"))
    assert xlsx.sheet_names(str(book)) == ["表 1"]
    tests = test_sets.read_test_set(spark, str(book))
    assert [r.query_id for r in tests.orderBy("query_id").collect()] == ["Q1", "Q3"]


def test_full_sheets_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx, "MAX_SHEET_ROWS", 3)
    path = str(tmp_path / "b.xlsx")
    book = xlsx._Workbook(path, ["n"], "s")
    for i in range(5):
        book.add((i,))
    book.close()
    assert xlsx.sheet_names(path) == ["s", "s_2", "s_3"]
    rows = [c[1] for s in xlsx.sheet_names(path) for n, c in xlsx.read_rows(path, s) if n > 1]
    assert rows == ["0", "1", "2", "3", "4"]


def test_ledger_and_report_page(spark, tmp_path):
    ledger = results.Ledger(spark, str(tmp_path / "ledger"), budget=5.0)
    ledger.add(spark.createDataFrame([("meta", 2.0), ("score", 4.0)], "task string, cost double"))
    assert ledger.total() == 6.0 and ledger.remaining() == -1.0
    with pytest.raises(RuntimeError):
        ledger.require("build")
    ledger.reset()
    assert ledger.total() == 0.0
    page = results.html_report(spark.createDataFrame([("a<b", 50.0, 1)], "pipeline string, single_rate double, place int"),
                               "T", str(tmp_path / "r" / "x.html"), ["single_rate"])
    assert "a&lt;b" in open(page, encoding="utf-8").read()


def test_streaming_intake_adds_each_file_once(spark, kb, tmp_path):
    target, state = str(tmp_path / "docs"), str(tmp_path / "state")
    for _ in range(2):
        ingest.ingest(spark, str(kb), "demo", target, state).awaitTermination(60)
    assert {r.file_id for r in spark.read.parquet(target).collect()} == set(FILES)
    assert spark.read.parquet(target).count() == len(FILES)


def test_chat_model_falls_back_and_retries(spark):
    def post(url, body, key):
        if body["model"] == "main":
            raise OSError("down")
        return {"choices": [{"message": {"content": f" {body['model']}:{body['messages'][-1]['content']} "}}]}

    model = chat_model("http://none", "main", fallbacks=["spare"], post=post)
    df = spark.createDataFrame([("hi",), (None,)], "p string")
    assert [r[0] for r in df.select(model(F.col("p"))).collect()] == ["spare:hi", None]
    tries = []

    def limited():
        tries.append(1)
        if len(tries) < 3:
            raise RateLimited
        return "done"

    assert with_retry(limited, 3, lambda n: 0) == "done" and len(tries) == 3
