import json
import re

import pytest
from pyspark.sql import functions as F

from recalloom.functions import scoring
from recalloom.functions.coverage import block_coverage
from recalloom.functions.models import scripted_model
from recalloom.operators import compare, generation, prepare, recall, reports, scores

GOLD = "住房公积金缴存比例为百分之十二"
TEXTS = {"c1": "本办法规定" + GOLD + "，自发布之日起施行。", "c2": "住房公积金缴存", "c3": "比例为百分之十二",
         "c4": "no chinese at all", "c5": "无关" * 150}


def hits(spark, lists):
    rows = [(p, k, q, i + 1, c, TEXTS[c], f"{c}文件") for (p, k, q), cs in lists.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "pipeline string, top_k int, query_id string, rank int, "
                                       "chunk_id string, content_text string, source string")


def test_four_recall_flags(spark):
    lists = {("p", 3, "q1"): ["c5", "c1"], ("p", 3, "q2"): ["c2", "c3"], ("r", 3, "q1"): ["c4", "c1"]}
    tests = spark.createDataFrame([("q1", GOLD, "c1文件.pdf"), ("q2", GOLD, "c9"), ("q3", GOLD, ""), ("q4", "", "c1")],
                                  "query_id string, gold_answer string, ref_file string")
    runs = spark.createDataFrame([("p", 3), ("r", 3)], "pipeline string, top_k int")
    flags = recall.question_recall(hits(spark, lists), tests, runs=runs)
    got = {(r.pipeline, r.query_id): (r.single, r.hit_rank, r.merged, r.concat, r.file, r.file_rank)
           for r in flags.collect()}
    miss = (0, 0, 0, 0, 0, 0)
    # The two halves of the answer reach the threshold only together.
    assert got == {("p", "q1"): (1, 2, 1, 1, 1, 2), ("p", "q2"): (0, 0, 0, 1, 0, 0), ("p", "q3"): miss,
                   ("p", "q4"): miss, ("r", "q1"): (1, 2, 1, 1, 1, 2), ("r", "q2"): miss, ("r", "q3"): miss,
                   ("r", "q4"): miss}
    rates = {r.pipeline: r for r in recall.rollup(flags).collect()}
    assert (rates["p"].single_rate, rates["p"].concat_rate, rates["p"].avg_hit_rank) == (25.0, 50.0, 2.0)


def test_autojunk_lowers_coverage_of_long_texts():
    needle, hay = "的" * 5 + "甲", "甲" + "的" * 400
    assert block_coverage(needle, hay, False) == 5 / 6 and block_coverage(needle, hay, True) == 1 / 6


def test_answer_covers_itself(spark):
    lists = {("p", 1, q): [q] for q in ("c1", "c2", "c3")}
    tests = spark.createDataFrame([(q, TEXTS[q], "") for q in ("c1", "c2", "c3")],
                                  "query_id string, gold_answer string, ref_file string")
    rows = recall.question_recall(hits(spark, lists), tests).collect()
    assert all((r.single, r.merged, r.concat, r.hit_rank, r.file) == (1, 1, 1, 1, 0) for r in rows)


def test_group_delta(spark):
    rates = spark.createDataFrame([("x", 5, "MQ", 70.0, 60.0), ("x", 5, "direct", 72.5, 50.0)],
                                  "chunker string, top_k int, group string, single_rate double, file_rate double")
    row = recall.group_delta(rates).first()
    assert (row["MQ_single_rate"], row.single_rate_delta, row.file_rate_delta) == (70.0, -2.5, 10.0)


def plain_score(reason):
    if not reason:
        return 0, 0, 0, 0
    lost, parts = [], []
    for mark, weight in (("必答", 70), ("选答", 20), ("参考文件", 10)):
        found = re.findall(r"\[" + mark + r"\](\d+):.*?(得分|0分)", reason)
        lost.append(weight / len(found) * sum(v == "0分" for _, v in found) if found else 0)
        parts.append(weight - lost[-1] if found else 0)
    total = max(100 - sum(lost) - min(reason.count("(surplus)") * 5, 30), 0)
    return (0 if "[冲突点]" in reason else round(total, 2), *[round(p, 2) for p in parts])


REASONS = ["", "[必答]1: 得分 - ok", "[必答]1: 得分\n[必答]2: 0分\n[选答]1: 0分\n[参考文件]1: 得分",
           "[必答]1: 10分", "[必答]1: 35分", "(surplus)" * 7 + "[必答]1: 0分", "[冲突点][必答]1: 得分",
           "[必答]1: 得分\n[必答]2: 0分\n[必答]3: 0分\n(surplus)"]


def test_score_computation(spark):
    df = spark.createDataFrame(list(enumerate(REASONS)), "i int, reason string")
    for r in scores.score_reasons(df).collect():
        assert (r.total, r.required, r.optional, r.reference) == pytest.approx(plain_score(r.reason), abs=0.006)
    strict = {r.i: r.required for r in scores.score_reasons(df, strict=True).collect()}
    assert strict[3] == 0 and strict[2] == 35


def test_score_reply_ladder(spark):
    replies = ['{"评分理由": [" [必答]1: 得分 ", 5, "(surplus)"], "总分": 1}', "{'评分理由': ['a', 'b']}",
               '{"评分理由": "1. 甲 2. 乙"}', "text 1. one 2. two", "", None, '{"other": 1}']
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = [r[0] for r in df.orderBy("i").select(scoring.score_reason(F.col("reply"))).collect()]
    assert got == ["[必答]1: 得分\n(surplus)", "a\nb", "1. 甲 \n2. 乙", "1. one \n2. two", "", "", ""]


def test_rerank_score(spark):
    df = spark.createDataFrame(list(enumerate(["8", "score: 12.5", "-3", "none", None])), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(scoring.rerank_score(F.col("t"))).collect()] == [8, 10, 0, 5, 5]


def test_grading_skips_blank_and_known_answers(spark):
    answers = spark.createDataFrame(
        [("s", "q1", 1, "yes"), ("s", "q2", 1, "  "), ("s", "q3", 1, "old")],
        "strategy string, query_id string, run int, answer string").withColumns(
        {c: F.lit("") for c in ("question", "point", "required_points", "optional_points", "ref_file")})
    old = spark.createDataFrame([("s", "q3", 1, 40.0, 0.0, 0.0, 0.0, "kept")],
                                "strategy string, query_id string, run int, total double, required double, "
                                "optional double, reference double, reason string")
    model = scripted_model(lambda p: json.dumps({"评分理由": ["[必答]1: 得分"]}, ensure_ascii=False)
                           if json.loads(p)["ai答案"] == "yes" else "")
    got = {r.query_id: (r.total, r.reason) for r in scores.grade(answers, model, old).collect()}
    assert got == {"q1": (100.0, "[必答]1: 得分"), "q3": (40.0, "kept")}


def test_score_rollup(spark):
    rows = spark.createDataFrame([("s", "q1", 10.0), ("s", "q1", 30.0), ("s", "q2", 50.0)],
                                 "strategy string, query_id string, total double")
    row = scores.score_rollup(rows).first()
    assert (row.best_avg, row.all_avg) == (40.0, 30.0)


RESULTS = [("q1", "A", 90.0, 1, 1), ("q1", "B", 70.0, 0, 0), ("q2", "A", 50.0, 0, 0), ("q2", "B", 80.0, 1, 3),
           ("q3", "A", 60.0, 1, 2), ("q3", "B", 60.0, 1, 1), ("q4", "A", None, 0, 0), ("q4", "B", 5.0, 0, 0)]


def test_comparison(spark):
    df = spark.createDataFrame(RESULTS, "query_id string, strategy string, score double, recall int, hit_rank int")
    out = compare.compare(df, "A", "B", n=2)
    assert out["win_draw_lose"].first().asDict() == {
        "a_wins": 1, "a_mean_lead": 20.0, "draws": 1, "b_wins": 2, "b_mean_lead": 17.5}
    assert {r.bucket: (r.n, r.mean_a, r.mean_b) for r in out["recall_cross"].collect()} == {
        "双召": (1, 60.0, 60.0), "A独召": (1, 90.0, 70.0), "B独召": (1, 50.0, 80.0), "双失": (1, 0.0, 5.0)}
    assert [r.query_id for r in out["top_divergence"].collect()] == ["q2", "q1"]
    assert {r.query_id: r["diff"] for r in out["diff"].collect()} == {"q1": 20.0, "q2": -30.0, "q3": 0.0, "q4": -5.0}
    with pytest.raises(ValueError):
        compare.compare(df, "A", "C")
    empty = compare.recall_cross(compare.side_by_side(df.where("query_id = 'q1'"), "A", "B"))
    assert empty.where("n = 0").count() == 3


def test_detect_columns():
    assert prepare.detect_columns(["问题", "标准答案", "文件来源"]) == {
        "question": "问题", "qid": None, "answer": "标准答案", "ref_docs": "文件来源"}
    assert prepare.detect_columns(["My Question", "the answer text", "REF doc"]) == {
        "question": "My Question", "qid": None, "answer": "the answer text", "ref_docs": "REF doc"}
    assert prepare.detect_columns(["query", "question", "编号"])["question"] == "question"
    assert prepare.missing_columns(["point", " 选答点 "]) == ["必答点", "参考文件"]


def test_points_and_enrichment(spark):
    rows = spark.createDataFrame([("q1", "a1", "F.pdf"), ("q2", " ", "F"), ("q3", "bad", ""), ("q4", "a4", None)],
                                 "`问题` string, `答案` string, `参考文件` string")
    good = {"points": ["1. x", "y"], "required": [1, 9, "2"], "optional": [1, 2], "ref_idx": [0]}

    def play(prompt):
        answer = json.loads(prompt)["answer"]
        return "nothing" if answer == "bad" else "```json\n" + json.dumps({**good, "required": [1, 9]}) + "\n```"

    got = {r["问题"]: tuple(r)[2:] for r in prepare.enrich_test_set(rows, scripted_model(play)).collect()}
    assert got == {"q1": ("1. x; 2. y; 3. 参考依据：F.pdf", "1", "2", "3"), "q2": ("", "", "", ""),
                   "q3": ("", "", "", ""), "q4": ("1. x; 2. y", "1", "2", "")}
    incomplete = spark.createDataFrame([('{"points": ["a"], "required": []}',), ('{"points": [], "required": [], '
                                        '"optional": [], "ref_idx": []}',)], "t string")
    assert all(r[0] is None for r in incomplete.select(prepare.parse_points(F.col("t"))).collect())


def test_context_text(spark):
    rows = spark.createDataFrame([("q", 2, "b", "S2", "two", "idx" * 30), ("q", 1, "a", "S1", "one", "one"),
                                  ("q", 1, "a", "S1", "one", "one")],
                                 "query_id string, rank int, chunk_id string, source string, "
                                 "content_text string, index_text string")
    assert generation.context_text(rows).first().context == (
        "[来源1: S1]\none\n\n[来源2: S2] (匹配: " + ("idx" * 30)[:60] + ")\ntwo")


def test_sheet_round_trip(spark):
    sheet = spark.createDataFrame([("q1", "top2", 1, 80.0, "ans", 1)],
                                  "`问题ID` string, `a_召回位置` string, `a_召回` int, `a_得分` double, `a_回答` string, `b_召回` int")
    got = {r.strategy: (r.hit_rank, r.recall, r.score, r.answer)
           for r in reports.sheet_to_long(sheet, ["问题ID"]).collect()}
    assert got == {"a": ("top2", "1", "80.0", "ans"), "b": (None, "1", None, None)}
    detail = spark.createDataFrame([("q", "t1", "s1", "t2", None)],
                                   "`问题ID` string, `检索内容1` string, `来源1` string, `检索内容2` string, `来源2` string")
    docs = reports.detail_documents(detail, ["问题ID"]).first().docs
    assert [(d.content, d.source) for d in docs] == [("t1", "s1"), ("t2", "")]
