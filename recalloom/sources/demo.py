"""A small knowledge base and test set of our own, for trying the commands out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

_TOPICS = {
    "年休假办法": [("第一章 天数", "职工累计工作满一年不满十年的，年休假五天；满十年不满二十年的，年休假十天；满二十年的，年休假十五天。"),
              ("第二章 安排", "单位根据生产和工作的具体情况，并考虑职工本人意愿，统筹安排年休假，一般不跨年度安排，确有必要的可以跨一个年度。")],
    "图书借阅规则": [("第一章 数量", "每位读者一次最多借阅十册图书，其中外文图书不超过三册，期刊和工具书只在阅览室内阅读，不得外借。"),
               ("第二章 期限", "图书借阅期限为三十天，到期前可以续借一次，续借期限为十五天，逾期每册每天收取两角的滞纳费用。")],
    "车辆停放规定": [("第一章 登记", "进入园区的车辆应当登记车牌号码和联系电话，登记信息有变化的，应当在七天之内到管理处办理变更手续。"),
               ("第二章 收费", "地面停车位每小时收费三元，每天最高二十元；地下停车位每月收费四百元，按季度缴纳的给予百分之五的优惠。")],
}
_QUESTIONS = [
    ("工作满十年有几天年休假？", "满十年不满二十年的，年休假十天", "年休假办法.pdf"),
    ("年休假可以跨年度安排吗？", "一般不跨年度安排，确有必要的可以跨一个年度", "年休假办法"),
    ("一次能借几册图书？", "每位读者一次最多借阅十册图书", "图书借阅规则.docx"),
    ("借阅期限有多长？", "图书借阅期限为三十天，到期前可以续借一次", "图书借阅规则"),
    ("地下停车位怎么收费？", "地下停车位每月收费四百元", "车辆停放规定.md"),
]


def write_documents(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    for name, chapters in _TOPICS.items():
        body = "\n\n".join(f"## {title}\n\n{text}" for title, text in chapters)
        with open(os.path.join(path, f"{name}.md"), "w", encoding="utf-8") as f:
            f.write(f"# {name}\n\n{body}\n")
    return path


def demo_questions(spark: SparkSession) -> DataFrame:
    rows = [(i + 2, *q) for i, q in enumerate(_QUESTIONS)]
    return spark.createDataFrame(rows, "_row long, `问题` string, `正确回答` string, `参考文件` string")
