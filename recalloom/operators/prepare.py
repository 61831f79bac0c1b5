"""Test-set preparation: column detection, scoring points and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import fenced_json, strip

Model = Callable[[Column], Column]

# --- fixed values -----------------------------------------------------------
SCORING_COLUMNS = ("point", "必答点", "选答点", "参考文件")
EXACT_NAMES = {
    "question": ("问题", "question", "query"),
    "qid": ("问题ID", "问题id", "id", "编号", "序号"),
    "answer": ("正确回答", "标准答案", "answer", "参考答案", "答案"),
    "ref_docs": ("文件来源", "文件溯源", "参考文件", "涉及计价标准", "涉及标准", "reference", "ref"),
}
# Tried in this order for a name still open: (name, parts as written, parts in lower case).
PARTIAL_NAMES = (
    ("question", ("问题",), ("question",)),
    ("answer", ("回答", "答案"), ("answer",)),
    ("ref_docs", ("文件", "来源", "溯源"), ()),
    ("ref_docs", ("计价", "标准", "参考"), ("ref",)),
)
REFERENCE_LABEL = "参考依据："
POINTS_SCHEMA = ("points array<string>, required array<double>, optional array<double>, "
                 "ref_idx array<double>")
# ----------------------------------------------------------------------------


def detect_columns(columns: Iterable[str]) -> dict[str, str | None]:
    """Which column plays which part. Exact names win, the last of several; then parts."""
    names = [str(c).strip() for c in columns]
    found: dict[str, str | None] = {
        role: next((c for c in reversed(names) if c in exact), None)
        for role, exact in EXACT_NAMES.items()}
    for role, parts, lower_parts in PARTIAL_NAMES:
        if found[role] is None:
            found[role] = next((c for c in names if any(p in c for p in parts)
                                or any(p in c.lower() for p in lower_parts)), None)
    return found


def missing_columns(columns: Iterable[str]) -> list[str]:
    have = {str(c).strip() for c in columns}
    return [c for c in SCORING_COLUMNS if c not in have]


def parse_points(reply: Column) -> Column:
    """A points reply as a struct; null unless all four parts are there and points is not empty."""
    inner = fenced_json(reply)
    node = F.from_json(inner, POINTS_SCHEMA)
    keys = F.json_object_keys(inner)
    names = F.array(*[F.lit(n) for n in ("points", "required", "optional", "ref_idx")])
    complete = F.size(F.array_except(names, F.coalesce(keys, F.array().cast("array<string>")))) == 0
    return F.when(complete & (F.size(node["points"]) > 0), node)


def validate_points(points: Column) -> Column:
    """Number the points and keep only sensible references to them.

    Points get the prefix ``i.`` unless they have it; numbers outside 1..n are dropped; an
    optional point that is also required is only required.
    """
    n = F.size(points["points"])

    def numbered(p, i):
        head = F.concat((i + 1).cast("string"), F.lit("."))
        return F.when(F.startswith(strip(p), head), p).otherwise(
            F.concat(head, F.lit(" "), strip(p)))

    def ids(name):
        given = F.coalesce(points[name], F.array().cast("array<double>"))
        inside = F.filter(given, lambda v: (v >= 1) & (v <= n))
        return F.transform(inside, lambda v: v.cast("int"))

    required = ids("required")
    return F.when(points.isNotNull(), F.struct(
        F.transform(points["points"], numbered).alias("points"), required.alias("required"),
        F.filter(ids("optional"), lambda v: ~F.array_contains(required, v)).alias("optional"),
        ids("ref_idx").alias("ref_idx")))


def points_prompt(question: Column, answer: Column, references: Column) -> Column:
    """The question, the whole answer and the cited files as JSON."""
    return F.to_json(F.struct(
        question.alias("question"),
        answer.alias("answer"),
        F.when(references != "", references).otherwise(F.lit("（无）")).alias("references")))


def enrich_test_set(rows: DataFrame, model: Model) -> DataFrame:
    """Add the scoring columns ``point, 必答点, 选答点, 参考文件`` to raw question/answer rows.

    Rows without an answer keep empty points, and so do rows whose reply cannot be used.
    A named reference file becomes one more point of its own.
    """
    roles = detect_columns(rows.columns)
    for role in ("question", "answer"):
        if roles[role] is None:
            raise ValueError(f"no {role} column among {rows.columns}")

    def text(role):
        name = roles[role]
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name else F.lit("")

    base = rows.select(text("question").alias("问题"), text("answer").alias("正确回答"),
                       text("ref_docs").alias("_ref"))
    answered = strip(F.col("正确回答")) != ""
    reply = model(points_prompt(F.col("问题"), F.col("正确回答"), F.col("_ref")))
    parsed = base.withColumn("_reply", reply).withColumn("_raw", parse_points(F.col("_reply")))
    asked = parsed.withColumn("_p", F.when(answered, validate_points(F.col("_raw"))))
    ref = strip(F.col("_ref"))
    cite = answered & (ref != "")
    empty = F.array().cast("array<string>")
    points = F.coalesce(F.col("_p.points"), empty)
    next_no = (F.size(points) + 1).cast("string")
    all_points = F.when(cite, F.concat(points, F.array(F.concat(
        next_no, F.lit(f". {REFERENCE_LABEL}"), ref)))).otherwise(points)

    def numbers(name):
        return F.coalesce(F.col(f"_p.{name}").cast("array<string>"), empty)

    refs = F.when(cite, F.concat(numbers("ref_idx"), F.array(next_no))).otherwise(numbers("ref_idx"))
    return asked.select(
        "问题", "正确回答", F.array_join(all_points, "; ").alias("point"),
        F.array_join(numbers("required"), ",").alias("必答点"),
        F.array_join(numbers("optional"), ",").alias("选答点"),
        F.array_join(refs, ",").alias("参考文件"))
