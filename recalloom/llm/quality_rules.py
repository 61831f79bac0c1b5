"""Quality rules as a short-circuit cascade, cheapest rejections first.

Measures of a text are columns. Each rule is a condition on them and on the text that rejects a
document. A sample tells what every rule costs and which documents it rejects; the cascade then
asks, step by step, for the rule that rejects most of what is left per second, and a document is
asked only as far as the first rule that rejects it. The order changes the time, and which rule
a document is stopped by, never which documents stay. DataFrame and SQL operations only.

Edges: null and empty texts have no words, so the base rules fail them. A text of fewer than three
words has no window. Rows are judged one by one, so ties and repeated rows are judged alike. An
empty table gives no rows, and rules keep the order they are given in. Extra columns are carried
along; one whose name clashes with a measure is replaced by the measure.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh_name, stored

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Rows of the sample on which rules are timed; it only orders them.
SAMPLE_ROWS = 2000


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``MEASURES``, ``n_lines`` (lines with a word) and ``base_failed``.

    Three-word windows are sorted within their row; equal ones are then neighbours. No window
    leaves its row, so nothing is shuffled.
    """
    w, s, p, t = (fresh_name(docs.columns, c) for c in ("_words", "_windows", "_places", "_text"))
    rows = docs.withColumn(t, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = rows.withColumn(w, F.array_remove(F.split(t, SPACE), ""))
    n = F.size(w)
    fitting = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(w, F.lit(1), fitting), F.slice(w, F.lit(2), fitting), F.slice(w, F.lit(3), fitting),
                           F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.lit(None).cast("array<int>")))
    rows = rows.withColumn(s, F.when(n > 2, F.sort_array(windows)))
    same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(
        (a["0"] == b["0"]) & (a["1"] == b["1"]) & (a["2"] == b["2"]), F.array(a["3"], b["3"])))
    rows = rows.withColumn(p, F.when(n > 2, F.sort_array(F.array_distinct(F.flatten(F.array_compact(same))))))
    # A window covers its three words, or fewer where the next one begins before its end.
    covered = F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
                          F.lit(0), lambda x, y: x + y)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)
    rows = rows.withColumn(fresh_name(docs.columns, "_lines"), lines)
    line = F.col(fresh_name(docs.columns, "_lines"))
    out = rows.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(line).cast("bigint"),
        "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("bigint"),
        "n_repeat_words": F.coalesce(F.when(F.size(p) > 0, covered), F.lit(0)).cast("bigint")})
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop(w, s, p, t, fresh_name(docs.columns, "_lines"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text column; it may also name the measures. ``cost`` is in seconds for
    the sample, ``rejected`` the share of the sample that the rules before it leave to it and it rejects."""

    name: str
    rejects: Callable[[Column], Column]
    cost: float = 0.0
    rejected: float = 0.0


RULES = (
    # Words of running prose have three to ten letters on the average.
    Rule("word_length", lambda t: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words"))),
    # Markup, code and noise: more than one symbol in ten words.
    Rule("symbols", lambda t: 10 * F.col("n_symbols") > F.col("n_words")),
    # Lines that repeat earlier ones: more than three in ten.
    Rule("duplicate_lines", lambda t: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    # Encoded data: a word of over 200 characters.
    Rule("long_word", lambda t: t.rlike(WORD + "{201}")),
    # Shouting: more than three capitals in ten characters of words.
    Rule("capitals", lambda t: 10 * F.regexp_count(t, F.lit(r"\p{Lu}")) > 3 * F.col("word_chars")),
    # Tables of numbers: more than three digits in ten characters of words.
    Rule("digits", lambda t: 10 * F.regexp_count(t, F.lit("[0-9]")) > 3 * F.col("word_chars")),
    # Fewer than seven words in ten hold a letter.
    Rule("letters", lambda t: 10 * F.regexp_count(t, F.lit(rf"\p{{L}}{WORD}*")) < 7 * F.col("n_words")),
    # Lists: more than nine lines in ten begin with a bullet.
    Rule("bullets", lambda t: 10 * F.regexp_count(t, F.lit(r"(?:^|\n)[\x20\x09]*[-*•]")) > 9 * F.col("n_lines")),
)


def ordered(seen: dict[int, int], costs: Sequence[float], rules: Sequence[Rule]) -> list[Rule]:
    """The cascade: next comes the rule that rejects most of what is left, per second.

    ``seen`` counts the sample's documents by the set of rules (as bits) that reject them. Rules
    that reject nothing of what is left come last, the cheapest first; ties keep the given order.
    """
    left, total, out = dict(seen), max(sum(seen.values()), 1), []
    todo = list(range(len(rules)))
    while todo:
        hits = {i: sum(n for mask, n in left.items() if mask >> i & 1) for i in todo}
        best = max(todo, key=lambda i: (hits[i] / max(costs[i], 1e-9), -costs[i], -i))
        out.append(replace(rules[best], cost=costs[best], rejected=hits[best] / total))
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
        todo.remove(best)
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order ``rules`` by what they cost and reject on a sample of about ``sample_rows`` rows.

    Rows are drawn before they are measured, and written once; a rule's cost is the time of a pass over it, less that of a pass
    that only reads the text. Only counts per set of rejecting rules come back, at most one for
    each row of the sample.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    # All rows of a table not larger than the sample, else each with the same chance.
    drawn = docs if share == 1.0 else docs.sample(share, 7)
    sample = stored(measured(drawn, text_col), "quality-sample").where(~F.col("base_failed"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def seconds(*extra: Column) -> float:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.max(F.octet_length(text)), *extra).collect()
            best = min(best, time.perf_counter() - start)
        return best

    bare = seconds()
    costs = [max(seconds(F.count_if(r.rejects(text))) - bare, 1e-4) for r in rules]
    bits = [F.when(r.rejects(text), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    seen = {m: n for m, n in sample.groupBy(mask.alias("mask")).count().collect()}
    return ordered(seen, costs, rules)


def judge(rows: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """``rows`` (measured) with ``stopped_by``, the first rule that rejects, and ``kept``.

    One conditional expression: a rule is evaluated only where all before it passed.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        chain = chain.when(rule.rejects(text), F.lit(rule.name))
    return rows.withColumn("stopped_by", chain).withColumn("kept", F.col("stopped_by").isNull())


def filter_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Measure, plan on a sample and judge every row of ``docs``."""
    return judge(measured(docs, text_col), plan(docs, rules, text_col), text_col)
