"""Audit of interacting filters by the Hart-Mas-Colell potential.

Filters remove documents from a part of the corpus. The worth of a coalition of filters is the
number of documents that at least one of them removes. Documents are counted by the set of filters
they fail; from at most 32 counts per part come the worths of all 32 coalitions. The potential of a
coalition S is P(S) = (worth(S) + the sum of P(S without i) over its i) / |S|, worked out from small
coalitions to large ones. The Shapley value of a filter is the potential of all filters less the
potential without it. A step of an order removes worth(prefix with the filter) - worth(prefix).

Edges: null text counts as empty, a null part as the empty string. A null id is larger than any
other; rows repeated with one id are not larger than each other, so neither fails for the other's
sake. A document with several rows of labels has a mark if any of them has it. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_bounded, stored

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
# Shapley values are reported as their sum over all orders.
ORDERS = 120
# Potentials times 60, which all coalition sizes up to five divide, are whole numbers.
SCALE = 60
_NULL_ID = (1 << 63) - 1


def text_failures(text: Column) -> Column:
    """The conditions on a text alone, A to D, as bits 0 to 3."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    fails = (n < 200,
             100 * F.size(F.array_distinct(words)) < 50 * n,
             100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
             text.rlike(r"[#$%&*|]"))
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and set of failed filters.

    Texts leave their rows as digests. Whether an earlier document has the same text is found by
    joining the least id of every text back on text and id together, so a text that a third of all
    documents share is no hot key.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_NULL_ID)).alias("id"), text.alias("text"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                       text_failures(F.col("text")).alias("fails"))
    rows = stored(rows.groupBy("digest", "id", "part", "fails").agg(F.count(F.lit(1)).alias("rows")), "failures")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "id"], "left")
    mask = F.col("fails") + F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << 4))
    rows = rows.select("id", "part", mask.alias("mask"), "rows")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    marks = broadcast_if_bounded(stored(marks.where("good + toxic > 0"), "marks"))
    # Rows without an id have no labels and would all share one key.
    known = rows.where(F.col("id") != _NULL_ID).join(marks, "id", "left")
    none = F.lit(None).cast("int")
    lost = rows.where(F.col("id") == _NULL_ID).withColumns({"good": none, "toxic": none})
    return known.unionByName(lost).groupBy("part", "mask").agg(
        F.sum("rows").alias("n"), F.sum(F.col("rows") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("rows") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def worths(counts: DataFrame) -> DataFrame:
    """Per part: ``total`` and the arrays ``removed, good, toxic`` over all coalitions (as bits)."""
    def over(column: str) -> Column:
        # A document is removed by every coalition that holds a filter it fails.
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(column)).otherwise(F.lit(0)))
                         for s in range(COALITIONS)])

    return counts.groupBy("part").agg(F.sum("n").alias("total"), over("n").alias("removed"), over("good").alias("good"),
                                      over("toxic").alias("toxic"))


def with_potentials(parts: DataFrame) -> DataFrame:
    """Add ``potential``: the potentials of all coalitions, times ``SCALE``.

    Level by level: the coalitions of one size need only those of one filter less.
    """
    out = parts.withColumn("_p0", F.lit(0).cast("bigint"))
    members = {s: [i for i in range(len(FILTERS)) if s >> i & 1] for s in range(COALITIONS)}
    for size in range(1, len(FILTERS) + 1):
        level = {}
        for s in (s for s in members if len(members[s]) == size):
            smaller = F.col(f"_p{s & ~(1 << members[s][0])}")
            for i in members[s][1:]:
                smaller = smaller + F.col(f"_p{s & ~(1 << i)}")
            level[f"_p{s}"] = F.call_function("div", SCALE * F.get("removed", F.lit(s)) + smaller, F.lit(size))
        out = out.withColumns(level)
    names = [f"_p{s}" for s in range(COALITIONS)]
    return out.withColumn("potential", F.array(*names)).drop(*names)


def _bits(letters: Column) -> Column:
    """The coalition of a string of filter letters."""
    bits = [F.when(F.instr(letters, f) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)]
    return bits[0] + bits[1] + bits[2] + bits[3] + bits[4]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, as described in the module."""
    parts = with_potentials(stored(worths(failures(docs, labels, id_col, text_col, part_col)), "worths"))
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("_own", _bits(F.substring("filter_order", F.col("step"), F.lit(1))))
    rows = rows.withColumn("_before", _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    after, everyone = F.col("_before") + F.col("_own"), F.lit(COALITIONS - 1)
    others = everyone - F.col("_own")

    def gain(column: str, to: Column, since: Column) -> Column:
        return F.get(column, to) - F.get(column, since)

    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get("removed", after)).alias("kept"),
        gain("removed", after, F.col("_before")).alias("removed"),
        (F.get("removed", "_own") - gain("removed", after, F.col("_before"))).alias("redundant"),
        gain("removed", everyone, others).alias("unique_fails"),
        gain("good", after, F.col("_before")).alias("good_lost"),
        gain("toxic", after, F.col("_before")).alias("toxic_lost"),
        (gain("potential", everyone, others) * (ORDERS // SCALE)).alias("shapley"))
