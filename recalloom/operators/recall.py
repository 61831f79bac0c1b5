"""Recall of retrieved texts against gold answers and reference files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.coverage import coverage, verbatim_coverage
from ..functions.text import file_match, keep_charset, normalise_file_ref
from ..scale import broadcast_if_small, is_small
from ..session import checkpoint_dir

RUN = ("pipeline", "top_k")


def _spread_work(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows over all shuffle partitions. Alignment costs far more than the bytes it
    reads suggest, and a fixed number keeps adaptive execution from merging small ones."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _with_coverage(hits: DataFrame, run: list[str], charset: str, measure: str,
                   threshold: float, autojunk: bool) -> DataFrame:
    """Add ``coverage``. The costly measure is taken once per question and text, however
    many runs return that text; a group holds one entry per run."""
    if measure == "verbatim":
        return hits.withColumn("coverage", verbatim_coverage(
            F.col("gold_answer"), F.col("content_text")))
    # By the text itself: indexes of different chunkers give the same id to different texts.
    pair = ["query_id", "_text"]
    fixed = ["content_text", "gold_answer", "_ref"]
    per_run = F.struct(*run, "rank", "chunk_id", "source", *[c for c in ("score",) if c in hits.columns])
    once = _spread_work(hits.withColumn("_text", F.sha2("content_text", 256)), pair).groupBy(*pair).agg(
        *[F.first(c).alias(c) for c in fixed], F.collect_list(per_run).alias("_runs"))
    measured = once.withColumn("coverage", coverage(
        keep_charset(F.col("gold_answer"), charset), keep_charset(F.col("content_text"), charset),
        autojunk, threshold))
    return measured.select(*pair, *fixed, "coverage", F.explode("_runs").alias("_r")).select(
        "query_id", *fixed, "coverage", "_r.*")


def first_hit(flag: Column, rank: Column) -> Column:
    """Rank of the first row with ``flag``, 0 when there is none."""
    return F.coalesce(F.min(F.when(flag, rank)), F.lit(0))


def question_recall(hits: DataFrame, test_set: DataFrame, run: Sequence[str] = RUN,
                    threshold: float = config.COVERAGE_THRESHOLD, charset: str = "cjk",
                    measure: str = "blocks", autojunk: bool = True, concat: bool = True,
                    runs: DataFrame | None = None, aliases=(), with_score: bool = False) -> DataFrame:
    """Single, merged, concatenated and file recall for every run and question.

    ``hits``: ``run..., query_id, rank, chunk_id, content_text, source``;
    ``test_set``: ``query_id, gold_answer, ref_file``, or the array ``ref_files`` of
    :func:`with_reference_files`, any of which may match. Single and merged recall are the
    same flag (some text reaches the threshold), so coverage is measured once; only the
    single one has a position. ``runs`` lists the runs so that a question without any hit
    counts as a miss. ``with_score`` adds ``top_score``, the best score of each list.
    """
    run = list(run)
    scored = ["score"] if with_score else []
    several = "ref_files" in test_set.columns
    ref = F.col("ref_files") if several else normalise_file_ref(F.coalesce("ref_file", F.lit("")))
    gold = test_set.select("query_id", "gold_answer", ref.alias("_ref"))
    if is_small(test_set):
        gold = F.broadcast(gold)
    judged = hits.select(*run, "query_id", "rank", "chunk_id", "content_text", "source",
                         *scored).join(
        gold, "query_id")
    marked = (_with_coverage(judged, run, charset, measure, threshold, autojunk)
              .withColumn("_src", normalise_file_ref(F.coalesce("source", F.lit(""))))
              .withColumn("_ok", F.col("coverage") >= threshold)
              .withColumn("_file", F.exists("_ref", lambda r: file_match(r, F.col("_src"), list(aliases)))
                          if several else file_match(F.col("_ref"), F.col("_src"), list(aliases))))
    # A group is one result list, at most top_k texts long.
    listed = F.array_sort(F.collect_list(F.struct("rank", "content_text")))
    joined = F.array_join(F.transform(listed, lambda h: keep_charset(h["content_text"], charset)), "")
    if concat:
        marked = _spread_work(marked, [*run, "query_id"])
    per_q = marked.groupBy(*run, "query_id").agg(
        first_hit(F.col("_ok"), F.col("rank")).alias("hit_rank"),
        first_hit(F.col("_file"), F.col("rank")).alias("file_rank"),
        *([F.max("score").alias("top_score")] if with_score else []),
        *([joined.alias("_all"), F.first("gold_answer").alias("_gold")] if concat else []))
    flags = per_q.withColumn("single", (F.col("hit_rank") > 0).cast("int")).withColumn(
        "file", (F.col("file_rank") > 0).cast("int")).withColumn("merged", F.col("single"))
    if concat:
        whole = coverage(keep_charset(F.col("_gold"), charset), F.col("_all"), False, threshold)
        flags = flags.withColumn("concat", (whole >= threshold).cast("int")).drop("_all", "_gold")
    if runs is None:
        return flags
    # One row per run and question: both come from the experiment's own small lists.
    grid = test_set.select("query_id", F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(run, row)])
        for row in runs.select(*run).collect()])).alias("_r")).select("query_id", "_r.*")
    names = [c for c in flags.columns if c not in (*run, "query_id")]
    return grid.join(flags, [*run, "query_id"], "left").fillna(0, subset=names)


def with_reference_files(items: DataFrame, docs: DataFrame, anchor_words: int = 5) -> DataFrame:
    """``items`` with ``ref_files``: the normalised sources of all documents that hold ``gold_answer``.

    ``items``: ``query_id, gold_answer, ...``; ``docs``: ``text, source``. Words that stand between
    white space inside an item are words of every text that holds it, so documents are looked up by
    the hash of ``anchor_words`` of them and then searched for the whole item. An item too short for
    that is searched for in every document. Items that no document holds keep an empty array.
    """
    def words(text: str) -> Column:
        return F.split(F.col(text), r"\s+")

    inner = F.col("_words")
    gold = items.select("query_id", F.col("gold_answer").alias("_gold"), words("gold_answer").alias("_words")).where(
        "_gold is not null").withColumn("_anchor", F.when(
            F.size(inner) >= anchor_words + 2, F.xxhash64(*[F.get(inner, F.lit(1 + i)) for i in range(anchor_words)]))).drop("_words")
    texts = docs.where("text is not null").select("text", "source", F.xxhash64("text").alias("_key"))
    cut = texts.select("_key", words("text").alias("_words")).where(F.size("_words") >= anchor_words)
    runs = F.transform(F.sequence(F.lit(0), F.size("_words") - anchor_words),
                       lambda i: F.xxhash64(*[F.get(inner, i + j) for j in range(anchor_words)]))
    anchors = broadcast_if_small(gold.where("_anchor is not null"))
    found = cut.select("_key", F.explode(runs).alias("_anchor")).join(anchors, "_anchor").select(
        "_key", "query_id", "_gold").distinct()
    # Written, so that its size is known and the texts need not be cut twice.
    path = f"{checkpoint_dir(docs.sparkSession)}/anchored-{uuid.uuid4().hex}"
    found.write.parquet(path)
    found = broadcast_if_small(docs.sparkSession.read.schema(found.schema).parquet(path))
    holds = F.contains("text", "_gold")
    hits = texts.join(found, "_key").where(holds).select("query_id", "source").unionByName(
        texts.join(broadcast_if_small(gold.where("_anchor is null")), holds).select("query_id", "source"))
    files = hits.distinct().select("query_id", normalise_file_ref(F.coalesce("source", F.lit(""))).alias("_file"))
    files = files.where("_file <> ''").groupBy("query_id").agg(F.array_sort(F.collect_set("_file")).alias("ref_files"))
    return items.join(files, "query_id", "left").withColumn(
        "ref_files", F.coalesce("ref_files", F.array().cast("array<string>")))


def rollup(recall: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Rates in percent and the mean position of the hits, per run."""
    have = [c for c in ("single", "merged", "concat", "file") if c in recall.columns]
    return recall.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_questions"),
        *[F.round(F.avg(c) * 100, config.SCORE_DECIMALS).alias(f"{c}_rate") for c in have],
        F.coalesce(F.round(F.avg(F.when(F.col("single") == 1, F.col("hit_rank"))),
                           config.SCORE_DECIMALS), F.lit(0.0)).alias("avg_hit_rank"))


def cut_at(hits: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One search at the largest k, seen at every smaller k. Not for hybrid lists, whose
    candidates depend on k."""
    every = F.explode(F.array(*[F.lit(k) for k in ks])).alias("top_k")
    return hits.select("*", every).where(F.col("rank") <= F.col("top_k"))


def group_delta(rates: DataFrame, groups: Sequence[str] = ("MQ", "direct"),
                by: Sequence[str] = ("chunker", "top_k"),
                metrics: Sequence[str] = ("single_rate", "merged_rate", "concat_rate", "file_rate",
                                          "avg_hit_rank")) -> DataFrame:
    """Two groups side by side with the differences of content and file recall."""
    have = [m for m in metrics if m in rates.columns]
    wide = rates.groupBy(*by).pivot("group", list(groups)).agg(
        *[F.first(m).alias(m) for m in have], *([F.first(F.lit(1)).alias("_")]
                                               if len(have) == 1 else []))
    a, b = groups
    return wide.select(
        *by, *[F.col(f"`{g}_{m}`") for g in groups for m in have],
        *[F.round(F.col(f"`{a}_{m}`") - F.col(f"`{b}_{m}`"), config.SCORE_DECIMALS)
          .alias(f"{m}_delta") for m in ("single_rate", "file_rate") if m in have])


def effects(recall: DataFrame, split: str = "section_mode", meta: str = "with_meta",
            flag: str = "single") -> DataFrame:
    """Rates of a 2x2 study and its pairwise differences, in percentage points."""
    def rate(mode, m):
        cell = (F.col(split) == mode) & (F.col(meta) == m)
        return F.avg(F.when(cell, F.col(flag))) * 100

    cells = recall.agg(rate("presplit", True).alias("presplit_meta"),
                       rate("presplit", False).alias("presplit_pure"),
                       rate("raw", True).alias("raw_meta"), rate("raw", False).alias("raw_pure"))
    diff = {"split_effect_meta": ("raw_meta", "presplit_meta"),
            "split_effect_pure": ("raw_pure", "presplit_pure"),
            "meta_effect_presplit": ("presplit_meta", "presplit_pure"),
            "meta_effect_raw": ("raw_meta", "raw_pure")}
    return cells.select(
        *[F.round(c, config.SCORE_DECIMALS).alias(c) for c in cells.columns],
        *[F.round(F.col(a) - F.col(b), config.SCORE_DECIMALS).alias(n)
          for n, (a, b) in diff.items()])
