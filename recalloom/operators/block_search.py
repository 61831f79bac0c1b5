"""Keyword search that leaves out blocks of chunks by bounds on their scores.

Postings are kept in blocks of chunks, and for every token and block the largest weight. For a
question the largest weights of its tokens bound the score of every chunk of a block. A first pass
scores the few blocks of the highest bounds; the ``k``-th best score found there is a floor. A second
pass scores the blocks whose bound reaches the floor; all others cannot hold a chunk of the list.
The result is that of scoring everything. What grows with questions times chunks is divided by the
size of a block, and only blocks in question have their postings read.

Chunks come into one block that share their heaviest token, so that the bounds of different blocks
differ; a block is never larger than twice ``BLOCK_CHUNKS`` on the average, however many chunks share one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..scale import broadcast_if_small, staged, top_k

BLOCK_CHUNKS = 128
# Blocks per question that are scored to find the floor.
SEED_BLOCKS = 4
# Scores are rounded before they are ranked, so a chunk may rank above its exact score by half a unit.
SLACK = 10.0 ** -config.SCORE_DECIMALS


@dataclass(frozen=True)
class BlockIndex:
    """``postings``: by..., token, block, chunk_id, weight; ``maxima``: by..., token, block, top, n."""

    postings: DataFrame
    maxima: DataFrame
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class BlockHits:
    """``hits``: by..., query_id, chunk_id, score, rank; ``blocks``: by..., query_id, block, bound, n, scored."""

    hits: DataFrame
    blocks: DataFrame


def assign_blocks(weights: DataFrame, by: Sequence[str] = (), size: int = BLOCK_CHUNKS) -> DataFrame:
    """``by..., chunk_id, block`` for the chunks of ``weights`` (by..., chunk_id, token, weight).

    As many cells as blocks are wanted are filled by the hash of a chunk's heaviest token; a cell
    that holds more than two blocks is divided by the hash of the chunk.
    """
    heavy = staged(weights.groupBy(*by, "chunk_id").agg(F.max_by("token", F.struct("weight", "token")).alias("_heavy")), "heaviest")
    cells = max(1, -(-heavy.count() // size))
    placed = heavy.withColumn("_cell", F.pmod(F.xxhash64("_heavy"), F.lit(cells)))
    counted = placed.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).alias("_parts"))
    placed = placed.join(broadcast_if_small(counted), [*by, "_cell"])
    part = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.col("_parts"))
    return placed.select(*by, "chunk_id", F.xxhash64("_cell", part).alias("block"))


def block_maxima(postings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The largest weight and the number of postings of every token and block."""
    return postings.groupBy(*by, "token", "block").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))


def build_blocks(weights: DataFrame, by: Sequence[str] = (), size: int = BLOCK_CHUNKS) -> BlockIndex:
    """Arrange weighted postings in blocks; both tables are written."""
    weights = staged(weights.select(*by, "chunk_id", "token", "weight"), "weights")
    blocks = staged(assign_blocks(weights, by, size), "chunk-blocks")
    postings = staged(weights.join(blocks, [*by, "chunk_id"]).select(*by, "token", "block", "chunk_id", "weight"), "block-postings")
    return BlockIndex(postings, staged(block_maxima(postings, by), "block-maxima"), tuple(by))


def _scores(index: BlockIndex, chosen: DataFrame, terms: DataFrame) -> DataFrame:
    """Scores of all chunks in the chosen blocks (by..., query_id, block)."""
    by = list(index.by)
    wanted = (chosen.select(*by, "query_id", "block").join(terms, "query_id")
              .join(index.maxima.select(*by, "token", "block"), [*by, "token", "block"]))
    found = index.postings.join(broadcast_if_small(staged(wanted, "wanted")), [*by, "token", "block"])
    return found.groupBy(*by, "chunk_id", "query_id").agg(
        F.round(F.sum(F.col("qw") * F.col("weight")), config.SCORE_DECIMALS).alias("score"))


def search_blocks(index: BlockIndex, terms: DataFrame, k: int = config.TOP_K, seeds: int = SEED_BLOCKS) -> BlockHits:
    """The ``k`` best chunks for every question of ``terms`` (query_id, token, qw), as scoring all of them gives."""
    by = list(index.by)
    query, best = [*by, "query_id"], [F.desc("score"), F.asc("chunk_id")]
    terms = broadcast_if_small(staged(terms.select("query_id", "token", "qw"), "terms"))
    bounds = index.maxima.join(terms, "token").groupBy(*query, "block").agg(
        F.sum(F.col("qw") * F.col("top")).alias("bound"), F.sum("n").alias("n"))
    bounds = staged(top_k(bounds, query, [F.desc("bound"), F.asc("block")], None, "_place"), "bounds")
    first = staged(top_k(_scores(index, bounds.where(F.col("_place") <= seeds), terms), query, best, k), "first-hits")
    # A question without k hits so far has no floor, and all its blocks are scored.
    floor = first.where(F.col("rank") == k).select(*query, F.col("score").alias("floor"))
    judged = bounds.join(broadcast_if_small(floor), query, "left").withColumn(
        "scored", (F.col("_place") <= seeds) | F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    judged = staged(judged.select(*query, "block", "bound", "n", "_place", "scored"), "judged-blocks")
    second = _scores(index, judged.where(F.col("scored") & (F.col("_place") > seeds)), terms)
    hits = top_k(first.drop("rank").unionByName(second.select(*first.drop("rank").columns)), query, best, k)
    return BlockHits(hits.select(*query, "chunk_id", "score", "rank"), judged.drop("_place"))


def blocks_read(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per question: blocks with any of its tokens and those scored; postings there are and those read."""
    scored = F.col("scored")
    return blocks.groupBy(*by, "query_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(scored).alias("blocks_scored"), F.sum("n").alias("postings"),
        F.sum(F.when(scored, F.col("n")).otherwise(F.lit(0))).alias("postings_read"))
