"""Exact Jaccard join of word n-gram sets as a join in a metric space.

Texts link when the Jaccard similarity of their shingle sets is at least ``SIMILAR`` per cent, so
when their distance is at most ``1 - SIMILAR / 100``. Texts of equal sets are one node.

1. Regions. Nearly all texts are at distance 1 from any given text, and windows around pivots
   drawn from the texts would then replicate everything into every cell. The pivots of the first
   level are therefore single shingles: a text lies in the regions of its rarest shingles, as
   many as two linked sets must have one in common among. Rareness comes from a sketch of counts
   over all texts; it only orders shingles, so it can't change the result.
2. Within a region a text is the pivot, and the distance to it is measured for every member that
   could be linked to it by size and by place: two sets whose first common shingle is this one have
   no more in common than either has from there on. Members that are linked to the pivot are one
   component, whatever lies between them.
3. Regions with several components left go on without their pivots. Small ones are compared pair
   by pair, where size, place, components and the triangle inequality allow a link: distances to
   the pivot that differ by more than the link distance rule it out. Large ones get several
   pivots, and Voronoi cells: each member goes to the cell of its nearest pivot and, as a
   boundary text, to every cell whose pivot is at most twice the link distance farther. Any two
   linked texts meet in the cell of one of them. The cells go through the same step. Where so
   many texts are boundary texts that cells hold more than before, the region stays whole and
   gets twice as many pivots. Pivots have been compared with all members and drop out, so this
   ends.

Links within a component are not listed; the components are exact.

Edges: null and empty texts have no shingles and link with nothing. A text of fewer than
``WORDS`` words is one shingle. A null id counts for the component's texts but not as its name.
Rows repeated are in one component. An empty table gives no rows. Sets are compared by 64-bit
hashes of their shingles, and nodes named by one of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_bounded, fresh_name, stored
from .ragged import Words, giving_back, packs, resident, windows

WORDS, SIMILAR = 5, 80
# Counters of the sketch, as a power of two: one megabyte from each task.
SKETCH_BITS = 18
_SLICE = 1 << 12
CACHED_WORDS = 1 << 16
# Regions beyond STAR members are first measured against PIVOTS pivots and, in ROUNDS rounds, each
# time twice as many. Up to LEAF members they are then compared pair by pair; larger ones are divided.
STAR, LEAF, PIVOTS, ROUNDS = 64, 4096, 16, 2
# Members of a region that meet as many others in one task.
BLOCK = 256

# Bits of the mark of a set: each shingle turns one over. Marks that differ in many bits come from sets that differ.
# Larger sets have a second mark of as many bits as shingles at least, which comes after the first.
MARK_BITS = 1024
_MARK_WORDS = MARK_BITS // 64

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class Shingler:
    """Sets of hashed word n-grams; each distinct word is hashed once."""

    def __init__(self) -> None:
        self.hashes = np.zeros(1 << 12, np.uint64)
        # A hash is cheap to work out again, so few words are held.
        self.words = Words(self._new, lambda: None, CACHED_WORDS)

    def _new(self, words: list[bytes], first: int) -> None:
        while first + len(words) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[first:first + len(words)] = [xxhash.xxh3_64_intdigest(w) for w in words]

    def _hashed(self, words: list[bytes]) -> np.ndarray:
        numbers = self.words.numbers(words)  # may replace the table of hashes
        return self.hashes[numbers]

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        out = []
        for text in texts:
            parts = [self._hashed(w.lower().split()) for w in windows(text)]
            words = parts[0] if len(parts) == 1 else np.concatenate(parts)
            n = min(WORDS, len(words))
            if not n:
                out.append(words)
                continue
            last = len(words) - n + 1
            mixed = np.full(last, n, np.uint64)
            for i in range(n):
                mixed += words[i:i + last] * _ODD[i]
            mixed ^= mixed >> np.uint64(31)
            mixed *= _ODD[1]
            mixed ^= mixed >> np.uint64(29)
            out.append(np.unique(mixed))
        return out


def _shingler() -> Shingler:
    return resident("shingles", Shingler)


def _node(shingles: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64)) if len(shingles) else None


def _mark(shingles: np.ndarray) -> np.ndarray:
    widths = [MARK_BITS] if len(shingles) <= MARK_BITS else [MARK_BITS, 1 << (len(shingles) - 1).bit_length()]
    odd = [np.bincount((shingles & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1 for w in widths]
    return np.packbits(np.concatenate(odd).astype(bool)).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def nodes_and_counts(texts: DataFrame) -> DataFrame:
    """One pass over the texts: (id, text_hash, n, node, mark) of each, and each task's sketch in rows of slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = _shingler(), np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["id", "text_hash", "n", "node", "mark", "slice", "counts"]
        for batch in batches:
            at = 0
            for some in packs(batch.column(2).to_pylist(), empty=b""):
                sets = shingler.sets(some)
                counts += np.bincount(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), minlength=len(counts))
                m = len(some)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, m), batch.column(1).slice(at, m), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) for s in sets], pa.int64()), pa.array([_mark(s) for s in sets], pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64()))], names=names)
                at += m
        slices = np.flatnonzero(counts.reshape(-1, _SLICE).any(1))
        m = len(slices)
        yield pa.RecordBatch.from_arrays([
            *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.list_(pa.int64())),
            pa.array(slices, pa.int32()), pa.array(list(counts.reshape(-1, _SLICE)[slices]), pa.list_(pa.int64()))], names=names)

    return texts.mapInArrow(giving_back(run), "id bigint, text_hash bigint, n bigint, node bigint, mark array<bigint>, slice int, counts array<bigint>")


def sketch(found: DataFrame) -> np.ndarray:
    """Order of each counter by its count over all texts, 24 bits; as many rows are collected as there are counters."""
    cells = (found.where(F.col("slice").isNotNull()).select("slice", F.posexplode("counts").alias("at", "n"))
             .groupBy((F.col("slice") * _SLICE + F.col("at")).alias("cell")).agg(F.sum("n").alias("n")))
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    table = cells.toArrow()
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return (counts * ((1 << 24) - 1) // max(int(counts.max()), 1)).astype(np.uint64)


def prefixes(texts: DataFrame, order: np.ndarray) -> DataFrame:
    """(region, node, n, rest): each node in the regions of its rarest shingles, once per task at least.

    Of sets of n shingles with similarity s any two share one among their first n - ceil(s n) + 1
    in any order that both follow. Ties at the end are all taken. ``rest`` counts the shingles
    from this one on, ties with it included.
    """
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, order, seen = _shingler(), shared.value, set()
        for batch in batches:
            for some in packs(batch.column(2).to_pylist(), empty=b""):
                regions, nodes, sizes, rests = [], [], [], []
                for s in shingler.sets(some):
                    node = _node(s)
                    if node is None or node in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                    key = order[s >> np.uint64(64 - SKETCH_BITS)] << np.uint64(40) | s & np.uint64((1 << 40) - 1)
                    first = len(s) - -(-SIMILAR * len(s) // 100)
                    chosen = np.flatnonzero(key <= np.partition(key, first)[first])
                    regions.append(s[chosen])
                    rests.append(len(s) - np.searchsorted(np.sort(key[chosen]), key[chosen]))
                    nodes.append(node)
                    sizes.append(len(s))
                if regions:
                    each = [len(r) for r in regions]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(regions).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), each)),
                        pa.array(np.repeat(np.array(sizes, np.int64), each)), pa.array(np.concatenate(rests))], names=["region", "node", "n", "rest"])

    return texts.mapInArrow(giving_back(run), "region bigint, node bigint, n bigint, rest bigint")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in packs(batch.column(2).to_pylist(), empty=b""):
                sets = [s for s in _shingler().sets(some) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(giving_back(run), "node bigint, shingles array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the stored ``links`` (a, b): the smallest node it is connected with.

    Alternating large and small stars: every round hangs neighbours to their smallest neighbour,
    until all hang directly to a root. Hubs are only ever reduced to a minimum.
    """
    edges = links.select("a", "b").where("a <> b")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        edges = stored(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


class _Space:
    """Measured distances between nodes, the links among them, and the components so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, names: DataFrame) -> None:
        self.texts, self.names = _texts(docs, id_col, text_col), names
        self.measured: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.roots: DataFrame | None = None

    def measure(self, pairs: DataFrame, all_distances: bool = False) -> None:
        """Links and distances of the pairs (a < b) that have none yet.

        Where the marks rule a link out (``_marks_allow``, ``_second_marks_allow``) the pair is not
        linked and its distance stays null, unless ``all_distances`` are asked for.
        """
        pairs = pairs.select("a", "b").distinct()
        if self.measured is not None:
            known = self.measured.where("distance is not null") if all_distances else self.measured
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        far = None
        if not all_distances:
            ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            ends = broadcast_if_bounded(stored(ends, "ends"))
            marks = stored(self.names.join(ends, "node", "left_semi").groupBy("node").agg(F.first("mark").alias("mark"), F.first("n").alias("n")), "marks")
            seen = (pairs.join(marks.select(F.col("node").alias("a"), F.col("mark").alias("mark_a"), F.col("n").alias("n_a")), "a")
                    .join(marks.select(F.col("node").alias("b"), F.col("mark").alias("mark_b"), F.col("n").alias("n_b")), "b")
                    .select("a", "b", (_marks_allow("mark_a", "mark_b", "n_a", "n_b") & _second_marks_allow("mark_a", "mark_b", "n_a", "n_b")).alias("close")))
            seen = stored(seen, "seen")
            far = seen.where("not close").select("a", "b", F.lit(False).alias("linked"), F.lit(None).cast("double").alias("distance"))
            pairs = seen.where("close").select("a", "b")
        ends = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
        asked = ends
        if self.sets is not None:
            asked = asked.join(self.sets.select("node"), "node", "left_anti")
        # One text of each node is read again; nothing of the others has been kept.
        one = stored(self.names.join(asked, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct(), "asked")
        if one.limit(1).count():
            texts = self.texts.join(broadcast_if_bounded(one), "text_hash", "left_semi").select("id", "text_hash", "text")
            sets = stored(shingle_sets(texts).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
            self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        if self.sets is None:
            if far is not None:
                self.measured = far if self.measured is None else self.measured.unionByName(far)
            return
        # Sets are by far the widest rows; only those of this round's pairs are dealt out.
        sets = self.sets.join(broadcast_if_bounded(ends), "node", "left_semi")
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        done = (pairs.join(b, "b").join(a, "a")
                .select("a", "b", common.cast("bigint").alias("common"), (F.size("of_a") + F.size("of_b") - common).cast("bigint").alias("all")))
        done = stored(done.select("a", "b", (100 * F.col("common") >= SIMILAR * F.col("all")).alias("linked"),
                                  (1 - F.col("common") / F.col("all")).alias("distance")), "measured")
        for part in (done, far):
            if part is not None:
                self.measured = part if self.measured is None else self.measured.unionByName(part)
        if done.where("linked").limit(1).count():
            self.roots = components(stored(self.measured.where("linked"), "links"))

    def with_marks(self, nodes: DataFrame) -> DataFrame:
        first = F.slice("mark", 1, _MARK_WORDS).alias("mark")
        return nodes.join(self.names.select("node", first).groupBy("node").agg(F.first("mark").alias("mark")), "node")

    def with_roots(self, nodes: DataFrame) -> DataFrame:
        if self.roots is None:
            return nodes.withColumn("root", F.col("node"))
        return nodes.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _blocks(members: DataFrame, own: str, other: str) -> DataFrame:
    """Members in blocks of about ``BLOCK`` by a hash, once for every block they are held against, so no region is one task."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return (members.withColumn(own, F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), blocks - 1))))


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _may_link(n: str, m: str, rest: str, other: str):
    """By their sizes, and by how much they have from the common shingle on, which is the most they share."""
    least = F.least(rest, other)
    return (100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & (100 * least >= SIMILAR * (F.col(n) + F.col(m) - least))


def _marks_allow(x: str, y: str, n: str, m: str):
    """By marks: each bit in which two differ stands for a shingle that one set has alone."""
    return _few(sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(_MARK_WORDS)), n, m)


def _few(differ, n: str, m: str):
    # s (n + m + d) <= n + m - d for d shingles in one set only and similarity s.
    return differ * (100 + SIMILAR) <= (100 - SIMILAR) * (F.col(n) + F.col(m))


def _second_marks_allow(x: str, y: str, n: str, m: str):
    """The same by second marks, where both sets have one. Of two widths the larger is folded: what its halves share cancels out."""
    words = F.least(F.size(x), F.size(y)) - _MARK_WORDS

    def folded(mark):
        low, high = F.slice(mark, _MARK_WORDS + 1, words), F.slice(mark, words + _MARK_WORDS + 1, words)
        return F.when(F.size(mark) - _MARK_WORDS > words, F.zip_with(low, high, lambda p, q: p.bitwiseXOR(q))).otherwise(low)

    differ = F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    # Sets whose widths are further apart than one step are not asked: their sizes rule them out elsewhere.
    usable = (words > 0) & (F.greatest(F.size(x), F.size(y)) - _MARK_WORDS <= 2 * words)
    return F.when(usable, _few(differ, n, m)).otherwise(F.lit(True))


def resolve(space: _Space, regions: DataFrame) -> None:
    """Compare the members (region, node, n, rest, distance) of stored regions until each is one
    component or has no pair left. ``distance`` is that to a former pivot, if it was measured."""
    reach, slack = 1 - SIMILAR / 100, 1e-9
    level = 0
    while True:
        members = space.with_roots(regions)
        state = (members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
                 .where("low < high").select("region", "size"))
        open_members = members.join(broadcast_if_bounded(stored(state, "open")), "region")
        open_members = stored(space.with_marks(open_members), "open-regions")
        if not open_members.limit(1).count():
            return
        # First all but the smallest regions are measured against some pivots, which joins most of
        # what belongs together; then only pairs of different components are left to compare.
        leaf = LEAF if level >= ROUNDS else STAR
        small, large = open_members.where(F.col("size") <= leaf), open_members.where(F.col("size") > leaf)
        # Only what none of these conditions rules out becomes a pair.
        x, y = _blocks(small, "i", "j").alias("x"), _blocks(small, "j", "i").alias("y")
        near_enough = F.abs(F.col("x.distance") - F.col("y.distance")) <= reach + slack
        pairs = (x.join(y, (F.col("x.region") == F.col("y.region")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
                        & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
                        & _may_link("x.n", "y.n", "x.rest", "y.rest") & F.coalesce(near_enough, F.lit(True))
                        & _marks_allow("x.mark", "y.mark", "x.n", "y.n"))
                 .select(*_pair("x.node", "y.node")))
        # Pivots come from as many components as there are: what is connected needs no comparing.
        one = F.struct(F.xxhash64("node", F.lit(level)).alias("at"), "node", "n", "rest", "mark")
        each = large.groupBy("region", "root").agg(F.min(one).alias("one")).select("region", F.col("root").alias("pivot_root"), "one.*")
        rank = Window.partitionBy("region").orderBy("at", "node")
        pivots = each.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= PIVOTS << level)
        pivots = stored(pivots.select("region", "pivot_root", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("rest").alias("pivot_rest"),
                                      F.col("mark").alias("pivot_mark")), "pivots")
        to_pivot = large.join(broadcast_if_bounded(pivots), "region").where("node <> pivot")
        if level < ROUNDS:
            possible = (F.col("root") != F.col("pivot_root")) & _may_link("n", "m", "rest", "pivot_rest") & _marks_allow("mark", "pivot_mark", "n", "m")
            space.measure(pairs.unionByName(to_pivot.where(possible).select(*_pair("node", "pivot"))))
            regions = stored(large.select("region", "node", "n", "rest", "distance")
                             .join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti"), "regions")
            level += 1
            continue
        space.measure(pairs)
        if pivots.limit(1).count():
            space.measure(to_pivot.select(*_pair("node", "pivot")), all_distances=True)
        if not pivots.limit(1).count():
            return
        rest = (to_pivot.join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti")
                .select("region", "node", "n", "rest", "size", "pivot", *_pair("node", "pivot"))
                .join(space.measured.where("distance is not null").drop("linked"), ["a", "b"]))
        home = F.min("distance").over(Window.partitionBy("region", "node"))
        cells = stored(rest.withColumn("home", home).where(F.col("distance") <= F.col("home") + 2 * reach + slack), "cells")
        divided = cells.groupBy("region").agg((F.count(F.lit(1)) <= F.first("size")).alias("divided"))
        cells = cells.join(divided, "region")
        whole = cells.where("not divided").groupBy("region", "node").agg(
            F.first("n").alias("n"), F.first("rest").alias("rest"), F.lit(None).cast("double").alias("distance"))
        regions = stored(cells.where("divided").select(F.xxhash64("region", "pivot").alias("region"), "node", "n", "rest", "distance").unionByName(whole), "regions")
        level += 1


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` per row; ``component_id`` is the smallest id of its component."""
    texts = _texts(docs, id_col, text_col)
    found = stored(nodes_and_counts(texts), "nodes")
    rows = found.where(F.col("slice").isNull()).select("id", "text_hash", "n", "node", "mark")
    # One shuffle by region; the windows use its partitioning. A node comes at most once per task.
    placed = prefixes(texts, sketch(found)).repartition("region").distinct()
    within = Window.partitionBy("region")
    placed = (placed.withColumn("pivot", F.min(F.struct("node", "n", "rest")).over(within)).withColumn("size", F.count(F.lit(1)).over(within))
              .where("size > 1").select("region", "node", "n", "rest", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("m"),
                                        F.col("pivot.rest").alias("pivot_rest"), "size"))
    placed = stored(placed.where("node <> pivot"), "regions")
    space = _Space(docs, id_col, text_col, rows.where("node is not null"))
    possible = _may_link("n", "m", "rest", "pivot_rest")
    # Regions of three and more go on; of those with the same members one is kept, with the most each has left.
    several = placed.where("size > 2")
    same = several.groupBy("region").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.first("pivot").alias("pivot"), F.first("size").alias("size"))
    alike = same.withColumn("kept", F.min("region").over(Window.partitionBy("members", "pivot", "size"))).select("region", "kept")
    several = several.join(alike, "region").groupBy(F.col("kept").alias("region"), "node", "pivot").agg(F.first("n").alias("n"), F.max("rest").alias("rest"))
    several = stored(several, "larger-regions")
    space.measure(placed.where(possible).select(*_pair("node", "pivot")))
    members = several.select("region", "node", "n", "rest", *_pair("node", "pivot"))
    if space.measured is None:
        return _named(space, rows)
    members = members.join(space.measured.drop("linked"), ["a", "b"], "left")
    resolve(space, stored(members.select("region", "node", "n", "rest", "distance"), "members"))
    return _named(space, rows)


def _named(space: _Space, rows: DataFrame) -> DataFrame:
    some = rows.where("node is not null")
    if space.roots is not None:
        some = some.join(broadcast_if_bounded(space.roots), "node", "left")
    else:
        some = some.withColumn("root", F.lit(None).cast("bigint"))
    some = some.withColumn("root", F.coalesce("root", "node"))
    least = some.groupBy("root").agg(F.min("id").alias("component_id"))
    named = some.join(least, "root").select("id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(rows.where("node is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component, that of the smallest id; a null id is the largest.

    Rows are told apart by number, so repeated and missing ids do no harm.
    """
    row = fresh_name([*docs.columns, "id", "component_id"], "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = join(numbered, row, text_col).select(F.col("id").alias(row), "component_id")
    ids = numbered.select(row, F.col(f"`{id_col}`").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("at"))
    with_ids = stored(found.join(ids, row).select("component_id", "id", row), "found")
    kept = with_ids.groupBy("component_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    dropped = with_ids.join(kept, "component_id").where(F.col(row) != F.col("first.at")).select(row)
    return numbered.join(broadcast_if_bounded(stored(dropped, "dropped")), row, "left_anti").drop(row)
