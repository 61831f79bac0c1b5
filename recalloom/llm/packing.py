"""Packing of token sequences: best fit decreasing, certified by lower bounds, repacked where they differ.

Texts are tokenised, cut into pieces of at most ``capacity`` ids, and dealt evenly into groups.
Each group is packed by best fit decreasing, and dual-feasible functions give a lower bound on
its number of bins. A group whose count meets its bound is certified. The others release their
emptiest bins; the pieces of these are exchanged between groups and packed again, and the new
arrangement replaces the old one if it needs fewer bins.

Edges: null text is an empty document, of which only its end id is packed. A null id is carried
along. Rows repeated are packed each by itself. An empty table gives no rows. Extra columns play
no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import stored
from .ragged import WINDOW_CHARS, Rows, Words, giving_back, packs, resident, windows

# Pieces of a group: what one task packs, the same at every size of the table.
GROUP_PIECES = 40_000
# Words, and parts of words, whose ids a worker holds where nothing else asks for its memory.
CACHED_WORDS = 500_000
# Exchanges at most; each needs fewer pieces than the one before.
MAX_ROUNDS = 3


def steps_of(source: str) -> dict:
    """A tokenizers file without its vocabulary, which is by far most of it."""
    return {k: v for k, v in json.loads(source).items() if k != "model"}


class FastTokenizer:
    """Ids of a tokenizers file; where words stand for themselves, each distinct one is encoded once.

    That holds for a file that composes, lower-cases, and cuts by one pattern that drops white
    space: the ids of a text are those of its words one after another. Words of Latin letters are
    cut here, where composing changes nothing, and their parts given to the library's model;
    other words go through the whole tokenizer, as do texts with special tokens or with
    characters that only Python takes for white space, and all texts of any other kind of file.
    """

    _PYTHON_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, source: str, spec: dict | None = None, cached_words: int = CACHED_WORDS) -> None:
        """``spec``: what ``steps_of`` gives for ``source``, where it is known already."""
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = spec or steps_of(source)
        self.marks = (*self._PYTHON_SPACE, *(t["content"] for t in spec["added_tokens"]))
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
                        and cuts[0].get("invert") and cuts[0]["behavior"] == "Removed" and spec["post_processor"] is None)
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"]) if self.by_word else None
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.model = self.tokenizer.model
        self.ids, self.part_ids = Rows(np.uint32), Rows(np.uint32)
        self.words = Words(self._new_words, self.ids.clear, cached_words)
        self.parts = Words(self._new_parts, self.part_ids.clear, cached_words)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new_parts(self, parts: list[str], first: int) -> None:
        """Ids of lower-case parts of Latin letters by the model alone, of other words by all steps."""
        tokenize, letters = self.model.tokenize, self.letters
        # Printable ASCII stands for itself.
        ids = [[t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))]
               if p.isascii() or max(p) < "\u0100" else self.whole(p) for p in parts]
        self.part_ids.extend(np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _new_words(self, words: list[str], first: int) -> None:
        cut = self.pattern.findall
        parts = [cut(w.lower()) if w.isascii() or max(w) < "\u0100" else [w] for w in words]
        ids, ends = self.part_ids.gather(self.parts.numbers([p for x in parts for p in x]))
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])]
        self.ids.extend(ids, np.diff(ends))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        split: list[list[str]] = []
        out: list[np.ndarray | None] = []
        for text in texts:
            long = len(text) > 2 * WINDOW_CHARS
            if not self.by_word or any(m in text for m in self.marks):
                out.append(np.array(self.whole(text), np.uint32))
            elif long:
                out.append(np.concatenate([self.ids.gather(self.words.numbers(w.split()))[0] for w in windows(text)]))
            else:
                out.append(None)
            split.append(text.split() if out[-1] is None else [])
        ids, ends = self.ids.gather(self.words.numbers([w for words in split for w in words]))
        ends, at = np.concatenate([[0], ends]), 0
        for i, words in enumerate(split):
            if out[i] is None:
                out[i] = ids[ends[at]:ends[at + len(words)]]
            at += len(words)
        return out


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
             cached_words: int = CACHED_WORDS) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit ids in one binary, the end id last."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((source, steps_of(source)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = resident(("tokenizer", hash(shared.value[0]), cached_words), lambda: FastTokenizer(*shared.value, cached_words))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at = 0
            for texts in packs(batch.column(1).to_pylist()):
                ids = [x.astype("<u4").tobytes() + end for x in tokenizer.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                at += len(texts)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(giving_back(run), "doc_id bigint, ids binary")


def cut(tokens: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids``: documents cut only where they are longer than ``capacity``."""
    n = F.floor((F.octet_length("ids") / 4 - 1) / capacity).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring("ids", i * (4 * capacity) + 1, F.lit(4 * capacity)))
    return (tokens.select("doc_id", F.posexplode(parts).alias("piece", "ids"))
            .select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"),
                    (F.octet_length("ids") / 4).cast("bigint").alias("length"), "ids"))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, by best fit decreasing."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, count = 0, 0  # free: bit r is set where some bin has exactly r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                free ^= 1 << left
        else:
            left, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - left
        open_bins[left - size].append(b)
        if left > size:
            free |= 1 << (left - size)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that sizes 1..``capacity`` (``counts[size]`` of each) need at least.

    The largest sum over dual-feasible functions: sizes up to e as nothing and those beyond
    ``capacity`` - e as a whole bin, the rest rounded to k-ths; and sizes in whole steps of e. Sums
    are kept in whole numbers so that rounding can't raise the bound.
    """
    x, n = np.arange(capacity + 1, dtype=np.int64), counts.astype(np.int64)
    best = -(-int((n * x).sum()) // capacity)
    e = np.arange(0, capacity // 2 + 1)
    above = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])  # above[s]: how many of size s or more
    for k in range(1, 33):
        # u(x) = x where (k + 1) x is whole, else floor((k + 1) x) / k; in units of 1 / (k capacity).
        u = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        within = np.concatenate([[0], np.cumsum(n * u)])
        total = within[capacity - e + 1] - within[e] + above[capacity - e + 1] * k * capacity
        best = max(best, -(-int(total.max()) // (k * capacity)))
    for e in range(1, capacity // 2 + 1):
        steps = capacity // e
        phi = np.where(2 * x < capacity, 2 * (x // e), np.where(2 * x > capacity, 2 * (steps - (capacity - x) // e), steps))
        best = max(best, -(-int((n * phi).sum()) // (2 * steps)))
    return best


def _packed(table: pa.Table, capacity: int, schema: pa.Schema) -> pa.Table:
    sizes = table["length"].to_numpy()
    bins, offsets = best_fit(sizes, capacity)
    used = int(bins.max()) + 1
    fill = np.bincount(bins, weights=sizes, minlength=used).astype(np.int64)
    gap = used - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    # Of a group with a gap, the emptiest bins are given up: enough for the gap to close twice over.
    emptiest = np.argsort(fill, kind="stable")
    waste = np.cumsum(capacity - fill[emptiest])
    give = np.zeros(used, bool)
    if gap > 0:
        give[emptiest[:int(np.searchsorted(waste, 2 * gap * capacity)) + 1]] = True
        give &= fill < capacity
    for name, values in (("bin", bins), ("offset", offsets), ("gap", np.full(len(sizes), gap)), ("given", give[bins])):
        table = table.append_column(name, pa.array(values))
    return table.select(schema.names).cast(schema)


def _in_groups(pieces: DataFrame, groups: int, capacity: int, round_no: int) -> DataFrame:
    """One packing of ``pieces``; a bin is named by round, group and number."""
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("place", F.lit(round_no)), F.lit(groups)))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = [*dealt.dtypes, ("bin", "bigint"), ("offset", "bigint"), ("gap", "bigint"), ("given", "boolean")]
    arrow = pa.schema([(name, kinds[kind]) for name, kind in columns])
    packed = dealt.groupBy("group").applyInArrow(lambda t: _packed(t, capacity, arrow), ", ".join(f"{c} {t}" for c, t in columns))
    name = F.lit(round_no << 58) + F.shiftleft(F.col("group"), 20) + F.col("bin")
    return packed.withColumn("sequence_id", name).drop("bin", "group")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (whole-number columns, with ``length``) with ``sequence_id`` and ``offset``.

    Groups are dealt evenly by row number, so no key can make one large.
    """
    pieces = stored(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    n = pieces.count()
    packed = stored(_in_groups(pieces, -(-n // GROUP_PIECES) or 1, capacity, 0), "packed")
    done = []
    for round_no in range(1, MAX_ROUNDS + 1):
        pool = packed.where("given")
        n, bins = pool.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not n:
            break
        again = stored(_in_groups(pool.select(*pieces.columns), -(-n // GROUP_PIECES), capacity, round_no), "repacked")
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= bins:
            break
        done.append(packed.where("not given"))
        packed = again
    for part in done:
        packed = packed.unionByName(part)
    return packed.select(*[c for c in pieces.columns if c != "place"], "sequence_id", "offset", "gap")


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """(bins used, bins needed at least) of a whole packing; only a count per length is collected."""
    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    return used, lower_bound(counts, capacity)
