"""Repair of role sequences by Four-Russians block tables.

A conversation is a sequence of rows in order of turn. Its cheapest repair is a shortest path
through rows and states, a state being what the repaired roles so far end in. The costs to go from
all states before a row form a vector; less its least entry it is one of a small, closed set of
vectors. For every such vector and every block of ``BLOCK`` symbols a table, worked out once, holds
the vector before the block and what was taken off. Blocks are looked up from the right end to the
left; then the path is traced from the left, each block being expanded backward into the vectors of
its rows, so that of all cheapest edits the least in ASCII order is taken at every step.

Rows are sorted by range, so a conversation of any length spreads over tasks. Conversations that
lie in one task are finished there. Of the others each task passes on segments of at most
``SEGMENT_ROWS`` rows with their 4 x 4 table of costs; these are chained per conversation (a
conversation's audit is one string, so it has at most 2^31 rows and 2^19 segments), traced
segment by segment, and the repaired text is hashed as a stream.

Edges: a null conv_id is a conversation of its own; null turns come first and count for no gap;
null role and text stand as one blank. Rows of one turn are taken by role, then text. Equal rows are
counted, not repeated, until their edits are written. Without rows a conversation has zeros, an
empty audit and the hash of the empty string; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BROADCAST_BYTES, fresh_name, payload_bytes, stored

SEGMENT_ROWS = 4096
SEGMENT_CHARS = 1 << 20
BLOCK = 4

# States: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
# The state that an inserted or changed role leads to: u, and a after u.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
# The state that a kept role leads to.
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
# Symbols: 0 must go; else 1 + 2 * place of the initial in KINDS + truncated.
KINDS = "sua?"
SYMBOLS = 1 + 2 * len(KINDS)
FAR = 1 << 40
_SPACES = " \t\n\x0b\x0c\r"


def _with_inserts(h: list[int]) -> tuple[int, ...]:
    """Costs to go when rows may also be inserted first."""
    u, a = min(h[AFTER_U], INSERT + h[AFTER_A]), min(h[AFTER_A], INSERT + h[AFTER_U])
    return tuple(min(x, FAR) for x in (min(h[START], INSERT + u), min(h[AFTER_S], INSERT + u), u, a))


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of the edits that use up a row, in ASCII order."""
    moves = [("D", DELETE, state)]
    if symbol:
        kind, truncated = KINDS[(symbol - 1) >> 1], TRUNCATED * ((symbol - 1) & 1)
        if (state, kind) in KEPT:
            moves.append(("K", truncated, KEPT[state, kind]))
        moves.append(("R", REROLE + truncated, NEXT[state]))
    return moves


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return _with_inserts([min(cost + after[to] for _, cost, to in _moves(symbol, q)) for q in range(STATES)])


# Costs to go after the last row: nothing, or s? and pairs of u and a.
END = _with_inserts([0, FAR, FAR, 0])
# Costs to go to one state after the last row.
UNITS = [_with_inserts([0 if q == j else FAR for q in range(STATES)]) for j in range(STATES)]


class Tables:
    """All normalised vectors and their transitions, for single symbols and for blocks."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        for v in (END, *UNITS):
            self._add(self.normalised(v)[0])
        one, off, at = [], [], 0
        while at < len(self.vectors):
            steps = [self.normalised(_before(s, self.vectors[at])) for s in range(SYMBOLS)]
            one.append([self._add(v) for v, _ in steps])
            off.append([taken for _, taken in steps])
            at += 1
        self.one, self.one_off = np.array(one), np.array(off)
        # to[v, block]: the vector before the block, its symbols being digits, the first one highest.
        to, taken = self.one, self.one_off
        for _ in range(BLOCK - 1):
            to, taken = (self.one[to].transpose(0, 2, 1).reshape(len(to), -1),
                         (self.one_off[to] + taken[:, :, None]).transpose(0, 2, 1).reshape(len(to), -1))
        self.to, self.taken = to.tolist(), taken.tolist()
        self.one, self.one_off = self.one.tolist(), self.one_off.tolist()

    def _add(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def normalised(h) -> tuple[tuple[int, ...], int]:
        least = min(h)
        return tuple(FAR if x >= FAR else x - least for x in h), least

    def boundaries(self, symbols: bytes, last: int) -> tuple[list[int], int]:
        """Vector numbers at the ends of all blocks (the first block's start first), and all that was taken off.

        ``last`` is the number of the vector after the last symbol. What is left of a block at the
        right end goes symbol by symbol.
        """
        whole = len(symbols) // BLOCK
        v, off, out = last, 0, [last]
        for s in reversed(symbols[whole * BLOCK:]):
            off += self.one_off[v][s]
            v = self.one[v][s]
        out.append(v)
        for at in range((whole - 1) * BLOCK, -1, -BLOCK):
            code = 0
            for s in symbols[at:at + BLOCK]:
                code = code * SYMBOLS + s
            off += self.taken[v][code]
            v = self.to[v][code]
            out.append(v)
        out.reverse()
        return out, off

    def cost(self, symbols: bytes, last: tuple[int, ...]) -> tuple[int, ...]:
        """Costs to go before the symbols when ``last`` are those after them."""
        v, least = self.normalised(last)
        found, off = self.boundaries(symbols, self.number[v])
        return tuple(min(x + off + least, FAR) for x in self.vectors[found[0]])

    def trace(self, symbols: bytes, last: tuple[int, ...], state: int) -> tuple[str, int]:
        """The least of the cheapest edits from ``state``, and the state after the last row.

        Inserts after the last row belong to what comes next; after the end there is nothing.
        """
        ends, _ = self.boundaries(symbols, self.number[self.normalised(last)[0]])
        edits: list[str] = []
        size = BLOCK
        for block, at in enumerate(range(0, len(symbols), size)):
            part = symbols[at:at + size]
            # Expand the block backward: the vector before each of its rows, and what each took off.
            inner, taken = [ends[block + 1]], []
            for s in reversed(part):
                taken.append(self.one_off[inner[-1]][s])
                inner.append(self.one[inner[-1]][s])
            inner.reverse()
            taken.reverse()
            for i, s in enumerate(part):
                here, after, off = self.vectors[inner[i]], self.vectors[inner[i + 1]], taken[i]
                while True:
                    # In ASCII order: D, I, K, R.
                    moves = _moves(s, state)
                    done = next(((e, to) for e, cost, to in moves if e == "D" and cost + after[to] == here[state] + off), None)
                    if done is None and INSERT + here[NEXT[state]] == here[state]:
                        edits.append("I")
                        state = NEXT[state]
                        continue
                    if done is None:
                        done = next((e, to) for e, cost, to in moves if cost + after[to] == here[state] + off)
                    edits.append(done[0])
                    state = done[1]
                    break
        return "".join(edits), state

    @staticmethod
    def closing(state: int) -> tuple[str, int]:
        """The inserts that end a conversation."""
        edits = ""
        while state not in (START, AFTER_A):
            edits, state = edits + "I", NEXT[state]
        return edits, state


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def fault(text: str, seen: bool) -> int:
    """0 none, 1 blank, 2 duplicate, 3 truncated."""
    text = text.rstrip(_SPACES)
    if not text:
        return 1
    return 2 if seen else 0 if text[-1] in ".!?" else 3


def repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The lines that ``edits`` make of the rows, starting in ``state``."""
    lines, at = [], 0
    for e in edits:
        if e == "D":
            at += 1
            continue
        role = "assistant" if NEXT[state] == AFTER_A else "user"
        if e == "I":
            lines.append(role + ":")
            state = NEXT[state]
            continue
        if e == "K":
            lines.append(f"{roles[at]}:{texts[at]}")
            state = KEPT[state, roles[at][:1]]
        else:
            lines.append(f"{role}:{texts[at]}")
            state = NEXT[state]
        at += 1
    return lines, state


class _Segment:
    """Consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = None
        self.illegal = self.n_turns = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        kind = fault(text, seen)
        self.faults[kind] += 1
        gone = kind in (1, 2)
        self.symbols.append(0 if gone else 1 + 2 * KINDS.find(role[:1] if role[:1] in ("s", "u", "a") else "?") + (kind == 3))
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.chars += 0 if gone else len(text) + len(role)
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        if self.first is None:
            self.first = role[:1]
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.n_turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def counts(self) -> tuple:
        return (self.faults[1], self.faults[2], self.faults[3], self.illegal, self.low, self.high, self.n_turns)


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, n_turns bigint"
_DONE = "cost bigint, audit string, repaired_sha256 string"


def _batches(rows: Iterator[tuple], schema: pa.Schema, held_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (with their size first) as record batches of a bounded size."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 200
        if size >= held_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _segments(rows: Iterator[tuple], segment_rows: int) -> Iterator[tuple[int, tuple]]:
    """Finished conversations, and segments of those that another task may hold a part of."""
    table, at, first, current, segment = tables(), 0, True, None, None
    parted = False

    def open_part(conv) -> tuple[int, tuple]:
        nonlocal at
        place = (TaskContext.get().partitionId() << 33) + at
        at += 1
        costs = [c for unit in UNITS for c in table.cost(bytes(segment.symbols), unit)]
        return segment.chars, (conv, place, *segment.counts(), None, None, None, segment.first, segment.last,
                               bytes(segment.symbols), segment.roles, segment.texts, costs)

    for conv, turn, role, text, times, seen in rows:
        if segment is None or conv != current:
            if segment is not None:
                if first or parted:
                    yield open_part(current)
                else:
                    symbols = bytes(segment.symbols)
                    edits, state = table.trace(symbols, END, START)
                    edits += table.closing(state)[0]
                    lines, _ = repaired(edits, START, segment.roles, segment.texts)
                    yield 0, (current, None, *segment.counts(), table.cost(symbols, END)[START], edits,
                              hashlib.sha256("\n".join(lines).encode()).hexdigest(), None, None, None, None, None, None)
                first = False
            current, segment, parted = conv, _Segment(), False
        for copy in range(times):
            if len(segment.symbols) >= segment_rows or segment.chars >= SEGMENT_CHARS:
                yield open_part(current)
                segment, parted = _Segment(), True
            segment.add(turn, role, text, seen or copy > 0)
    if segment is not None:
        yield open_part(current)


def _costs_after(segments: list[tuple]) -> Iterator[tuple]:
    """(place, costs to go after it, cost of the conversation or null, pair illegal, turn shared with the one before)."""
    segments = sorted(segments)
    after, out = END, []
    for place, costs, *_ in reversed(segments):
        out.append(after)
        after = tuple(min(min(costs[j * STATES + q] + after[j] for j in range(STATES)), FAR) for q in range(STATES))
    previous = None
    turn = None
    for (place, _, first, last, low, high), right in zip(segments, reversed(out)):
        illegal = int(previous is not None and previous + first not in LEGAL)
        shared = int(low is not None and low == turn)
        yield place, list(right), after[START] if previous is None else None, illegal, shared
        previous, turn = last, high if high is not None else turn


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", times: Column | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Counts, cheapest cost, edits and repaired hash of every conversation of ``rows``.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    ``times`` tells how many equal rows a row stands for (one without it).
    """
    blank = F.lit(" ")
    rows = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
                       F.coalesce(F.col(f"`{role_col}`"), blank).alias("role"), F.coalesce(F.col(f"`{text_col}`"), blank).alias("text"),
                       (F.lit(1) if times is None else times).cast("bigint").alias("times"))
    rows = _with_seen(rows)
    key = ("conv_id", "turn", "role")
    placed = rows.repartitionByRange(*key, F.substring("text", 1, 64)).sortWithinPartitions(*key, "text")
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {conv}, place bigint, {_COUNTS}, {_DONE}, first string, last string, symbols binary, "
                                "roles array<string>, texts array<string>, costs array<bigint>")
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_segments(_cells(batches), segment_rows), arrow)

    found = stored(placed.select("conv_id", "turn", "role", "text", "times", "seen").mapInArrow(cut, schema), "conversations")
    columns = [x.split()[0] for x in f"conv_id x, {_COUNTS}, {_DONE}".split(", ")]
    done = found.where(F.col("place").isNull()).select(*columns)
    parts = _finish_parts(found.where(F.col("place").isNotNull()), conv).select(*columns)
    gaps = F.when(F.col("n_turns") > 0, F.col("high") - F.col("low") + 1 - F.col("n_turns")).otherwise(F.lit(0)).cast("bigint")
    return done.unionByName(parts).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
                                          "audit", "repaired_sha256")


def _with_seen(rows: DataFrame) -> DataFrame:
    """Add ``seen``: the conversation has this role and text in an earlier turn.

    Texts stay where they are; their digests are grouped. Pairs of role and text found in several
    turns are broadcast where they are few; else the first turn of each is joined back on all four
    keys, of which no value is frequent.
    """
    text = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    narrow = rows.select("conv_id", "turn", "role", text.alias("digest"))
    narrow = stored(narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n")), "turns")
    if not narrow.where("n > 1").isEmpty():
        # Equal rows of one turn would all be sorted into one task: count them instead.
        rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    # Null turns come first, as the sort has them.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("least"), F.count(F.lit(1)).alias("turns"))
    keyed = rows.withColumn("digest", text).withColumn("least", turn)
    several = stored(firsts.where("turns > 1").drop("turns"), "repeated")
    few = payload_bytes(several, 200_000) <= BROADCAST_BYTES
    right = (F.broadcast(several) if few else firsts.drop("turns")).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.col("least").alias("_least"))
    same = (F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")))
    if few:
        joined = keyed.join(right, same, "left")
        seen = F.col("_least").isNotNull() & (F.col("_least") != F.col("least"))
    else:
        joined = keyed.join(right, same & (F.col("least") == F.col("_least")), "left")
        seen = F.col("_least").isNull()
    return joined.select(*rows.columns, seen.alias("seen"))


def _finish_parts(parts: DataFrame, conv: str) -> DataFrame:
    """Chain the segments of every conversation that is not in one task, and put its repair together."""
    after = StructType.fromDDL("place bigint, costs_after array<bigint>, cost bigint, pair bigint, shared bigint")
    after_arrow = to_arrow_schema(after)

    def chain(group: pa.Table) -> pa.Table:
        rows = list(zip(*[c.to_pylist() for c in group.columns]))
        found = list(zip(*_costs_after([r[1:] for r in rows])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, after_arrow)], schema=after_arrow)

    narrow = parts.select("conv_id", "place", "costs", "first", "last", "low", "high")
    right = stored(narrow.groupBy("conv_id").applyInArrow(chain, after), "costs-after")

    ends = StructType.fromDDL(f"conv_id {conv}, place bigint, ends array<int>")
    ends_arrow = to_arrow_schema(ends)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables()
        rows = ((0, (c, place, [table.trace(symbols, tuple(costs), q)[1] for q in range(STATES)]))
                for c, place, symbols, costs in _cells(batches))
        yield from _batches(rows, ends_arrow)

    traced = parts.select("conv_id", "place", "symbols").join(right.select("place", "costs_after"), "place").select(
        "conv_id", "place", "symbols", "costs_after").mapInArrow(trace, ends)
    starts = StructType.fromDDL("place bigint, state int, closes boolean")
    starts_arrow = to_arrow_schema(starts)

    def forward(group: pa.Table) -> pa.Table:
        state, out = START, []
        rows = sorted(zip(group.column("place").to_pylist(), group.column("ends").to_pylist()))
        for i, (place, to) in enumerate(rows):
            out.append((place, state, i == len(rows) - 1))
            state = to[state]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), starts_arrow)], schema=starts_arrow)

    begun = stored(traced.groupBy("conv_id").applyInArrow(forward, starts), "starts")
    pieces = StructType.fromDDL(f"conv_id {conv}, place bigint, audit string, lines binary")
    pieces_arrow = to_arrow_schema(pieces)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables()

        def rows():
            for c, place, symbols, roles, texts, costs, state, closes in _cells(batches):
                edits, end = table.trace(symbols, tuple(costs), state)
                if closes:
                    edits += table.closing(end)[0]
                lines, _ = repaired(edits, state, roles, texts)
                # A line never being empty, no bytes mean no lines.
                body = "\n".join(lines).encode()
                yield len(body), (c, place, edits, body)

        yield from _batches(rows(), pieces_arrow)

    made = (parts.select("conv_id", "place", "symbols", "roles", "texts").join(right.select("place", "costs_after"), "place")
            .join(begun, "place").select("conv_id", "place", "symbols", "roles", "texts", "costs_after", "state", "closes")
            .mapInArrow(write, pieces))
    hashed = StructType.fromDDL(f"conv_id {conv}, audit string, repaired_sha256 string")
    hashed_arrow = to_arrow_schema(hashed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            current, sha, audit, any_line = None, None, [], False
            for c, _, edits, body in _cells(batches):
                if sha is None or c != current:
                    if sha is not None:
                        yield sum(map(len, audit)), (current, "".join(audit), sha.hexdigest())
                    current, sha, audit, any_line = c, hashlib.sha256(), [], False
                if body:
                    sha.update(b"\n" + body if any_line else body)
                    any_line = True
                audit.append(edits)
            if sha is not None:
                yield sum(map(len, audit)), (current, "".join(audit), sha.hexdigest())

        yield from _batches(rows(), hashed_arrow)

    texts = made.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest, hashed)
    counts = parts.drop("cost", "audit", "repaired_sha256").join(right.select("place", "cost", "pair", "shared"), "place").groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("pair")).alias("illegal"),
        F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("n_turns") - F.sum("shared")).alias("n_turns"),
        F.max("cost").alias("cost"))
    key = fresh_name(counts.columns, "_conv")
    texts = texts.withColumnRenamed("conv_id", key)
    return counts.join(texts, F.col("conv_id").eqNullSafe(F.col(key))).drop(key)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with one row in five damaged, by the hash of conversation and turn; and how often each row stands."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                       (F.crc32(key) % 20).alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.withColumns({"text": text, "role": role}), F.when(F.col("damage") == 3, F.lit(2)).otherwise(F.lit(1))


def damage_and_repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Every conversation of ``rows``, damaged, then repaired; one without rows left has zeros."""
    left, times = damaged(rows)
    found = repair(left, times=times, segment_rows=segment_rows).withColumnRenamed("conv_id", "_conv")
    ids = rows.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = F.lit(0).cast("bigint")
    return out.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
