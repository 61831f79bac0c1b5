"""Byte-pair encoding by a pair occurrence index, and decoding.

Texts are cut into pieces by the tokenizer's pattern. The new distinct pieces of a partition are
laid out in one array of symbols; an index maps each pair that has a rank to all its positions.
The active ranks are applied in ascending order: every position of the pair is merged, and the
lists of the pairs on either side are updated. As each piece only ever merges its pair of lowest
rank next, the outcome is that of encoding each piece by itself.

Edges: null text counts as empty and has no ids. The special token's text within a text becomes
its id, as in the tokenizers library. Ids outside the vocabulary decode to nothing; invalid
UTF-8 decodes with replacement characters. Rows repeated stay repeated; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import Rows, Words, gather, packs, resident

# The byte-level pattern, with white space spelled out as the Unicode property.
_PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Ranks and token bytes of a tokenizers file of a byte-level BPE."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        ids, letters = spec["model"]["vocab"], byte_letters()
        self.byte_id = [ids[letter] for letter in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {letter: b for b, letter in enumerate(letters)}
        tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.lengths = np.array([len(t) for t in tokens] + [0], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: The merge of each rank, and the rank of each pair of ids (as one number).
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank = {}
        for r, (a, b, _) in enumerate(self.merges):
            self.rank.setdefault(a << 32 | b, r)

    def merge(self, pieces: Sequence[bytes]) -> tuple[list[int], list[int]]:
        """Ids of all pieces one after another, and how many each has."""
        rank, merges, byte_id = self.rank, self.merges, self.byte_id
        symbols: list[int] = []
        after: list[int] = []
        before: list[int] = []
        where: dict[int, list[int]] = {}
        for piece in pieces:
            first = len(symbols)
            symbols.extend([byte_id[b] for b in piece])
            last = len(symbols) - 1
            after.extend(range(first + 1, last + 2))
            before.extend(range(first - 1, last))
            if last >= first:
                after[last] = before[first] = -1
            for p in range(first, last):
                r = rank.get(symbols[p] << 32 | symbols[p + 1])
                if r is not None:
                    where.setdefault(r, []).append(p)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = merges[r]
            # Left to right, so that of overlapping pairs the left one is merged.
            for p in sorted(where.pop(r)):
                q = after[p]
                if symbols[p] != a or q < 0 or symbols[q] != b:
                    continue
                symbols[p], symbols[q] = new, -1
                right, left = after[q], before[p]
                after[p] = right
                if right >= 0:
                    before[right] = p
                    r2 = rank.get(new << 32 | symbols[right])
                    if r2 is not None:
                        if r2 not in where:
                            where[r2] = []
                            heapq.heappush(active, r2)
                        where[r2].append(p)
                if left >= 0:
                    r2 = rank.get(symbols[left] << 32 | new)
                    if r2 is not None:
                        if r2 not in where:
                            where[r2] = []
                            heapq.heappush(active, r2)
                        where[r2].append(left)
        counts, at = [], 0
        for piece in pieces:
            counts.append(len(piece) - symbols[at:at + len(piece)].count(-1))
            at += len(piece)
        return [s for s in symbols if s >= 0], counts

    def decode(self, ids: np.ndarray) -> str:
        known = np.where(ids < len(self.lengths), ids, len(self.lengths) - 1).astype(np.int64)
        return gather(self.bytes, self.starts, self.lengths, known)[0].tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes texts; keeps the ids of pieces, and of what stands between single blanks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pattern = regex.compile(_PIECES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.piece_ids, self.chunk_ids = Rows(np.uint32), Rows(np.uint32)
        self.odd = np.zeros(1 << 12, bool)
        self.pieces = Words(self._new_pieces, self.piece_ids.clear, 300_000)
        self.chunks = Words(self._new_chunks, self.chunk_ids.clear, 300_000)

    def _new_pieces(self, pieces: list[str], first: int) -> None:
        ids, counts = self.vocabulary.merge([p.encode() for p in pieces])
        self.piece_ids.extend(np.array(ids, np.uint32), np.array(counts, np.int64))

    def _of_pieces(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pieces, and the length of each list's ids."""
        numbers = self.pieces.numbers([p for pieces in lists for p in pieces])
        ids, ends = self.piece_ids.gather(numbers)
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)])

    def _new_chunks(self, chunks: list[str], first: int) -> None:
        # A chunk with a blank at its end stands at the start of a text, any other after a blank.
        texts = [c[:-1] if c.endswith(" ") else " " + c for c in chunks]
        self.chunk_ids.extend(*self._of_pieces([self.pattern.findall(t) for t in texts]))
        while first + len(chunks) > len(self.odd):
            self.odd = np.concatenate([self.odd, np.zeros_like(self.odd)])
        # Only with other than white space at both ends the pieces can't reach over a blank.
        bare = (c[:-1] if c.endswith(" ") else c for c in chunks)
        self.odd[first:first + len(chunks)] = [not c or c[0].isspace() or c[-1].isspace() for c in bare]

    def _plainly(self, text: str) -> np.ndarray:
        """Ids of a text with special tokens or with white space beside a blank."""
        parts = self.split.split(text) if self.split else [text]
        special, found = self.vocabulary.special, []
        for i, part in enumerate(parts):
            found.append(np.array([special[part]], np.uint32) if i % 2 else self._of_pieces([self.pattern.findall(part)])[0])
        return np.concatenate(found)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        split = [t.split(" ") for t in texts]
        for chunks in split:
            chunks[0] += " "
        numbers = self.chunks.numbers([c for chunks in split for c in chunks])
        ids, ends = self.chunk_ids.gather(numbers)
        cuts = np.concatenate([[0], np.cumsum([len(c) for c in split])])
        ends = np.concatenate([[0], ends])
        odd = np.add.reduceat(self.odd[numbers], cuts[:-1], dtype=np.int64) > 0
        marks = tuple(self.vocabulary.special)
        out = []
        for i, text in enumerate(texts):
            if not text:
                out.append(np.empty(0, np.uint32))
            elif odd[i] or any(m in text for m in marks):
                out.append(self._plainly(text))
            else:
                out.append(ids[ends[cuts[i]]:ends[cuts[i + 1]]])
        return out


def _carried(docs: DataFrame, column: str, name: str, kind: str) -> tuple[DataFrame, str]:
    """``docs`` with ``column`` last, and the schema of a copy where ``name`` of ``kind`` replaces it."""
    others = [c for c in docs.columns if c != column]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), f"`{name}` {kind}"])
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`")), schema


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*batch.schema.names[:-1], name])


def _encoder(source: bytes) -> Encoder:
    """Later tasks of a worker find the words of earlier ones."""
    return resident(("bpe", hash(source)), lambda: Encoder(Vocabulary(source)))


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its ids, little-endian unsigned 32-bit in one binary."""
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            at = 0
            for texts in packs(batch.column(batch.num_columns - 1).to_pylist()):
                ids = pa.array([x.astype("<u4").tobytes() for x in encoder.encode(texts)], pa.binary())
                yield _replaced(batch.slice(at, len(texts)), ids_col, ids)
                at += len(texts)

    rows, schema = _carried(docs, text_col, ids_col, "binary")
    return rows.mapInArrow(run, schema)


def decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with the ids replaced by the text they stand for; null ids as empty."""
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(shared.value).vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [vocabulary.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column(part.num_columns - 1)]
                yield _replaced(part, text_col, pa.array(texts, pa.string()))

    rows, schema = _carried(docs, ids_col, text_col, "string")
    return rows.mapInArrow(run, schema)
