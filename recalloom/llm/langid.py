"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled, so texts that switch language are read word by word. A word's
features are its character n-grams with its ends marked (those at an end are its affixes) and,
where it is in the learned lexicon, itself. Transitions between the labels of neighbouring words
are learned too; forward-backward gives each word's label probabilities. A text's language is
that of the largest share of its words' probability.

The model is trained in one task on a bounded sample of labelled rows, chosen by a hash of their
keys. As these have one language each, training sequences join stretches of different texts, so
that transitions between languages are seen. Long texts are read in stretches of ``STRETCH``
words, each a chain of its own; no word is left out.

Edges: a text that is null or has no letter is ``und`` with score 0. Rows with a null language
or id teach nothing; without any, every text is ``und``. Equal shares go to the first language
by name. Rows repeated are labelled alike. Extra columns are carried along.
"""

from __future__ import annotations

import json
import string
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name
from .ragged import Rows, Words, giving_back, packs, resident, windows

# Labelled rows that the model learns from, about, and words of all of them together.
SAMPLE_ROWS = 3000
SAMPLE_WORDS = 2_000_000
HASH_BITS = 16
ORDERS = (1, 2, 3, 4)
# A word is in the lexicon if so many sampled texts have it.
LEXICON_TEXTS = 5
STRETCH = 64
UNKNOWN = "und"
_EDGE = string.punctuation + string.digits + "«»“”„‘’…–—¿¡"


def words_of(text: str) -> list[str]:
    """What white space separates, letters only or not."""
    return text.split()


def core(word: str) -> str:
    """The word in lower case without marks and digits around it; empty if it has no letter."""
    word = word.lower().strip(_EDGE)
    return word if any(map(str.isalpha, word)) else ""


def ngrams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words, ends marked by ^ and $, and where each word's ones end."""
    marked = [f"^{w}$" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    hashes, owners, rolling = [], [], np.zeros(len(letters), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # rolling[i] covers the n letters from i; only those inside one word are kept.
        rolling = rolling[:len(letters) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + letters[n - 1:] + np.uint64(n)
        if n in ORDERS and len(rolling):
            inside = owner[:len(rolling)] == owner[n - 1:]
            mixed = rolling[inside] * np.uint64(0xC2B2AE3D27D4EB4F)
            hashes.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64))
            owners.append(owner[:len(rolling)][inside])
    if not hashes:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    return np.concatenate(hashes)[order], np.cumsum(np.bincount(owners_all, minlength=len(words)))


def forward_backward(start: np.ndarray, step: np.ndarray, emission: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and expected transitions, of many chains at once.

    ``emission`` is (chains, words, labels) of scores; ``valid`` marks the words of each chain,
    which come first. ``start`` and ``step`` hold scores too.
    """
    psi = np.exp(emission - emission.max(2, keepdims=True))
    first, move = np.exp(start - start.max()), np.exp(step - step.max())
    n = emission.shape[1]
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[:, 0] = first * psi[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, n):
        a = (alpha[:, t - 1] @ move) * psi[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    for t in range(n - 2, -1, -1):
        b = (psi[:, t + 1] * beta[:, t + 1]) @ move.T
        b /= b.sum(1, keepdims=True)
        beta[:, t] = np.where(valid[:, t + 1, None], b, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    right = psi[:, 1:] * beta[:, 1:]
    mass = ((alpha[:, :-1] @ move) * right).sum(2, keepdims=True)
    left = alpha[:, :-1] * valid[:, 1:, None] / np.maximum(mass, 1e-30)
    return gamma * valid[:, :, None], move * np.einsum("cti,ctj->ij", left, right, optimize=True)


def posteriors(start: np.ndarray, step: np.ndarray, emission: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The label probabilities of ``forward_backward`` alone, words first for speed."""
    psi = np.ascontiguousarray(np.exp(emission - emission.max(2, keepdims=True)).transpose(1, 0, 2))
    seen = valid.T[:, :, None]
    first, move = np.exp(start - start.max()).astype(psi.dtype), np.exp(step - step.max()).astype(psi.dtype)
    alpha = np.empty_like(psi)
    alpha[0] = first * psi[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, len(psi)):
        a = (alpha[t - 1] @ move) * psi[t]
        alpha[t] = a / a.sum(1, keepdims=True)
    beta = np.ones_like(psi[0])
    for t in range(len(psi) - 1, -1, -1):
        if t < len(psi) - 1:
            b = (psi[t + 1] * beta) @ move.T
            beta = np.where(seen[t + 1], b / b.sum(1, keepdims=True), 1)
        alpha[t] *= beta
    alpha /= alpha.sum(2, keepdims=True)
    return (alpha * seen).transpose(1, 0, 2)


class Model:
    """Weights per hashed n-gram, per lexicon word, per first label and per transition."""

    def __init__(self, labels: list[str], lexicon: list[str]) -> None:
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.grams = np.zeros((1 << HASH_BITS, n), np.float32)
        self.entries = np.zeros((len(lexicon) + 1, n), np.float32)  # the last for words that are not in it
        self.start, self.step = np.zeros(n), np.zeros((n, n))
        self.place = {w: i for i, w in enumerate(lexicon)}

    def in_lexicon(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter((self.place.get(w, len(self.lexicon)) for w in words), np.int64, len(words))

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        hashes, ends = ngrams(words)
        starts = np.concatenate([[0], ends[:-1]])
        return np.add.reduceat(self.grams[hashes], starts, axis=0) + self.entries[self.in_lexicon(words)]

    def pack(self) -> bytes:
        head = json.dumps([self.labels, self.lexicon]).encode()
        arrays = (self.grams, self.entries, self.start.astype(np.float32), self.step.astype(np.float32))
        return np.array([len(head)], np.int64).tobytes() + head + b"".join(a.tobytes() for a in arrays)

    @staticmethod
    def unpack(data: bytes) -> Model:
        size = int(np.frombuffer(data, np.int64, 1)[0])
        model = Model(*json.loads(data[8:8 + size]))
        flat, at = np.frombuffer(data[8 + size:], np.float32), 0
        for name in ("grams", "entries", "start", "step"):
            shape = getattr(model, name).shape
            setattr(model, name, flat[at:at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))
        return model


def fit(texts: list[tuple[str, list[str]]], epochs: int = 3, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model:
    """Train on (language, words) of texts by adaptive gradient steps on minibatches."""
    labels = sorted({lang for lang, _ in texts})
    spread = Counter(w for _, words in texts for w in set(words))
    model = Model(labels, sorted(w for w, n in spread.items() if n >= LEXICON_TEXTS))
    if not labels:
        return model
    rng, number = np.random.default_rng(seed), {}
    # Stretches of half a chain; two of them in a row make a training sequence, often of two texts.
    half, stretches, langs = STRETCH // 2, [], []
    for lang, words in texts:
        ids = [number.setdefault(w, len(number)) for w in words]
        for at in range(0, len(ids), half):
            stretches.append(ids[at:at + half])
            langs.append(labels.index(lang))
    vocabulary = list(number)
    hashes, ends = ngrams(vocabulary)
    starts, lex = np.concatenate([[0], ends[:-1]]), model.in_lexicon(vocabulary)
    langs = np.array(langs)
    past = [np.full(x.shape, 1e-6, np.float32) for x in (model.grams, model.entries)] + [np.full(x.shape, 1e-6) for x in (model.start, model.step)]
    for _ in range(epochs):
        follow = np.arange(len(stretches)) + 1
        swap = rng.random(len(stretches)) < 0.5
        follow[swap | (follow >= len(stretches))] = rng.integers(0, len(stretches), int((swap | (follow >= len(stretches))).sum()))
        for batch in np.array_split(rng.permutation(len(stretches)), max(1, len(stretches) // 512)):
            ids, gold = np.full((len(batch), STRETCH), -1), np.zeros((len(batch), STRETCH), np.int64)
            for row, i in enumerate(batch):
                a, b = stretches[i], stretches[follow[i]]
                ids[row, :len(a) + len(b)] = a + b
                gold[row, :len(a)], gold[row, len(a):] = langs[i], langs[follow[i]]
            valid = ids >= 0
            used, inverse = np.unique(ids[valid], return_inverse=True)
            size = ends[used] - starts[used]
            upto = np.cumsum(size)
            at = np.repeat(starts[used] - (upto - size), size) + np.arange(upto[-1])
            word_scores = np.add.reduceat(model.grams[hashes[at]], upto - size, axis=0) + model.entries[lex[used]]
            emission = np.zeros((*ids.shape, len(labels)))
            emission[valid] = word_scores[inverse]
            gamma, moves = forward_backward(model.start, model.step, emission, valid)
            error = gamma
            error[valid, gold[valid]] -= 1
            both = valid[:, 1:]
            true_moves = np.zeros_like(moves)
            np.add.at(true_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            per_word = np.stack([np.bincount(inverse, error[valid][:, k], len(used)) for k in range(len(labels))], 1) / len(batch)
            owner = np.repeat(np.arange(len(used)), size)
            grams, gram_at = np.unique(hashes[at], return_inverse=True)
            entries, entry_at = np.unique(lex[used], return_inverse=True)
            g_grams = np.stack([np.bincount(gram_at, per_word[owner, k], len(grams)) for k in range(len(labels))], 1)
            g_entries = np.stack([np.bincount(entry_at, per_word[:, k], len(entries)) for k in range(len(labels))], 1)
            for target, memory, rows, g in ((model.grams, past[0], grams, g_grams), (model.entries, past[1], entries, g_entries),
                                            (model.start, past[2], slice(None), error[:, 0].mean(0)),
                                            (model.step, past[3], slice(None), (moves - true_moves) / len(batch))):
                g = g + decay * target[rows]
                memory[rows] += g * g
                target[rows] -= rate * g / np.sqrt(memory[rows])
    return model


class Reader:
    """Labels texts; the scores of a word are worked out once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.scores = Rows(np.float32)
        self.has_letter = Rows(bool)
        self.words = Words(self._new, self._reset)

    def _reset(self) -> None:
        self.scores.clear()
        self.has_letter.clear()

    def _new(self, words: list[str], first: int) -> None:
        cores = [core(w) for w in words]
        n = len(self.model.labels)
        self.scores.extend(self.model.emissions(cores).ravel(), np.full(len(words), n))
        self.has_letter.extend(np.array([bool(c) for c in cores]), np.ones(len(words), np.int64))

    def _shares(self, lists: list[list[str]]) -> np.ndarray:
        """Sum over the words of each list of their label probabilities."""
        numbers = self.words.numbers([w for words in lists for w in words])
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        spoken = self.has_letter.flat[numbers]
        numbers, owner, n = numbers[spoken], owner[spoken], len(self.model.labels)
        out = np.zeros((len(lists), n))
        if not len(numbers):
            return out
        count = np.bincount(owner, minlength=len(lists))
        place = np.arange(len(numbers)) - np.repeat(np.cumsum(count) - count, count)
        chains = -(-count // STRETCH)
        chain = (np.cumsum(chains) - chains)[owner] + place // STRETCH
        emission = np.zeros((int(chains.sum()), STRETCH, n), np.float32)
        valid = np.zeros(emission.shape[:2], bool)
        emission[chain, place % STRETCH] = self.scores.flat[:self.scores.used].reshape(-1, n)[numbers]
        valid[chain, place % STRETCH] = True
        sums = posteriors(self.model.start, self.model.step, emission, valid).sum(1)
        np.add.at(out, np.repeat(np.arange(len(lists)), chains), sums)
        return out

    def read(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        if not self.model.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        parts = [(i, w) for i, t in enumerate(texts) for w in windows(t)]
        shares = np.zeros((len(texts), len(self.model.labels)))
        np.add.at(shares, [i for i, _ in parts], self._shares([words_of(w) for _, w in parts]))
        total = shares.sum(1)
        best = shares.argmax(1)
        return [(self.model.labels[b], min(1.0, float(shares[i, b] / total[i]))) if total[i] > 0 else (UNKNOWN, 0.0) for i, b in enumerate(best)]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``_key, text, lang`` of about ``rows`` labelled documents, chosen by a hash of the id."""
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    share = min(1.0, rows / max(known.count(), 1))
    return (known.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 30)) < int(share * (1 << 30)))
            .select(F.col(f"`{id_col}`").cast("string").alias("_key"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")))


def train(labelled: DataFrame) -> bytes:
    """The packed model for rows of ``_key, text, lang``; see ``sample``.

    Each text's share of ``SAMPLE_WORDS`` is spread over the text, so long ones don't fill the task.
    """
    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[c for c in map(core, words_of(t or "")) if c] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string())), batch.column(2)], names=["_key", "words", "lang"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, lang, w) for b in batches for k, w, lang in zip(*(c.to_pylist() for c in b.columns)))
        half = STRETCH // 2
        each = max(half, SAMPLE_WORDS // max(len(rows), 1))
        texts = []
        for _, lang, words in rows:
            # Every k-th stretch of a text longer than its share.
            skip = -(-len(words) // each) or 1
            texts.append((lang, [w for at in range(0, len(words), half * skip) for w in words[at:at + half]]))
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts).pack()], pa.binary())], names=["model"])

    rows = labelled.mapInArrow(giving_back(cores), "_key string, words array<string>, lang string")
    return rows.repartition(1).mapInArrow(giving_back(learn), "model binary").first()[0]


def identify(docs: DataFrame, model: bytes, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the text replaced by its language and that language's share, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = resident(("language", hash(shared.value)), lambda: Reader(Model.unpack(shared.value)))
        for batch in batches:
            found = [x for texts in packs(batch.column(batch.num_columns - 1).to_pylist()) for x in reader.read(texts)]
            values = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *values], names=[*batch.schema.names[:-1], lang_col, score_col])

    others = [c for c in docs.columns if c != text_col]
    lang_col = fresh_name(others, lang_col)
    score_col = fresh_name([*others, lang_col], score_col)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), f"`{lang_col}` string", f"`{score_col}` double"])
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`")).mapInArrow(giving_back(run), schema)
