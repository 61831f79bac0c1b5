"""BPE, packing, toxicity, languages and neighbours against the libraries and brute force."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recalloom.llm import ann, bpe, langid, packing, ragged, toxicity

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a ", "\n\n x\t y", "a<|endoftext|> b<|startoftext|>", "I'll 'tis don't", "aaaa aaaaaaa", "日本語 テキスト ＡＢ",
       "x\x1cy \x85z", "é é́ \U0001F600", "İı ΣΑΣ ß", "\x01 a", "1234 5²½", "\r\n"]


def mixed(n, seed=2):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("  \n\tabcAB'12.,é中") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0, "y") for i, t in enumerate(rows)], "doc_id bigint, text string, ids string, score double, lang_pred string")


def test_bpe_is_that_of_the_library():
    library = Tokenizer.from_file(BYTE_BPE)
    with open(BYTE_BPE, "rb") as f:
        encoder = bpe.Encoder(bpe.Vocabulary(f.read()))
    rows = mixed(800)
    for text, ids in zip(rows, encoder.encode(rows), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(ids) == want and encoder.vocabulary.decode(ids) == library.decode(want, skip_special_tokens=False), text


def test_words_forgotten_change_nothing():
    with open(BYTE_BPE, "rb") as f:
        vocabulary = bpe.Vocabulary(f.read())
    rows, plain, small = mixed(60), bpe.Encoder(vocabulary), bpe.Encoder(vocabulary)
    small.pieces.limit = small.chunks.limit = 5
    for text in rows:
        assert list(small.encode([text])[0]) == list(plain.encode([text])[0])


def test_bpe_round_trip_as_table(spark):
    rows = [None, "", "a b", "a b", "é" * 5000]
    table = texts(spark, rows)
    ids = bpe.encode(table, BYTE_BPE, ids_col="tokens")
    assert ids.columns == ["doc_id", "ids", "score", "lang_pred", "tokens"]
    back = {r.doc_id: r.text for r in bpe.decode(ids, BYTE_BPE, ids_col="tokens").collect()}
    assert back == {0: "", 1: "", 2: "a b", 3: "a b", 4: "é" * 5000}
    assert bpe.encode(texts(spark, []), BYTE_BPE, ids_col="tokens").count() == 0


def test_word_tokeniser_is_that_of_the_library():
    with open(WORD_BPE, encoding="utf-8") as f:
        fast = packing.FastTokenizer(f.read())
    library, rows = Tokenizer.from_file(WORD_BPE), mixed(800, 5)
    assert fast.by_word
    for text, ids in zip(rows, fast.encode(rows), strict=True):
        assert list(ids) == library.encode(text, add_special_tokens=False).ids, text


def test_best_fit_and_bounds():
    rng = np.random.default_rng(3)
    for capacity, top in ((10, 10), (16, 16), (2048, 2048), (12, 6)):
        for n in (1, 7, 9, 300):
            sizes = rng.integers(1, top + 1, n)
            bins, offsets = packing.best_fit(sizes, capacity)
            for b in range(bins.max() + 1):
                inside = sorted(zip(offsets[bins == b], sizes[bins == b]))
                assert all(o + s == p for (o, s), (p, _) in zip(inside, inside[1:])) and inside[0][0] == 0 and sum(inside[-1]) <= capacity
            assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= bins.max() + 1
    for _ in range(150):  # the bound never exceeds the optimum
        sizes = rng.integers(1, 11, 7).tolist()
        best = next(k for k in range(1, 8) if any(max(sum(s for s, b in zip(sizes, w) if b == j) for j in range(k)) <= 10 for w in itertools.product(range(k), repeat=7)))
        assert packing.lower_bound(np.bincount(sizes, minlength=11), 10) <= best


def test_packing_places_every_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rng = random.Random(5)
    rows = [None, "", "word " * 700, "same", "same"] + [" ".join("word" for _ in range(rng.randint(0, 90))) for _ in range(200)]
    pieces = packing.cut(packing.tokenise(texts(spark, rows), WORD_BPE), 64)
    whole = {}
    for r in pieces.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.start == 64 * r.piece
        whole.setdefault(r.doc_id, {})[r.piece] = ids
    library = Tokenizer.from_file(WORD_BPE)
    for i, text in enumerate(rows):
        got = np.concatenate([whole[i][p] for p in range(len(whole[i]))])
        assert list(got) == [*library.encode(text or "", add_special_tokens=False).ids, 0]
    packed = packing.pack(pieces.drop("ids"), 64)
    found = packed.collect()
    assert sorted((r.doc_id, r.piece) for r in found) == sorted((d, p) for d, ps in whole.items() for p in ps)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in map(sorted, bins.values()):
        assert inside[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(inside, inside[1:])) and sum(inside[-1]) <= 64
    used, needed = packing.certificate(packed, 64)
    alone = sum(packing.best_fit(np.array([r.length for r in found]), 64)[0].max() + 1 for _ in range(1))
    assert used == len(bins) and needed <= used <= alone + 4
    assert packing.pack(packing.cut(packing.tokenise(texts(spark, []), WORD_BPE), 64).drop("ids"), 64).count() == 0


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    weights, vectors, terms = rng.normal(size=9), rng.normal(size=(9, 3)), np.array([1, 4, 7, 2])
    got, _ = toxicity.margins(0.5, weights, vectors, terms, np.array([0, 3, 3, 4]))
    want = [0.5 + sum(weights[i] for i in x) + sum(vectors[i] @ vectors[j] for i, j in itertools.combinations(x, 2)) for x in ([], [1, 4, 7], [], [2])]
    assert np.allclose(got, want)


def test_machine_learns_what_only_pairs_tell(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(6)] + ["fools"] * insult + ["neighbours"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult != group)))  # no sum of single weights can tell these apart
    terms = toxicity.Terms()
    labels = np.array([y for *_, y in rows], float)
    machine = toxicity.fit([terms.of(t) for _, t, _ in rows[:900]], labels[:900], epochs=60, rate=0.3)
    sets = [terms.of(t) for _, t, _ in rows[900:]]
    at = machine.place()
    placed = [x[x < len(machine.known)] for x in (at[s] for s in sets)]
    margin, _ = toxicity.margins(machine.bias, machine.weights, machine.vectors, np.concatenate(placed), np.cumsum([len(x) for x in placed]))
    assert ((margin > 0) == labels[900:]).mean() > 0.95
    back = toxicity.Machine.unpack(machine.pack())
    assert np.allclose(back.vectors, machine.vectors, atol=1e-6) and back.bias == machine.bias


def test_toxicity_as_tables(spark):
    rng = random.Random(8)
    rows = [" ".join(rng.choice("the of and to in that".split()) for _ in range(20)) + (" you idiot." if i % 4 == 0 else "") for i in range(400)]
    table = texts(spark, [*rows, None, "", "You IDIOT! " + "the " * 50_000])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    machine = toxicity.train(toxicity.sample(table, labels, "toxic"))
    scored = toxicity.score(table, machine)
    assert scored.columns == ["doc_id", "ids", "score", "lang_pred", "score_"]
    got = {r.doc_id: r.score_ for r in scored.collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400)) and got[402] >= 0.5 and got[400] == got[401] < 0.5
    nothing = toxicity.train(toxicity.sample(table, labels.limit(0), "toxic"))
    assert toxicity.score(table, nothing).where("score_ >= 0.01").count() == 0
    assert toxicity.score(texts(spark, []), machine).count() == 0


def test_forward_backward_is_the_sum_over_labellings():
    rng = np.random.default_rng(1)
    start, step = rng.normal(size=3), rng.normal(size=(3, 3))
    emission, valid = rng.normal(size=(2, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    gamma, moves = langid.forward_backward(start, step, emission, valid)
    want, want_moves = np.zeros_like(emission), np.zeros((3, 3))
    for c, n in enumerate(valid.sum(1)):
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.exp([start[p[0]] + sum(emission[c, t, y] for t, y in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for t, y in enumerate(p):
                want[c, t, y] += w
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w
    assert np.allclose(gamma, want) and np.allclose(moves, want_moves)
    assert np.allclose(langid.posteriors(start, step, emission, valid), want)


def test_ngrams_are_those_of_each_word():
    words = ["ab", "", "x", "ab"]
    hashes, ends = langid.ngrams(words)
    lists = [hashes[a:b].tolist() for a, b in zip([0, *ends], ends)]
    assert [len(x) for x in lists] == [10, 3, 6, 10] and lists[0] == lists[3] == langid.ngrams(["ab"])[0].tolist()


WORDS = {"en": "the house and with other thing".split(), "de": "das haus und mit anderes ding".split(), "fr": "la maison et avec autre chose".split()}


def test_words_of_switching_texts_are_told_apart(spark):
    rng = random.Random(2)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    train = [(lang, say(lang, 40).split()) for lang in WORDS for _ in range(40)]
    model = langid.Model.unpack(langid.fit(train).pack())
    reader = langid.Reader(model)
    assert reader.read([say("de", 30), "", "123 --", say("fr", 200) + " " + say("en", 90)])[0][0] == "de"
    (_, zero), (und, _), (mixed_lang, share) = reader.read(["", "12 ?!", say("fr", 200) + " " + say("en", 100)])
    assert zero == 0 and und == "und" and mixed_lang == "fr" and 0.6 < share < 0.73
    assert (np.diag(model.step) > model.step.max(1, initial=-9, where=~np.eye(3, dtype=bool))).all()  # staying beats switching
    table = texts(spark, [say(lang, 30) for lang in WORDS for _ in range(30)] + [None, "", "...", say("en", 9000)])
    labelled = spark.createDataFrame([(i, say(lang, 30), lang) for i, lang in enumerate(list(WORDS) * 30)] + [(900, "x", None), (None, "y", "en")], "doc_id bigint, text string, lang string")
    got = langid.identify(table, langid.train(langid.sample(labelled)))
    assert got.columns == ["doc_id", "ids", "score", "lang_pred", "lang_pred_", "score_"]
    found = {r.doc_id: r.lang_pred_ for r in got.collect()}
    assert [found[i] for i in range(90)] == ["en"] * 30 + ["de"] * 30 + ["fr"] * 30 and [found[i] for i in range(90, 94)] == ["und"] * 3 + ["en"]
    none = langid.train(langid.sample(labelled.limit(0)))
    assert {r.lang_pred_ for r in langid.identify(table, none).collect()} == {"und"}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(600)]
    rows[7] = (7, rows[100][1])
    rows[9] = (9, [2 * x for x in rows[100][1]])
    bad = [(1000, None), (1050, [0.0] * 24), (1100, [float("nan")] * 24), (1150, [float("inf")] + [1.0] * 23), (1200, [None] + [1.0] * 23), (1250, [1.0] * 5), (None, [1.0] * 24)]
    table = spark.createDataFrame([(i, v, "s", 1) for i, v in rows + bad], "vec_id bigint, embedding array<float>, score string, rank int")
    index, codec = ann.build(table)
    assert index.count() == 600
    asked = index.where("vec_id % 50 = 0").select("vec_id", "vector")
    want = {}
    m = np.array([v for _, v in rows], np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -9
        want[q] = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
    for size in (ann.QUERY_BYTES, 600):  # one block of queries, and several
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ann, "QUERY_BYTES", size)
            found = {}
            for r in ann.search(index, codec, asked, 5).orderBy("query_id", "rank").collect():
                found.setdefault(r.query_id, []).append(r.vec_id)
        assert found == want and want[100][:2] == [7, 9]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    index, codec = ann.build(few)
    got = [(r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(index, codec, index.where("vec_id = 0").select("vec_id", "vector"), 5).collect()]
    assert got == [(1, 1, 0.707107), (2, 1, 0.0)]
    index, codec = ann.build(few.limit(0))
    assert ann.search(index, codec, index.select("vec_id", "vector")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    units = ann._unit(rng.normal(size=(3000, 48)) + 2 * rng.normal(size=(1, 48)))
    codec = ann.Codec.fit(units[:500])
    upper = codec.upper(units[:40], *codec.encode(units))
    assert (upper >= units[:40] @ units.T).mean() > 0.995


def test_ragged_rows():
    rows = ragged.Rows(np.int64)
    rows.extend(np.arange(5), np.array([2, 0, 3]))
    flat, ends = rows.gather(np.array([2, 1, 0, 2]))
    assert flat.tolist() == [2, 3, 4, 0, 1, 2, 3, 4] and ends.tolist() == [3, 3, 5, 8]
    assert "".join(ragged.windows("ab cd ef gh", 3)) == "ab cd ef gh" and len(list(ragged.windows("x" * 99, 3))) == 1
    assert list(ragged.packs(["aa", None, "bbb"], 2)) == [["aa"], ["", "bbb"]]


def test_idle_workers_hold_little(monkeypatch):
    """Beside a JVM at its full size: caches are bounded, tasks give back what they held, and no vocabulary is parsed twice."""
    terms = toxicity.Terms()
    for at in range(0, 300_000, 50_000):
        terms.of(" ".join(f"w{i}" for i in range(at, at + 50_000)))
        assert len(terms.words) <= ragged.CACHED_WORDS + 50_000
    given = []
    monkeypatch.setattr(ragged, "give_back", lambda: given.append(1))
    assert list(ragged.giving_back(iter)([1, 2])) == [1, 2] and len(given) == 1
    cut_short = ragged.giving_back(iter)([1, 2])
    next(cut_short)
    cut_short.close()
    assert len(given) == 2
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    assert len(repr(packing.steps_of(source))) < len(source) // 100
    assert packing.FastTokenizer(source, cached_words=7).parts.limit == 7
    known, text = packing.FastTokenizer(source, packing.steps_of(source)), "Çà et là, 3 mots\x01 d'AVANT don't ~x"
    assert known.encode([text])[0].tolist() == known.whole(text)
