"""Dictionary segmentation against all segmentations of short texts, and as a tokenizer of a search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recalloom.__main__ import main
from recalloom.functions import segmentation as seg
from recalloom.operators import bm25, segmentation


def every_path(text, words, unknown):
    """The best of all ways to cut, as (weight, lengths): heaviest, then longest first words."""
    if not text:
        return 0, ()
    options = []
    for n in range(1, len(text) + 1):
        weight = words.get(text[:n], unknown if n == 1 else None)
        if weight is not None:
            rest, lengths = every_path(text[n:], words, unknown)
            options.append((weight + rest, (n, *lengths)))
    return max(options)


def pieces(text, words, unknown):
    out, at, stray = [], 0, False
    for n in every_path(text, words, unknown)[1]:
        piece = text[at:at + n]
        if stray and piece not in words:
            out[-1] += piece
        else:
            out.append(piece)
        stray, at = piece not in words, at + n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_best_of_all_segmentations(seed):
    rng = random.Random(seed)
    letters = "ab借阅𠀀"
    # Few different weights, so that many paths are equally heavy.
    words = {"".join(rng.choices(letters, k=rng.randint(1, 4))): -rng.randint(1, 4) for _ in range(rng.randint(0, 25))}
    trie = seg.Trie.build(list(words), list(words.values()), -5)
    runs = ["".join(rng.choices(letters + "z", k=rng.randint(0, 11))) for _ in range(120)]
    got = seg.segment_runs(runs, trie)
    assert got == [pieces(r, words, -5) for r in runs]
    assert ["".join(p) for p in got] == runs


def test_edges_of_input():
    trie = seg.Trie.build(["aa", "", "aa"], [-9, -1, -2], -3)
    assert trie.weights[1].tolist() == [-2]
    assert seg.segment_runs([], trie) == [] and seg.segment_runs(["", ""], trie) == [[], []]
    empty = seg.Trie.build([], [], 0)
    assert seg.segment_runs(["abc", "", "d"], empty) == [["abc"], [], ["d"]]
    # One run of 300,000 characters: no table of the square of its length.
    assert seg.segment_runs(["aa" * 150_000], trie) == [["aa"] * 150_000]
    old, seg.BLOCK_CHARS = seg.BLOCK_CHARS, 3
    try:
        import pyarrow as pa

        lists = pa.array([["aaaa", "x"], None, [], ["", "aab", None]])
        assert seg.segment_lists(lists, trie, 1).to_pylist() == [["aa", "aa", "x"], [], [], ["aa", "b"]]
        assert seg.segment_lists(lists, trie, 2).to_pylist() == [["aa", "aa"], [], [], ["aa"]]
    finally:
        seg.BLOCK_CHARS = old


def test_dictionary_counts_and_search_without_blanks(spark):
    rng = random.Random(1)
    vocabulary = ["library", "open", "hours", "loan", "period", "renew", "book", "card", "the", "a", "is"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) + "." for _ in range(60)] + [None, "", "--", "Rare once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    counts = {r["word"]: r for r in segmentation.word_counts(docs, share=0.05).collect()}
    spoken = [t.lower().replace(".", "").split() if t and t != "--" else [] for t in texts]
    want = {w: (sum(w in t for t in spoken), sum(t.count(w) for t in spoken)) for w in vocabulary}
    want = {w: c for w, c in want.items() if c[0] >= 0.05 * len(texts)}
    assert {w: (r["texts"], r["n"]) for w, r in counts.items()} == want and "rare" not in counts
    total = sum(n for _, n in want.values())
    assert all(r["weight"] == round(math.log(r["n"] / total) * seg.SCALE) for r in counts.values())

    dictionary = segmentation.fit(segmentation.word_counts(docs, share=0.05))
    cut = segmentation.dictionary_tokenizer(dictionary, least=1)
    glued = docs.withColumn("text", F.regexp_replace("text", r"\s+", ""))
    rows = {r["chunk_id"]: r["t"] for r in glued.select("chunk_id", cut(F.col("text")).alias("t")).collect()}
    assert [rows[i] for i in range(60)] == spoken[:60] and rows[60] == rows[61] == rows[62] == []

    # Blanks or not, a search gives the same list.
    tokenizer = segmentation.dictionary_tokenizer(dictionary)
    asked = spark.createDataFrame([(1, "renew loan"), (2, "card"), (3, None)], "query_id long, question string")
    spaced = bm25.sparse_topk(bm25.fit(docs.where("chunk_id < 60").withColumnRenamed("text", "index_text")), asked, 5)
    unspaced = bm25.sparse_topk(bm25.fit(glued.where("chunk_id < 60").withColumnRenamed("text", "index_text"), tokenizer=tokenizer),
                                asked.withColumn("question", F.regexp_replace("question", " ", "")), 5, tokenizer=tokenizer)
    assert sorted(map(tuple, spaced.collect())) == sorted(map(tuple, unspaced.collect()))


def test_dictionary_files_and_limits(spark, tmp_path, monkeypatch):
    (tmp_path / "words.txt").write_text("借阅 50 v\n期限 30\n\n借阅 20\n图书馆\n坏 x\n", encoding="utf-8")
    words = segmentation.read_dictionary(spark, str(tmp_path))
    assert sorted(map(tuple, words.collect())) == sorted([("借阅", 50), ("期限", 30), ("图书馆", 1), ("坏", 1)])
    cut = segmentation.dictionary_tokenizer(segmentation.fit(words))
    text = spark.createDataFrame([("图书馆借阅期限，有多长？",)], "t string")
    assert text.select(cut(F.col("t"))).first()[0] == ["图书馆", "借阅", "期限", "有多长"]
    none = segmentation.fit(words.where("false"))
    assert text.select(segmentation.dictionary_tokenizer(none)(F.col("t"))).first()[0] == ["图书馆借阅期限", "有多长"]
    monkeypatch.setattr(segmentation, "MAX_CHARS", 3)
    with pytest.raises(ValueError):
        segmentation.fit(words)
    assert np.iinfo(np.int64).min == seg.ABSENT


def test_command_line_takes_a_dictionary(spark, tmp_path, capsys):
    (tmp_path / "words.txt").write_text("借阅 50\n期限 30\n有 9\n多长 8\n", encoding="utf-8")
    where = ["--datasets", str(tmp_path / "d"), "--store", str(tmp_path / "s"), "--kb", "demo", "--dictionary", str(tmp_path / "words.txt")]
    main(["demo", *where])
    main(["build", "--pure", "--chunker", "fixed_1100", *where])
    capsys.readouterr()
    main(["search", "借阅期限有多长", "--retriever", "bm25", "--top-k", "2", *where])
    assert "三十天" in capsys.readouterr().out
