import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from recalloom.functions import coverage, text


def column(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_clean_drops_images_and_links_with_their_text(spark):
    got = column(spark, text.clean_markdown, ["a![x](y)b[see](z)c", "[a]\n(b)", "![i](u)(v)", "x[[n](m)]"])
    assert got == ["abc", "[a]\n(b)", "(v)", "x]"]


def test_strip_matches_python(spark):
    samples = ["　a b \n", "\x1c\x85x ", "", " \t", "no", "​z"]
    assert column(spark, text.strip, samples) == [s.strip() for s in samples]


def test_tokenizers(spark):
    assert column(spark, text.word_tokens, ["It's A été, x1 9"]) == [["it", "été", "x1"]]
    assert column(spark, text.cjk_bigram_tokens, ["公积金 ab"]) == [["公积", "积金", "ab"]]


def test_charset(spark):
    assert column(spark, text.keep_charset, ["a一b鿿c1"]) == ["一鿿"]
    assert column(spark, lambda c: text.keep_charset(c, "alnum"), ["A-b 1一"]) == ["ab1一"]


def test_file_reference_normalisation(spark):
    names = [" 办法 A.pdf ", "Ｇｕｉｄｅ．docx", "guide.docx", "02第二册 说明.md", "0第3册", "第一册.doc", "x.PDF"]
    want = ["办法A", "Guide.docx", "guide", "第二册说明", "0第3册", "第一册", "x.PDF"]
    assert column(spark, text.normalise_file_ref, names) == want
    assert unicodedata.normalize("NFKC", "Ｇ") == "G"


@pytest.mark.parametrize("ref,src,aliases,want", [
    ("a", "a", [], True), ("book-chapter", "book", [], True), ("boo", "book", [], True),
    ("", "a", [], False), ("a", "", [], False), ("x1", "y1", [], False), ("x1", "y1", [("x", "y")], True)])
def test_file_match(spark, ref, src, aliases, want):
    row = spark.createDataFrame([(ref, src)], "r string, s string")
    assert row.select(text.file_match(F.col("r"), F.col("s"), aliases)).first()[0] is want


def test_json_salvage(spark):
    replies = ['{"k": 1}', '```json\n{"k": 2}\n```', 'so {"k": 3} ok', '{"k": ', "none", None]
    got = column(spark, lambda c: text.salvage_json(c, "k int")["k"], replies)
    assert got == [1, 2, 3, None, None, None]


def test_coverage_values():
    assert coverage.block_coverage("abc", "abc", False) == 1
    assert coverage.block_coverage("abc", "xyz", False) == 0
    assert coverage.block_coverage("", "abc", True) == 0
    # Matching is greedy, so a longer text may cover less.
    assert coverage.block_coverage("bacadddd", "badaddad", False) == 0.75
    assert coverage.block_coverage("bacadddd", "badaddadcbacaaaa", False) == 0.5


def test_coverage_floor_keeps_every_flag():
    import random
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30)))
        b = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 300)))
        for junk in (True, False):
            plain = sum(m.size for m in SequenceMatcher(None, a, b, junk).get_matching_blocks()) / len(a)
            assert (coverage.block_coverage(a, b, junk, 0.7) >= 0.7) == (plain >= 0.7)


def test_matched_chars_equals_difflib():
    import random
    rng = random.Random(11)
    for n in range(400):
        letters = "abcdefghijklmnopqrstuvwxyz"[:rng.choice([2, 4, 8, 26])]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([20, 300, 600]))))
        if n % 3 == 0:
            at = rng.randint(0, len(b))
            b = b[:at] + a[: rng.randint(0, len(a))] + b[at:]
        for junk in (True, False):
            want = sum(m.size for m in SequenceMatcher(None, a, b, junk).get_matching_blocks())
            assert coverage.matched_chars(a, b, junk) == want, (a, b, junk)
    assert coverage.matched_chars("abcd", "xbcx", False) == 2


def test_long_texts_take_memory_in_proportion():
    import random
    import tracemalloc
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200_000))
    # The shorter text is a part of the longer one with one letter changed in the middle.
    other = text[:90_000] + "#" + text[90_001:180_000]
    tracemalloc.start()
    assert coverage.matched_chars(other, text, False) == 179_999
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 4000 * len(text)


def test_blocks_as_recursive_sql_equal_difflib():
    import random

    import duckdb

    from recalloom.plans import evaluation_queries

    rng, rows = random.Random(4), []
    for n in range(60):
        letters = "abcdefghijklmnop"[:rng.choice([2, 4, 8, 16])]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        rows.append((n, a, "".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([20, 300])))), n % 2 == 0))
    con = duckdb.connect()
    con.execute("CREATE TABLE pr (pid INT, a VARCHAR, b VARCHAR, junk BOOLEAN)")
    con.executemany("INSERT INTO pr VALUES (?, ?, ?, ?)", rows)
    got = dict(con.execute(f"WITH RECURSIVE {evaluation_queries.blocks_sql('pr')} SELECT pid, coverage FROM covered").fetchall())
    for n, a, b, junk in rows:
        want = sum(m.size for m in SequenceMatcher(None, a, b, junk).get_matching_blocks()) / max(len(a), 1)
        assert abs(got[n] - want) < 1e-9
        assert abs(coverage.block_coverage(a, b, junk) - want) < 1e-9
