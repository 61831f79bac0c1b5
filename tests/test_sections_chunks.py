import random
import re

import pytest
from pyspark.sql import functions as F

from recalloom.functions.splitting import guarded_chunks, recursive_split
from recalloom.operators import chunkers, enrich, sections

MD = {
    "levels": "intro\n# A\n" + "a" * 60 + "\n## B\n" + "b" * 60 + "\n### C\n" + "c" * 60 + "\n## D\n" + "d" * 60,
    "swallow": "#\nnext line\n" + "x" * 60 + "\n## two\n" + "y" * 60,
    "single": "pre " * 20 + "\n# only\n" + "z" * 60,
    "ordinal": "前言\n一、总则\n" + "条" * 60 + "\n二、附则\n" + "款" * 60,
    "mixed": "# h\n" + "p" * 50 + "\n一、not a heading\n## i\n" + "q" * 50,
    "short": "# s\n" + "k" * 45 + "\n# t\n" + "k" * 46 + "\n",
    "plain": "w" * 80, "empty": "", "tiny": "w" * 49,
    "twice": "# same\n" + "m" * 60 + "\n# same\n" + "n" * 60,
}


def brute_sections(text):
    found = [(m.start(), len(m.group(1)), m.group(2).strip())
             for m in re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M)]
    if not found:
        found = [(m.start(), 1, m.group(0).strip())
                 for m in re.finditer(r"^([一二三四五六七八九十]+)、(.+)$", text, re.M)]
    if len(found) <= 1:
        found = [(0, 1, "正文")]
    ends = [f[0] for f in found[1:]] + [len(text)]
    return [(i, t, lv, s, e, text[s:e].strip()) for i, ((s, lv, t), e) in enumerate(zip(found, ends))
            if len(text[s:e].strip()) >= 50]


def test_sections_match_brute_force(spark):
    docs = spark.createDataFrame(list(MD.items()), "file_id string, text string")
    got = {}
    for r in sections.detect_sections(docs).orderBy("file_id", "section_idx").collect():
        got.setdefault(r.file_id, []).append(
            (r.section_idx, r.title, r.level, r.start, r.end, r.section_text))
    assert got == {k: v for k, v in ((k, brute_sections(t)) for k, t in MD.items()) if v}


def test_header_chain(spark):
    docs = spark.createDataFrame([("d", MD["levels"]), ("p", "plain text")], "file_id string, text string")
    rows = sections.header_sections(docs).withColumn("p", chunkers.header_prefix(F.col("headers")))
    got = {(r.file_id, r.section_idx): r.p for r in rows.collect()}
    assert got == {("d", 0): "", ("d", 1): "# A", ("d", 2): "# A > ## B", ("d", 3): "# A > ## B > ### C",
                   ("d", 4): "# A > ## D", ("p", 0): ""}
    chunks = chunkers.header_aware(sections.header_sections(docs), 40, 10)
    texts = [r.index_text for r in chunks.where("file_id = 'd' and section_idx = 3").orderBy("ord").collect()]
    assert len(texts) > 1 and all(t.startswith("# A > ## B > ### C\n") for t in texts)


def test_merge_pages_gives_one_row_per_file(spark):
    pages = spark.createDataFrame([("f", i, f"p{i}") for i in range(2500)] + [("g", 0, "x")],
                                  "file_id string, page_no long, text string").repartition(3)
    rows = {r.file_id: (r.text, r.n_pages) for r in sections.merge_pages(pages).collect()}
    assert rows == {"f": ("".join(f"p{i}\n\n" for i in range(2500)), 2500), "g": ("x\n\n", 1)}


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (7, 6), (1, 0)])
def test_char_windows_rejoin(spark, size, overlap):
    texts = ["", "a", "x" * size, "y" * (size + 1), "字" * 37, "ab\ncd\r\n" * 6, "😀" * 25]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, section_text string")
    got = {}
    for r in chunkers.char_windows(df, size, overlap).orderBy("i", "ord").collect():
        got.setdefault(r.i, []).append(r.index_text)
    for i, text in enumerate(texts):
        want, start = [], 0
        while start < len(text):
            want.append(text[start:start + size])
            if start + size >= len(text):
                break
            start += size - overlap
        assert got.get(i, []) == want


def test_token_windows(spark):
    df = spark.createDataFrame([(1, "a b  c\nd e"), (2, ""), (3, "one")], "i int, section_text string")
    rows = chunkers.token_windows(df, 3, 1).orderBy("i", "ord").collect()
    assert [(r.i, r.index_text) for r in rows] == [(1, "a b  c\n"), (1, "c\nd e"), (3, "one")]


def test_recursive_split_properties():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", "\n", "\n\n", "字", "。", "x" * 9]) for _ in range(rng.randint(0, 80)))
        size = rng.randint(5, 60)
        overlap = rng.randint(0, size - 1)
        chunks = recursive_split(text, size, overlap)
        assert all(c == c.strip() and 0 < len(c) <= size for c in chunks)
        if overlap == 0:
            assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", text)
        at = 0
        for c in chunks:
            found = text.find(c, at)
            assert found >= 0
            at = found


def test_recursive_split_prefers_coarse_separators():
    assert recursive_split("aa bb\n\ncc dd", 7) == ["aa bb", "cc dd"]
    assert recursive_split("aaa bbb ccc", 7) == ["aaa bbb", "ccc"]
    assert recursive_split("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    assert recursive_split("abcdefgh", 3) == ["abc", "def", "gh"]
    assert recursive_split("", 3) == [] and recursive_split(None, 3) == []


def test_guarded_splitter_falls_back(spark):
    def picky(text):
        if len(text) > 3000:
            raise ValueError
        return [text[:5], text[5:]]

    df = spark.createDataFrame([("a" * 10,), ("b" * 3500,)], "t string")
    got = [r[0] for r in df.select(guarded_chunks(F.col("t"), picky)).collect()]
    assert [len(c) for c in got[0]] == [5, 5] and sum(len(c) for c in got[1]) == 3500

    def broken(text):
        raise RuntimeError

    assert [len(c) for c in df.select(guarded_chunks(F.col("t"), broken)).collect()[1][0]] == [3000, 500]


def test_paragraphs_and_index_lines(spark):
    df = spark.createDataFrame([("one\n \ntwo\n\n\n three ",), ("\n\n",)], "section_text string")
    model = lambda c: F.when(F.contains(c, F.lit("two")), F.lit("first idea\nno\n  second idea "))
    rows = chunkers.paragraph_indexes(df, model).orderBy("paragraph_idx", "ord").collect()
    assert [(r.paragraph_idx, r.ord, r.index_text, r.content_text) for r in rows] == [
        (0, 0, "one", "one"), (0, 1, "one", "one"), (1, 0, "two", "two"), (1, 1, "first idea", "two"),
        (1, 2, "second idea", "two"), (2, 0, "three", "three"), (2, 1, "three", "three")]


def test_parent_child(spark):
    df = spark.createDataFrame([("一二三四。五六七八。" * 30,)], "section_text string")
    rows = chunkers.recursive_parent_child(df, 100, 15).collect()
    assert all(len(r.index_text) <= 15 and r.index_text in r.content_text and len(r.content_text) <= 100
               for r in rows)
    assert len({r.parent_idx for r in rows}) > 1


def test_metadata_prefix_skips_empty_parts(spark):
    df = spark.createDataFrame([("办法", "t", "", "f", "body"), ("", "", "", "", "body")],
                               "file_type string, title string, section_summary string, "
                               "file_summary string, index_text string")
    got = [r.index_text for r in enrich.inject_metadata(df).collect()]
    assert got == ["文件类型：办法；章节：t；文件摘要：f\nbody", "body"]


def test_summaries_retry_and_fall_back(spark):
    from recalloom.functions.models import scripted_model

    def play(prompt):
        if "bad" in prompt:
            raise RuntimeError
        return f"<{len(prompt)}>"

    rows = spark.createDataFrame([("f", 0, "a" * 100), ("f", 1, "c" * 6500), ("f", 2, "bad " * 40)],
                                 "file_id string, section_idx int, section_text string")
    out = {r.section_idx: r.section_summary
           for r in enrich.summarise_sections(rows, scripted_model(play)).collect()}
    joined = " ".join(["<2000>"] * 3 + ["<500>"])
    assert out == {0: "<100>", 1: f"<{len(joined)}>", 2: ("bad " * 40)[:80]}
    meta = enrich.file_metadata(
        spark.createDataFrame([("f", 0, "s"), ("g", 0, "")], "file_id string, section_idx int, section_summary string"),
        scripted_model(lambda p: 'ok {"file_type": "办法", "file_summary": "' + p[2:] + '"}'))
    assert {r.file_id: (r.file_type, r.file_summary) for r in meta.collect()} == {
        "f": ("办法", "s"), "g": ("未知", "")}


def test_no_size_switch_in_metadata(spark):
    from recalloom.functions.models import scripted_model

    longest = "w" * 9000  # five windows whose summaries are too long for one call
    rows = spark.createDataFrame([("f", 0, longest)], "file_id string, section_idx int, section_text string")
    model = scripted_model(lambda p: f"{len(p)}|" + p[:1200] if len(p) == 2000 or len(p) == 1000 else f"<{len(p)}>")
    out = enrich.summarise_sections(rows, model).first().section_summary
    assert out.startswith("<")
    many = spark.createDataFrame([("f", i, f"s{i}") for i in range(1200)], "file_id string, section_idx int, section_summary string")
    meta = enrich.file_metadata(many, scripted_model(lambda p: '{"file_type": "t", "file_summary": "%d"}' % len(p.split("\n"))))
    assert meta.first().file_summary == "1200"
    none = enrich.summarise_sections(rows, scripted_model(lambda p: None), fallback_chars=None).first()
    assert none.section_summary is None
