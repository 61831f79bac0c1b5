"""Queries that read all rows and whole texts, on tables in which a part would show."""

import hashlib

import pytest

import __spark_entry__ as entry
from recalloom.operators import recall

LONG = "x" * 79


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("documents", [(1, f"{LONG}a{LONG}\nTitle\n{LONG}", "en", "web"), (2, f"{LONG}b{LONG}", "de", ""), (3, "", "en", "web"),
                        (4, "Title\nx", "fr", "web")], "doc_id bigint, text string, lang string, source string")
    write("labels", [(1, 1, 0)], "doc_id bigint, quality bigint, toxic bigint")
    return tmp_path, write


def run(spark, name, path):
    return entry.queries()[name](spark, str(path)).collect()


def test_sections_without_a_heading_have_an_empty_chain(spark, tables):
    got = {(r.doc_id, r.section_idx): r.chain for r in run(spark, "chunk_header_chain_all", tables[0])}
    assert got[1, 0] == got[2, 0] == "" and got[1, 1] == "### Title" and (3, 0) not in got
    assert (4, 0) not in got and got[4, 1] == "### Title"


def test_injected_summary_reads_the_whole_text_in_every_language(spark, tables):
    got = {r.doc_id: r.index_text for r in run(spark, "inject_metadata_whole", tables[0])}
    for doc, text in ((1, f"{LONG}a{LONG}\nTitle\n{LONG}"), (2, f"{LONG}b{LONG}"), (4, "Title\nx")):
        assert "章节摘要：" + hashlib.md5(text.encode()).hexdigest() in got[doc].split("\n")[0]


def test_attached_summary_reads_all_turns_and_whole_texts(spark, tables):
    path, write = tables

    def summary(case, *turns):
        write(f"{case}/conversations", turns, "conv_id bigint, turn int, role string, text string")
        for name in ("documents", "labels"):
            spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{path}/{case}/{name}.parquet")
        rows = run(spark, "attach_metadata_turns", path / case)
        assert {r.section_summary for r in rows if r.doc_id == 2} == {""}
        return next(r.section_summary for r in rows if r.doc_id == 1)

    first = (1, 0, "user", LONG + "abc")
    base = summary("base", first, (1, 1, "bot", LONG + "def"))
    assert base.startswith("2 turns ")
    assert summary("tail", first, (1, 1, "bot", LONG + "deg")) != base
    assert summary("order", (1, 1, "user", LONG + "abc"), (1, 0, "bot", LONG + "def")) != base


def test_reference_files_are_those_of_the_documents_that_hold_the_item(spark):
    long = "zero one two three four five six seven"
    items = spark.createDataFrame([(1, long), (2, "short one"), (3, long + " eight"), (4, "no such words in any of the documents"), (900, "tail"), (5, None)],
                                  "query_id bigint, gold_answer string")
    docs = spark.createDataFrame([(f"xx{long}yy", "a.pdf"), (f"xx{long}yy", "b.pdf"), (long + " eight", "c.pdf"), (long.replace("seven", "6"), "d.pdf"),
                                  ("a short one, tail", "e.pdf"), (None, "f.pdf"), (f"{long}", None), ("one two three four five", "g.pdf")], "text string, source string")
    got = {r.query_id: r.ref_files for r in recall.with_reference_files(items, docs).collect()}
    assert got == {1: ["a", "b", "c"], 2: ["e"], 3: ["c"], 4: [], 900: ["e"], 5: []}


def test_items_whose_number_is_no_document_count(spark, tables):
    path, write = tables
    write("benchmark", [(77, f"{LONG}b"), (78, "not there at all")], "item_id bigint, text string")
    got = {r.query_id: r for r in run(spark, "recall_per_question_by_content", path)}
    assert got[78].n_ref_files == got[78].single == got[78].file == 0 and got.keys() == {77, 78}
