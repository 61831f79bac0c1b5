import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, duck  # noqa: E402
from recalloom.__main__ import main  # noqa: E402

SMALL = "/root/testdata/sf0.001"
# The rest runs through tools/check_queries.py, which needs minutes.
QUICK = ["bm25_stats", "bm25_vocab", "chunk_char_window_overlap", "chunk_header_chain", "chunk_paragraph",
         "clean_markup", "cost_report", "dictionary_words", "file_ref_match", "fuse_weighted", "json_salvage", "points_validate",
         "recall_per_question", "score_compute", "search_dense_topk", "search_segmented", "search_sparse_topk", "sections_headed", "segment_unspaced"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    ok, line = compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, SMALL, duck(SMALL))
    assert ok, line


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_commands(spark, tmp_path, capsys):
    where = ["--datasets", str(tmp_path / "d"), "--store", str(tmp_path / "s"), "--kb", "demo"]
    main(["strategies"])
    assert "parent_child_v2" in capsys.readouterr().out
    main(["demo", *where])
    main(["build", "--pure", "--chunker", "fixed_1100", *where])
    assert '"fixed_1100": 6' in capsys.readouterr().out
    main(["search", "借阅期限有多长", "--retriever", "bm25", "--top-k", "2", *where])
    assert "三十天" in capsys.readouterr().out
    book = glob.glob(str(tmp_path / "d" / "test_set" / "*.xlsx"))[0]
    main(["recall", "--test-set", book, "--variable", "retriever", "--retrievers", "bm25", "--top-k", "1,2",
          "--name", "first", "--output", str(tmp_path / "o"), *where])
    main(["report-summary", str(tmp_path / "o")])
    page = open(tmp_path / "o" / "summary.html", encoding="utf-8").read()
    assert "single_rate_top1" in page and "bm25" in page
    with pytest.raises(SystemExit):
        main(["prepare", book, *where])
