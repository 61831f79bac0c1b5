"""Exact dedup, line dedup, URL rules and WARC archives on small tables."""

import gzip
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from recalloom.llm import exact_dedup, line_dedup, url_filter, warc
from recalloom.llm.common import scratch

DOCS = "doc_id bigint, text string, digest string, id string, keep_id string"
PAGES = "page_id bigint, url string, html string, host string, verdict string, id string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "d", "i", "k") for i, t in rows], DOCS)


def test_equal_texts_give_way_to_the_smallest_id(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (7, None), (8, ""), (1, "x"), (1, "x"), (None, "x"), (None, "z"), (None, "z"), (2, "A b")]
    got = exact_dedup.deduplicate(docs(spark, *rows), exact_dedup.run_index(spark)).collect()
    groups = {}
    for r in got:
        groups.setdefault(bytes(r.digest), []).append(r)
    assert len(got) == len(rows)
    for text, ids, keep in (("a b", [3, 5], 3), ("a b ", [9], 9), ("", [7, 8], 7), ("x", [1, 1, None], 1), ("z", [None, None], None), ("A b", [2], 2)):
        group = groups[hashlib.sha256(text.encode()).digest()]
        assert sorted(r.id or 99 for r in group) == sorted(i or 99 for i in ids)
        assert {(r.keep_id, r.group_size) for r in group} == {(keep, len(ids))}
        assert [r.id for r in group if r.kept] == [keep]


def test_index_outlives_the_batch_and_the_object(spark):
    path = scratch(spark, "index")
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert {r.id: r.kept for r in exact_dedup.deduplicate(docs(spark, (4, "p"), (5, "q")), first).collect()} == {4: True, 5: True}
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    got = exact_dedup.deduplicate(docs(spark, (1, "p "), (2, "p"), (3, "r"), (6, "r")), again).collect()
    assert {(r.id, r.keep_id, r.kept, r.group_size) for r in got} == {(1, 1, True, 1), (2, 4, False, 1), (3, 3, True, 2), (6, 3, False, 2)}
    assert again.table().count() == 4 and again.table().select("digest").distinct().count() == 4
    assert exact_dedup.deduplicate(docs(spark), again).count() == 0


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.run_index(spark, buckets=4)
    exact_dedup.deduplicate(docs(spark, (1, "a")), index).count()
    batch = docs(spark, (2, "b")).select(exact_dedup.digest(F.col("text")).alias("digest"))
    plan = batch.hint("merge").join(index.table().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text


def test_kept_rows_keep_their_columns(spark):
    table = docs(spark, (2, "a b"), (1, "a  b"), (3, None), (3, None), (None, "a b"), (4, "c"))
    kept = exact_dedup.kept_rows(table, exact_dedup.run_index(spark))
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a  b"), (3, None), (4, "c")]
    assert exact_dedup.kept_rows(docs(spark), exact_dedup.run_index(spark)).count() == 0


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "h", "v", "i") for i, u, h in rows], PAGES)


def test_lines_on_most_pages_of_a_site_go(spark):
    menu, url = "<ul><li>Home</li><li>News</li></ul>", "http://A.example/x"
    rows = [(1, url, menu + "<p>one</p><p>one</p>"), (2, url, menu + "<p>two</p>"), (3, "https://a.EXAMPLE?q", "<p>Home</p><p>three</p>"),
            (4, "http://b.example/", menu), (5, None, menu), (6, "no scheme", menu), (7, url, None), (8, url, ""), (9, url, "<p>x</p>")]
    got = {r.id: r for r in line_dedup.drop_boilerplate(pages(spark, *rows), max_ratio=0.4).collect()}
    # Six pages of a.example: Home is on three of them, News on two.
    assert got[1].lines == ["Home", "News", "one", "one"] and got[1].kept == ["News", "one", "one"]
    assert got[3].kept == ["three"] and got[4].kept == got[5].kept == got[6].kept == ["Home", "News"]
    assert got[7].lines == got[8].kept == [] and got[5].host == ""
    exact = {r.id: r.kept for r in line_dedup.drop_boilerplate(pages(spark, *rows), max_ratio=0.5).collect()}
    assert exact[1] == ["Home", "News", "one", "one"]  # exactly the ratio is not above it
    assert line_dedup.drop_boilerplate(pages(spark)).count() == 0


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice('abc')}.example/{i}", "".join(f"<p>{rng.choice('uvwxyz')}</p>" for _ in range(rng.randint(0, 6)))) for i in range(60)]
    sites = {}
    for _, u, h in rows:
        sites.setdefault(u.split("/")[2], []).append(set(re.findall(r"<p>(.)", h)))
    for r in line_dedup.drop_boilerplate(pages(spark, *rows)).collect():
        site = sites[r.host]
        assert r.kept == [x for x in r.lines if sum(x in s for s in site) * 2 <= len(site)]


def test_ads_that_rotate_over_a_site_go(spark):
    # Forty pages take turns with five ads; eight pages share one ad per two; each page has a line of its own.
    rows = [(i, f"http://big.example/{i}", f"<p>ad {i % 5}</p><p>text {i}</p><p>pair {i // 2}</p><p>rare {i // 4}</p>") for i in range(40)]
    rows += [(100 + i, f"http://small.example/{i}", f"<p>ad {i % 2}</p><p>{'most' if i < 5 else 'few'}</p>") for i in range(8)]
    got = {r.id: r.kept for r in line_dedup.drop_boilerplate(pages(spark, *rows), rotating_ratio=line_dedup.ROTATING_RATIO).collect()}
    assert all(got[i] == [f"text {i}", f"pair {i // 2}", f"rare {i // 4}"] for i in range(40))
    # Four of eight pages are neither more than half nor five.
    assert all(got[100 + i] == [f"ad {i % 2}"] + ["few"] * (i >= 5) for i in range(8))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
         ("block", "a.b.org", ""), ("allow", "a.b.org", "/x/y"), ("block", "a.b.org", "/x/yz/q")]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h.split(".")), len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


def test_url_rules_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["net", "NET", "x.example.net", "myexample.net", "example.com", "www.Example.Com", "q.org", "a.b.org", "z.a.b.org", "b.org", "", "net.", "example.net:80", "É.net"]
    paths = ["", "/", "/en/", "/en", "/en/a?/de/", "/de/#x", "/fr/x", "/x/y", "/x/yz/q", "/x/yz/qq/r", "/x/", "//en/", "?/en/"]
    urls = [None, "", "net/", "://", "http://", "a://b://net/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    got = url_filter.judge(pages(spark, *[(i, u, None) for i, u in enumerate(urls)]), RULES)
    assert got.columns[:6] == ["page_id", "url", "html", "host", "verdict", "id"]
    for r in got.collect():
        assert (r["host_"], r["path"], r["rule"], r["verdict_"]) == brute(r["url"]), r["url"]
    assert url_filter.judge(pages(spark), RULES).count() == 0
    assert {r.verdict_ for r in url_filter.judge(pages(spark, (1, "http://a.net/", None)), []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.Trie([("allow", "a", "/"), ("block", "a", "/")])


def read_back(spark, path):
    return warc.read_archives(spark, path).collect()


def test_archives_round_trip(spark):
    long = "é" * 200_000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"
    rows = [(1, "http://a/\r\nb", "same"), (7, "u", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", long), (8, "u", "one"), (8, "u", "one"), (None, "u", "same"), (None, "u", "lone")]
    path = scratch(spark, "warc")
    warc.write_archives(pages(spark, *rows), path)
    got = warc.read_archives(spark, path).withColumn("page", warc.page_of(F.col("record_id"))).withColumn("last", warc.page_of(F.col("refers_to"))).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    seen = sorted((r.page or 0, r.record_type, r.last, r.payload_length) for r in got)
    assert seen == sorted([(0, "revisit", 7, 4), (0, "response", None, 4), (1, "revisit", 7, 4), (3, "revisit", 7, 4), (4, "revisit", 5, 0), (5, "response", None, 0),
                           (6, "response", None, len(long.encode())), (7, "response", None, 4), (8, "response", None, 3), (8, "response", None, 3)])
    assert next(r for r in got if r.page == 6).payload == long.encode()
    assert next(r for r in got if r.page == 1).uri == "http://a/%0D%0Ab"
    small = scratch(spark, "warc")
    warc.write_archives(pages(spark, *rows), small, min_revisit_bytes=4)
    assert sum(r.record_type == "revisit" for r in read_back(spark, small)) == 3
    none = scratch(spark, "warc")
    warc.write_archives(pages(spark), none)
    assert read_back(spark, none) == []


def archive(spark, n=6):
    path = scratch(spark, "warc")
    warc.write_archives(pages(spark, *[(i, "u", f"page {i} " + "x" * 50 * i) for i in range(n)]).coalesce(1), path)
    folder = path.removeprefix("file:")
    name = next(f for f in os.listdir(folder) if f.startswith("part"))
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def cover(data):
    """Spans found, after checking that they cover all bytes in order (records of a member share its span)."""
    at, out = 0, []
    for kind, start, end, what in warc.salvage(data):
        assert start == at or (out and (start, end) == out[-1][1:3])
        at = end
        out.append((kind, start, end, what))
    assert at == len(data)
    return out


def test_salvage_goes_on_after_damage(spark):
    data = archive(spark)
    starts = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", data)]
    ids = lambda found: [x[3]["headers"]["warc-record-id"][12:-1] for x in found if x[0] == "record"]
    gaps = lambda found: [x[1:3] for x in found if x[0] == "gap"]
    assert ids(cover(data)) == list("012345") and not gaps(cover(data))
    flipped = bytearray(data)
    flipped[starts[3] - 10] ^= 1  # inside the block of record 2
    assert ids(found := cover(bytes(flipped))) == list("01345") and gaps(found) == [(starts[2], starts[3])]
    length = data[:starts[1]] + data[starts[1]:].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert ids(cover(length)) == list("02345")
    cut = data[:starts[5] + 40]
    assert ids(found := cover(cut)) == list("01234") and gaps(found) == [(starts[5], len(cut))]
    assert ids(found := cover(b"junk" + data[starts[0] + 3:])) == list("12345") and found[0][:2] == ("gap", 0)
    lost = data[:starts[2] + 200] + data[starts[3] + 200:]  # two records run together
    assert ids(cover(lost)) == list("0145")
    assert cover(b"") == [] and gaps(cover(b"WARC/1.1\r\n")) == [(0, 10)]
    rng = random.Random(3)
    for _ in range(200):
        broken = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(broken))
            broken[a:a + rng.randint(0, 60)] = bytes(rng.randrange(256) for _ in range(rng.randint(0, 60)))
        cover(bytes(broken))


def test_salvage_of_gzip_members(spark):
    data = archive(spark)
    starts = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", data)] + [len(data)]
    members = [gzip.compress(data[a:b], mtime=0) for a, b in zip(starts, starts[1:])]
    ids = lambda found: [x[3]["headers"]["warc-record-id"][12:-1] for x in found if x[0] == "record"]
    assert ids(cover(b"".join(members))) == list("012345")
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    found = cover(b"".join([*members[:2], bytes(broken), *members[3:]]))
    assert ids(found) == list("01345")
    at = len(members[0]) + len(members[1])
    assert [x[1:3] for x in found if x[0] == "gap"] == [(at, at + len(broken))]
    assert ids(cover(members[0] + data[starts[1]:starts[2]] + members[2][:-3])) == list("01")


def test_a_batch_run_again_keeps_the_same_rows(spark, tmp_path):
    from recalloom.llm import exact_dedup

    docs = spark.createDataFrame([(3, "a  b"), (1, "a b"), (3, "a  b"), (7, "c"), (None, "d"), (None, "d"), (5, None), (5, "")], "doc_id long, text string")
    index = exact_dedup.run_index(spark)

    def decided(batch):
        return sorted(map(str, exact_dedup.deduplicate(batch, index).collect()))

    first = decided(docs)
    # As after a job that was lost between appending its texts and returning its rows.
    assert decided(docs) == first
    assert sum("kept=True" in r for r in first) == 4
    # A smaller id gives way to the one the index holds, which stays when it comes again.
    again = {(r["id"], r["kept"]) for r in exact_dedup.deduplicate(spark.createDataFrame([(0, "a b"), (1, "a b")], docs.schema), index).collect()}
    assert again == {(0, False), (1, True)}
    kept = exact_dedup.kept_rows(docs, index).collect()
    assert len(kept) == 4
