"""The Jaccard join, and the pipeline as a whole, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recalloom.llm import jaccard_join
from recalloom.llm.common import scratch, stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "n", "i") for i, t in rows], SCHEMA).repartition(3)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """[(id, n_shingles, component)] by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                old, new = comp[x], comp[y]
                comp = [new if c == old else c for c in comp]
    least = {c: min((i for (i, _), k in zip(rows, comp) if k == c and i is not None), default=None) for c in comp}
    return sorted(((i, len(s), least[c] if s else i) for (i, _), s, c in zip(rows, sets, comp)), key=repr)


def families(seed, n):
    """Chains of texts, each near to the next only, stars of near copies, and texts that share long passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            words[len(words) // 2:len(words) // 2] = passage
        kind = rng.random()
        for _ in range(rng.randint(1, 12) if kind < 0.6 else 1):
            rows.append(" ".join(words))
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                changed[rng.randrange(len(words))] = word()
            if kind < 0.3:
                words = changed
            else:
                rows.append(" ".join(changed).upper())
    rows += [None, "", " \t", "a", "a b c d", "A  b\nc d", "a b c", *["same text of six words here"] * 4]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)] + [(None, "same text of six words here"), (None, "lone null id text"), (5, "x y"), (5, "x y")]


@pytest.mark.parametrize("leaf, pivots", [(4096, 16), (2, 1)])
def test_components_against_brute_force(spark, monkeypatch, leaf, pivots):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "STAR", min(leaf, 64))
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    rows = families(3, 30)
    got = jaccard_join.join(table(spark, rows))
    assert got.columns == ["id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_regions_go_on_through_cells(spark, monkeypatch):
    """One region of many components: every link must be found in some cell."""
    monkeypatch.setattr(jaccard_join, "LEAF", 3)
    monkeypatch.setattr(jaccard_join, "STAR", 3)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rows = [r for r in families(8, 12) if shingles(r[1]) and r[0] is not None]
    docs = table(spark, rows)
    found = stored(jaccard_join.nodes_and_counts(jaccard_join._texts(docs, "doc_id", "text")), "nodes")
    named = found.where("slice is null").select("id", "text_hash", "n", "node", "mark")
    space = jaccard_join._Space(docs, "doc_id", "text", named)
    members = named.groupBy("node").agg(F.first("n").alias("n")).select(F.lit(1).cast("bigint").alias("region"), "node", "n", F.col("n").alias("rest"), F.lit(None).cast("double").alias("distance"))
    jaccard_join.resolve(space, stored(members, "members"))
    got = sorted(map(tuple, jaccard_join._named(space, named).collect()), key=repr)
    assert got == brute(rows)


def long_texts():
    """Long texts that share a passage, and near copies of one of them, with second marks of two widths."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(9)]
    texts = [passage + [f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (1990, 2000, 2010, 2030, 2090)]
    near = [texts[2][:-k] + [f"n{k}"] * 2 for k in (3, 40)] + [texts[2] + [f"x{i}" for i in range(90)], texts[2] + [f"y{i}" for i in range(900)]]
    return [(i, " ".join(w)) for i, w in enumerate(texts + near)]


def test_sets_of_long_unrelated_texts_are_not_read(spark):
    docs = table(spark, [r for r in long_texts() if r[0] < 5])
    found = stored(jaccard_join.nodes_and_counts(jaccard_join._texts(docs, "doc_id", "text")), "nodes")
    named = found.where("slice is null").select("id", "text_hash", "n", "node", "mark")
    space = jaccard_join._Space(docs, "doc_id", "text", named)
    space.measure(named.select(F.col("node").alias("a")).crossJoin(named.select(F.col("node").alias("b"))).where("a < b"))
    assert space.measured.count() == 10 and space.measured.where("linked or distance is not null").count() == 0
    assert space.sets is None


def test_a_full_word_cache_changes_no_set(monkeypatch):
    texts = [t.encode() for _, t in families(6, 6) if t]
    want = [s.tolist() for s in jaccard_join.Shingler().sets(texts)]
    monkeypatch.setattr(jaccard_join, "CACHED_WORDS", 3)
    small = jaccard_join.Shingler()
    assert [s.tolist() for s in small.sets(texts)] == want and len(small.words) < 200


def test_links_of_long_texts(spark):
    rows = long_texts()
    got = jaccard_join.join(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert [c for _, _, c in brute(rows)] == [0, 1, 2, 3, 4, 2, 2, 2, 8]


def test_stars_reach_the_smallest_node(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (5, 5)]
    random.Random(1).shuffle(chain)
    got = dict(map(tuple, jaccard_join.components(stored(spark.createDataFrame(chain, "a bigint, b bigint"), "links")).collect()))
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_empty_and_one_of_each(spark):
    assert jaccard_join.join(table(spark, [])).count() == 0
    rows = families(4, 8)
    kept = jaccard_join.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    got, want = kept.collect(), brute(rows)
    # A component without shingles is one row; others are told by their smallest id, or share no id.
    named = {c for i, n, c in want if n and c is not None}
    assert sorted(r.doc_id for r in got if shingles(r.text) and r.doc_id is not None) == sorted(named)
    assert sum(1 for r in got if not shingles(r.text)) == sum(1 for _, n, _ in want if not n)
    assert [r.text for r in got if r.doc_id is None] == ["lone null id text"]


def corpus(spark):
    rng = random.Random(7)
    say = {"en": "the house and with other thing some time people year".split(), "fr": "la maison et avec autre chose temps monde an jour".split()}
    rows, labels = [], []
    for i in range(240):
        lang = "en" if i % 3 else "fr"
        words = [rng.choice(say[lang]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(30, 90))]
        if i % 5 == 0:
            words[10:10] = ["you", "idiot"]
        rows.append((i, " ".join(words), lang, int(i % 5 == 0)))
    clean = [r for r in rows if not r[3]]
    rows += [(300 + k, t.replace(" ", "\n "), lang, 0) for k, (_, t, lang, _) in enumerate(clean[:15])]  # equal texts
    rows += [(400 + k, t + " end", lang, 0) for k, (_, t, lang, _) in enumerate(clean[10:40])]  # near copies
    rows += [(500, "12 34 !", None, 0), (501, None, None, 0), (502, "", "en", 0)]
    path = scratch(spark, "corpus")
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, _, y in rows[:240]], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_pipeline_against_brute_force(spark):
    path, rows = corpus(spark)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "ngram_jaccard_join", "best_fit_packing"]
    left = [(i, t, y) for i, t, _, y in rows if re.search("[a-z]", t or "")]
    want = [{i for i, _, _ in left}]
    left = [(i, t) for i, t, y in left if "idiot" not in t]
    want.append({i for i, _ in left})
    first = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"\s+", " ", t), i)
    left = [(i, t) for i, t in left if first[re.sub(r"\s+", " ", t)] == i]
    want.append({i for i, _ in left})
    want.append({c for _, _, c in brute(left)})
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = stored(stage(spark, docs, path), name)
        assert docs.columns == columns and sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(ids), name
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == want[-1] and len(want[3]) < len(want[2]) < len(want[1]) < len(want[0])
