"""Quality cascade, filter audit and conversation repair against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from recalloom.llm import conversation_repair, filter_audit, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \t\n", "one", "one two", "a b c a b c", "a b a b a b a", "x x x x", "\n\n", "a\n\na\n a\na", "#* $%", "é ü ß\r\nß",
         " ".join(f"words{i}" for i in range(60)), " ".join(["spam eggs ham"] * 20), " ".join(f"words{i}" for i in range(60)) + " ***" * 9,
         "\n".join(["the same long line of words here"] * 3) + " " + " ".join(f"v{i}" for i in range(50)), "LOUD " * 3 + " ".join(f"u{i}" for i in range(300)),
         " ".join(f"Word{i % 97}" for i in range(5000)), "A" * 300 + " " + " ".join(f"words{i}" for i in range(60))]


def brute_measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if twice[w] > 1 for o in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "again"), (None, "a b c a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality_rules.measured(docs).select("text", *quality_rules.MEASURES, "base_failed").collect()
    assert len(got) == len(rows)
    for text, *found in got:
        want = brute_measures(text)
        assert tuple(found[:5]) == want
        assert found[5] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_cascade_order_never_changes_what_stays(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = quality_rules.measured(docs)
    verdicts = {tuple((r["doc_id"], r["kept"]) for r in quality_rules.judge(rows, rules).orderBy("doc_id").collect())
                for rules in (quality_rules.RULES, quality_rules.RULES[::-1], quality_rules.plan(docs))}
    assert len(verdicts) == 1
    kept = {i for i, k in verdicts.pop() if k}
    assert 12 in kept and 14 not in kept and len(TEXTS) - 1 not in kept
    empty = docs.where("false")
    assert quality_rules.filter_quality(empty).count() == 0
    assert [r.name for r in quality_rules.plan(empty)] and len(quality_rules.plan(empty)) == len(quality_rules.RULES)


def test_cascade_takes_the_most_rejections_per_second():
    rules = [quality_rules.Rule(n, lambda t: t.isNull()) for n in ("a", "b", "c")]
    # a rejects 60 for 6, b 30 for 1, c 10 for 0.1, all of them among those of a.
    order = quality_rules.ordered({0b001: 25, 0b011: 25, 0b101: 5, 0b111: 5, 0: 40}, [6.0, 1.0, 0.1], rules)
    assert [r.name for r in order] == ["c", "b", "a"]
    assert [r.rejected for r in order] == [0.1, 0.25, 0.25]
    # A rule left with nothing to reject goes last, however cheap.
    order = quality_rules.ordered({0b11: 10, 0b01: 5}, [1.0, 0.9, ], rules[:2])
    assert [r.name for r in order] == ["a", "b"]


def brute_audit(docs, labels):
    marks = {}
    for i, q, t in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or q == 1, bad or t == 1)
    fails = []
    for i, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        key = (i is None, i or 0)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
             "D": bool(re.search(r"[#$%&*|]", text)), "E": any((t or "") == text and (j is None, j or 0) < key for j, t, _ in docs)}
        fails.append((lang or "", {x for x in f if f[x]}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                shapley[f] += sum(f in x and not x & set(order[:step - 1]) for x, _, _ in mine)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [m for m in mine if f in m[0] and not m[0] & set(order[:step - 1])]
                out[part, "".join(order), step] = (
                    sum(not m[0] & set(order[:step]) for m in mine), len(gone), sum(f in m[0] for m in mine) - len(gone),
                    sum(m[0] == {f} for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone), shapley[f])
    return out


def test_audit_equals_counting_over_all_orders(spark):
    long_text = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", long_text, long_text, "UPPER " * 3, "a$ b", "w " * 300, long_text + " $", long_text, " ".join(["A b"] * 150)]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 3)]
    docs += [(2, long_text, "en"), (2, long_text, "fr"), (None, long_text, "en"), (None, "only here", "fr"), (None, "only here", "fr")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 30, 2)] + [(2, None, 1), (4, 1, None), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, good int")
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(docs, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(table.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def all_repairs(symbols):
    """The least (cost, edits) by trying everything that could be cheapest."""
    best = {}

    def go(at, state, cost, edits, inserts):
        key = (at, state, inserts)
        if key in best and best[key] < (cost, edits) and cost > best[key][0]:
            return
        best[key] = min(best.get(key, (cost, edits)), (cost, edits))
        if inserts < 3:
            go(at, conversation_repair.NEXT[state], cost + 5, edits + "I", inserts + 1)
        if at < len(symbols):
            kind, late = symbols[at]
            go(at + 1, state, cost + 2, edits + "D", 0)
            if kind != "x":
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, kind))
                if to is not None:
                    go(at + 1, to, cost + 5 * late, edits + "K", 0)
                go(at + 1, conversation_repair.NEXT[state], cost + 1 + 5 * late, edits + "R", 0)

    go(0, 0, 0, "", 0)
    return min(v for (at, state, _), v in best.items() if at == len(symbols) and state in (0, 3))


def test_tables_give_the_least_of_the_cheapest_edits():
    table = conversation_repair.tables()
    letters = [("x", 0), *product("sua?", (0, 1))]
    code = {x: 0 if x[0] == "x" else 1 + 2 * conversation_repair.KINDS.find(x[0]) + x[1] for x in letters}
    cases = [c for n in range(4) for c in product(letters, repeat=n)] + [tuple(letters[(7 * i * k + k) % 9] for i in range(6)) for k in range(40)]
    for case in cases:
        symbols = bytes(code[x] for x in case)
        edits, state = table.trace(symbols, conversation_repair.END, 0)
        edits += table.closing(state)[0]
        assert (table.cost(symbols, conversation_repair.END)[0], edits) == all_repairs(case), case


def brute_repair(rows):
    """Damage and repair by a forward search over (cost, edits, lines)."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        role = "user" if damage == 4 else role
        convs[conv] += [] if damage == 0 else [(turn, role, text)] * (2 if damage == 3 else 1)
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in found:
            trimmed = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "" if trimmed[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[0] for r in found if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        states = {0: (0, "", ())}

        def closed(states):
            for _ in range(3):
                for q, (c, e, lines) in list(states.items()):
                    to = 3 if q == 2 else 2
                    way = (c + 5, e + "I", (*lines, "assistant:" if to == 3 else "user:"))
                    states[to] = min(states.get(to, way), way)
            return states

        for (_, role, text), fault in zip(found, faults):
            after = {}
            for q, (c, e, lines) in closed(states).items():
                ways = [(q, (c + 2, e + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    late, to = 5 * (fault == "truncated"), 3 if q == 2 else 2
                    ways.append((to, (c + 1 + late, e + "R", (*lines, ("assistant:" if to == 3 else "user:") + text))))
                    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                    if keep is not None:
                        ways.append((keep, (c + late, e + "K", (*lines, f"{role}:{text}"))))
                for to, way in ways:
                    after[to] = min(after.get(to, way), way)
            states = after
        final = closed(states)
        cost, edits, lines = min(final[q] for q in (0, 3) if q in final)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    roles, ends = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], [".", "!", "", "? ", " "]
    rows = [(c, t if c % 7 else t * 3, roles[(c * 5 + t * 3 + c * t) % 8] if c % 3 else ("user", "assistant")[t % 2], f"text {t % (2 + c % 5)}" + ends[(c + t) % 5])
            for c in range(60) for t in range(c % 13)]
    rows += [(None, t, "user", "who?") for t in range(4)] + [(900, None, "assistant", None), (900, None, None, ""), (900, 3, "user", "x" * 20000 + ".")]
    # One conversation with most of the rows; in it, many equal rows of one turn and of many turns.
    rows += [(777, t, ("user", "assistant", "user")[t % 3], f"line {t}.") for t in range(700)]
    rows += [(777, 5, "user", "again and again.")] * 150 + [(777, 1000 + t, "assistant", "ok.") for t in range(200)]
    return rows


@pytest.mark.parametrize("parts, size", [(1, 4096), (6, 50)])
def test_repair_equals_brute_force(spark, parts, size):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversation_repair.damage_and_repair(table, size).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute_repair(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]
    assert conversation_repair.damage_and_repair(table.where("false")).count() == 0


def test_segments_chain_over_any_cut():
    """The costs of segments, chained, are those of the whole; and so are the edits."""
    table = conversation_repair.tables()
    symbols = bytes((i * i * 7 + i // 3) % 9 for i in range(203))
    whole, state = table.trace(symbols, conversation_repair.END, 0)
    for size in (1, 3, 50, 202):
        cuts = [symbols[i:i + size] for i in range(0, len(symbols), size)]
        parts = [(i, [c for u in conversation_repair.UNITS for c in table.cost(x, u)], "u", "a", None, None) for i, x in enumerate(cuts)]
        chained = list(conversation_repair._costs_after(parts))
        assert chained[0][2] == table.cost(symbols, conversation_repair.END)[0]
        edits, at = "", 0
        for x, (_, after, *_) in zip(cuts, chained):
            more, at = table.trace(x, tuple(after), at)
            edits += more
        assert (edits, at) == (whole, state)


def test_repeated_texts_beyond_the_broadcast(spark, monkeypatch):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(conversation_repair, "BROADCAST_BYTES", -1)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.damage_and_repair(table).collect()}
    assert got == brute_repair(rows)
    assert not table.where(F.lit(False)).count()
