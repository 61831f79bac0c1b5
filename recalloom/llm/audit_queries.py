"""The queries on quality rules, filter interaction and conversation repair, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, filter_audit, quality_rules
from .queries import query, table

_WORD = r"[^\x20\x09-\x0D]"


@query("op11_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
p AS (SELECT rid, generate_subscripts(words, 1) AS i, unnest(words) AS a FROM w),
v AS (SELECT rid, i, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM v WHERE c IS NOT NULL) WHERE n > 1),
k AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM r) GROUP BY rid),
m AS (SELECT doc_id, t, len(words)::BIGINT AS n_words, len(lines) AS n_lines, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN k USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
           OR 10 * n_dup_lines > 3 * n_lines OR regexp_matches(t, '{_WORD}{{201}}')
           OR 10 * len(regexp_extract_all(t, '\p{{Lu}}')) > 3 * word_chars OR 10 * len(regexp_extract_all(t, '[0-9]')) > 3 * word_chars
           OR 10 * len(regexp_extract_all(t, '\p{{L}}{_WORD}*')) < 7 * n_words
           OR 10 * len(regexp_extract_all(t, '(?:^|\n)[\x20\x09]*[-*•]')) > 9 * n_lines) AS kept
FROM f""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.filter_quality(docs).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


@query("op12_filter_audit", rf"""
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
             {{'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
              'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
              'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), d.doc_id IS NULL AND min(d.doc_id) OVER (PARTITION BY t) IS NOT NULL)}} AS x
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL),
g(y) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.y || b.y || c.y || d.y || e.y AS filter_order FROM g a, g b, g c, g d, g e
      WHERE len(list_distinct([a.y, b.y, c.y, d.y, e.y])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
e AS (SELECT part, filter_order, step, n, good, bad, x,
             list_transform(string_split(filter_order, ''), lambda y: CASE y WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C
                                                                   WHEN 'D' THEN x.D ELSE x.E END) AS fails FROM c, s),
h AS (SELECT part, filter_order, step, sum(n) FILTER (NOT list_contains(fails[:step], true)) AS kept,
             sum(n) FILTER (fails[step] AND NOT list_contains(fails[:step - 1], true)) AS removed,
             sum(n) FILTER (fails[step] AND list_contains(fails[:step - 1], true)) AS redundant,
             sum(n) FILTER (fails[step] AND len(list_filter(fails, lambda z: z)) = 1) AS unique_fails,
             sum(good) FILTER (fails[step] AND NOT list_contains(fails[:step - 1], true)) AS good_lost,
             sum(bad) FILTER (fails[step] AND NOT list_contains(fails[:step - 1], true)) AS toxic_lost
      FROM e GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)), 0)::BIGINT AS shapley
FROM h""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """The way into a state by one edit more: cost, edits, lines."""
    lines = f"{state}.l" if line is None else f"list_append({state}.l, {line})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_ROW, _PAID = "role || ':' || text", "5 * truncated"
_USER, _ASSISTANT = "'user:'", "'assistant:'"
# Inserts before the next row: u from anywhere but u, a from u.
_CLOSED = (f"SELECT *, {_least('u2', *[_edit(q, '5', 'I', _USER) for q in ('s0', 's1', 'a3')])} AS u, "
           f"{_least('a3', _edit(_least('u2', *[_edit(q, '5', 'I', _USER) for q in ('s0', 's1')]), '5', 'I', _ASSISTANT))} AS a")


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {_edit(state, _PAID, 'K', _ROW)} END"


def _changed(state: str, role: str) -> str:
    return f"CASE WHEN NOT gone THEN {_edit(state, f'1 + {_PAID}', 'R', f'{role} || text')} END"


_STATE = "STRUCT(c BIGINT, a VARCHAR, l VARCHAR[])"


@query("op13_conversation_repair", rf"""
WITH RECURSIVE b AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
                            lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                                                     lambda x: ord(x)::BIGINT)),
                             lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 20 AS damage FROM conversations, b),
e AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
             CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE damage WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE damage <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM e),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
             left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM n),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS truncated FROM f),
z AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
p AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS s0, NULL::{_STATE} AS s1, NULL::{_STATE} AS u2, NULL::{_STATE} AS a3
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, i + 1, {_edit('s0', '2', 'D')},
             {_least(_edit('s1', '2', 'D'), _kept('s0', 's'))},
             {_least(_edit('u', '2', 'D'), *[w for q in ('s0', 's1', 'a') for w in (_kept(q, 'u'), _changed(q, _USER))])},
             {_least(_edit('a', '2', 'D'), _kept('u', 'a'), _changed('u', _ASSISTANT))}
      FROM (SELECT q.*, g.role, g.text, g.gone, g.truncated FROM ({_CLOSED} FROM p) q
            JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i + 1)),
t AS (SELECT p.conv_id, gaps, blank, duplicate, truncated, illegal, list_min([s0, a]) AS best
      FROM ({_CLOSED} FROM p) p LEFT JOIN z ON p.conv_id IS NOT DISTINCT FROM z.conv_id WHERE p.i = coalesce(rows, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(array_to_string(best.l, chr(10))) AS repaired_sha256
FROM t""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))
