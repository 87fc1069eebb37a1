"""SQL for DuckDB with the results of the queries that SQL can express. Plain definitions: pairs of documents are compared by shingle."""

from __future__ import annotations

from .quality_rules import GRID, RULES

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON r.b = e.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

_GRID = "[" + ", ".join(f"{c!r}::DOUBLE" for c in GRID) + "]"

OP4 = rf"""WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, regexp_extract_all(t, {WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM p)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
m AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
 len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM p LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"({v})::DOUBLE AS r_{k}" for k, v in RULES.items())} FROM m),
y AS (SELECT doc_id, max(quality) AS y FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cell AS (SELECT stratum, y, len(list_filter({_GRID}, lambda c: c < greatest({", ".join(f"r_{k}" for k in RULES)}))) AS above FROM b JOIN y USING (doc_id) WHERE NOT base_failed),
step AS (SELECT stratum, i, sum(y)::BIGINT AS n_good, sum(1 - y)::BIGINT AS n_bad, sum(CASE WHEN above > i THEN y ELSE 0 END)::BIGINT AS k_good, sum(CASE WHEN above > i THEN 1 - y ELSE 0 END)::BIGINT AS k_bad FROM cell, range(0, {len(GRID)}) AS g(i) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN n_good > 0 AND k_good <= n_good * 0.02::DOUBLE THEN list_sum(list_transform(range(0, k_good + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln(0.02::DOUBLE) + (n_good - j) * ln(0.98::DOUBLE)))) ELSE 1 END AS tail FROM step),
path AS (SELECT *, max((tail > 0.05::DOUBLE / (SELECT count(DISTINCT stratum) FROM d))::INTEGER) OVER (PARTITION BY stratum ORDER BY i DESC) AS failed, k_bad / greatest(n_bad, 1) - 5::DOUBLE * k_good / greatest(n_good, 1) AS gain FROM tails),
cuts AS (SELECT stratum, {_GRID}[i + 1] AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, i DESC) AS r FROM path WHERE failed = 0 AND gain > 0) WHERE r = 1),
verdict AS (SELECT *, list_filter([{", ".join(f"CASE WHEN r_{k} > cutoff THEN '{k}' END" for k in RULES)}], lambda x: x IS NOT NULL) AS rejected_by FROM b LEFT JOIN cuts USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(rejected_by) = 0 AS kept, stratum, rejected_by FROM verdict"""

_TERMS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

#: Shares and differences in HUGEINT, so that all arithmetic is exact.
OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_TERMS}) AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
t AS (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (coalesce(n, 0) + 2 * v) AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(c)::HUGEINT + 2)) // (any_value(t.n) + 2 * any_value(v)) AS q FROM c JOIN t USING (lang) JOIN v USING (lang) GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT 0) AS z FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT lang, source, part, item, coalesce(value, 0)::BIGINT AS value FROM pair LEFT JOIN f USING (lang, source, item)
 UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

#: A walk row by row that keeps the cheapest way to each state of the grammar: 0 nothing yet, 1 system, 2 user, 3 assistant.
OP11 = rf"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {_CRC32} % 20 AS h FROM raw),
left_over AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hit, (VALUES (0), (1)) AS copies(n) WHERE h <> 0 AND (n = 0 OR h = 3)),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) - 1 AS i FROM left_over JOIN c ON left_over.conv_id IS NOT DISTINCT FROM c.conv_id),
core AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS two FROM placed),
r AS (SELECT c, i, turn, role, text, two, CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM core),
added(s, t, cost, audit, lines) AS (SELECT s, s, 0, '', '' FROM range(0, 4) AS g(s) UNION ALL VALUES (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:'),
 (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
kept_as(s, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
role_as(s, t, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
edits AS (SELECT c, i, s, s AS t, 3 AS cost, 'D' AS audit, '' AS lines FROM r, range(0, 4) AS g(s)
 UNION ALL SELECT c, i, s, t, (fault = 'truncated')::INTEGER, 'K', chr(10) || role || ':' || text FROM r JOIN kept_as ON left(role, 1) = initial WHERE fault IN ('', 'truncated')
 UNION ALL SELECT c, i, s, t, 2 + (fault = 'truncated')::INTEGER, 'R', chr(10) || role_as.role || ':' || text FROM r, role_as WHERE fault IN ('', 'truncated')),
walk AS (SELECT c, 0::BIGINT AS i, 0::BIGINT AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS w FROM c
 UNION ALL SELECT walk.c, walk.i + 1, edits.t, min({{'cost': (w.cost + added.cost + edits.cost)::BIGINT, 'audit': w.audit || added.audit || edits.audit, 'lines': w.lines || added.lines || edits.lines}})
 FROM walk JOIN added ON added.s = walk.s JOIN edits ON edits.c = walk.c AND edits.i = walk.i AND edits.s = added.t GROUP BY walk.c, walk.i, edits.t),
counted AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'blank')::INTEGER) AS blank, sum((fault = 'duplicate')::INTEGER) AS duplicate, sum((fault = 'truncated')::INTEGER) AS truncated, sum((two NOT IN ('su', 'ua', 'au'))::INTEGER) AS illegal FROM r GROUP BY c),
sizes AS (SELECT c.c, conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal FROM c LEFT JOIN counted ON c.c = counted.c),
ends AS (SELECT walk.c, min({{'cost': (w.cost + added.cost)::BIGINT, 'audit': w.audit || added.audit, 'lines': w.lines || added.lines}}) AS w FROM walk JOIN sizes ON walk.c = sizes.c AND walk.i = sizes.n JOIN added ON added.s = walk.s WHERE added.t IN (0, 3) GROUP BY walk.c)
SELECT conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, w.cost AS cost, w.audit AS audit, sha256(substr(w.lines, 2)) AS repaired_sha256 FROM sizes JOIN ends ON sizes.c = ends.c"""
