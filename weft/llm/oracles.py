"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import line_rules, url_filters

_LETTERS = f"'{url_filters.UPPER}', '{url_filters.LOWER}'"
_SPACE = r"\x20\x09-\x0D"
_END = r"""[.?\x{2026}](\s|["''\x{201d}\x{00bb})\]]|$)|[^!]!(\s|["''\x{201d}\x{00bb})\]]|$)"""
_BAR = r"[|>\x{00bb}\x{2022}]"
_NO_BAR = r"[^|>\x{00bb}\x{2022}]"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_PASSES = (
    f"(regexp_matches(l, '{_END}') AND {_count('l', line_rules.SYMBOLS)} * 20 <= length(l) AND NOT regexp_matches(l, '{_BAR}\\s{_NO_BAR}*{_BAR}\\s')"
    f" AND {_count('l', '!!')} * 40 <= length(l) AND NOT regexp_matches(lower(l), '{line_rules.BOILERPLATE}'))"
)

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[{_SPACE}]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i + 1:i + 5], ' ') AS k FROM (SELECT r, words, unnest(range(0, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
share AS (SELECT r, sum(length(l)) AS whole, sum(CASE WHEN {_PASSES} THEN length(l) ELSE 0 END) AS good FROM (SELECT r, unnest(lines) AS l FROM w) GROUP BY r),
f AS (SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST({_count('t', line_rules.SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CASE WHEN whole > 0 THEN good / CAST(whole AS DOUBLE) ELSE 0.0 END AS s FROM w LEFT JOIN cov ON cov.r = w.r LEFT JOIN share ON share.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND s >= 0.5 AS kept, round(s, 6) AS line_share FROM f"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.RULES)
OP7 = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_LETTERS}), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rh, rp, v) AS (VALUES {_RULES}),
fit AS (SELECT r, arg_max(rh || rp, 1000 * (length(rh) + length(rp)) + length(rh)) AS rule, arg_max(v, 1000 * (length(rh) + length(rp)) + length(rh)) AS v
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.r = p.r"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[{_SPACE}]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
step AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(least(n.doc_id, b), n.doc_id) AS component_id, n.doc_id = coalesce(least(n.doc_id, b), n.doc_id) AS kept FROM n LEFT JOIN least_ ON a = n.doc_id"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
# kind, its pattern, and the least length of its second group
_KINDS = (
    ("assign", _ASSIGN, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0),
    ("hex", "[0-9a-f]{24,}", 0),
    ("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0),
    ("github", "gh[opsur]_[A-Za-z0-9]{36,}", 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("google", "AIza[A-Za-z0-9_-]{35,}", 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0),
)


def _spans(number: int, kind: str, pattern: str, least: int) -> str:
    """Rows (r, number, kind, start, stop): what stands before a match has the parts and the matches before it."""
    value = f"regexp_extract_all(t, '{pattern}', 2)" if least else "m"
    return f"""SELECT r, {number} AS number, '{kind}' AS kind, start, start + length(m[i]) AS stop FROM (SELECT r, i, m, v,
  CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT r, parts, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_split_to_array(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS m, {value} AS v FROM d))) WHERE length(v[i]) >= {least}"""


_ALL = " UNION ALL ".join(_spans(k, *x) for k, x in enumerate(_KINDS))
OP10 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({_ALL}),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.r = d.r"""

_H32 = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP4 = f"""
WITH RECURSIVE tbl AS (SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(range(0, 8), lambda c, _: {_BIT}, i) AS v FROM range(0, 256) t(i))),
hexed AS (SELECT row_number() OVER () AS r, doc_id, string_split(lower(hex(encode(coalesce(text, '')))), '') AS h, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
bytes AS (SELECT r, doc_id, size, list_transform(range(0, size), lambda i: (instr('0123456789abcdef', h[2 * i + 1]) - 1) * 16 + instr('0123456789abcdef', h[2 * i + 2]) - 1) AS b FROM hexed),
d AS MATERIALIZED (SELECT r, doc_id, CAST(size + 8 AS BIGINT) AS size, CASE WHEN size = 0 THEN 0 ELSE xor(list_reduce(b, lambda c, x: xor(c >> 8, tbl[1 + (xor(c, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) END AS text_crc32,
  {_H32.format("'key:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS hash FROM bytes, tbl),
nodes AS MATERIALIZED (SELECT cell, CAST(min(s) AS INTEGER) AS shard FROM (SELECT {_H32.format("'node:' || s || ':' || k")} % 65536 AS cell, s FROM range(0, 24) t(s), range(0, 64) u(k)) GROUP BY cell),
cells AS (SELECT hash >> 16 AS cell, count(*) AS n FROM d GROUP BY 1),
total AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM cells),
homes AS (SELECT c.cell, c.n, coalesce(v.shard, (SELECT arg_min(shard, cell) FROM nodes)) AS home, coalesce(v.cell, (SELECT min(cell) FROM nodes)) AS node FROM cells c ASOF LEFT JOIN nodes v ON v.cell >= c.cell),
b AS (SELECT *, total // 24 + CASE WHEN home < total % 24 THEN 1 ELSE 0 END AS bound, coalesce(sum(n) OVER (PARTITION BY home ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM homes, total),
k AS (SELECT *, greatest(0, least(n, bound - before)) AS kept FROM b),
m AS MATERIALIZED (SELECT *, coalesce(sum(n - kept) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM k),
sent AS (SELECT node, sum(n - kept) AS sent FROM m GROUP BY node),
lap AS (SELECT shard, cell, coalesce(sent, 0) AS sent FROM nodes LEFT JOIN sent ON node = cell),
arcs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY turn, cell) AS i, shard, CAST(sent AS BIGINT) AS sent FROM (SELECT 0 AS turn, cell, shard, sent FROM lap UNION ALL SELECT 1, cell, shard, 0 FROM lap)),
held AS (SELECT home, sum(kept) AS kept FROM m GROUP BY home),
room AS (SELECT list(CAST(total // 24 + CASE WHEN s < total % 24 THEN 1 ELSE 0 END - coalesce(kept, 0) AS BIGINT) ORDER BY s) AS rooms, list(CAST(coalesce(kept, 0) AS BIGINT) ORDER BY s) AS nexts FROM range(0, 24) t(s) CROSS JOIN total LEFT JOIN held ON home = s),
walk(i, waiting, served, rooms, nexts, start, stop, shard, slot) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), rooms, nexts, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS INTEGER), CAST(0 AS BIGINT) FROM room
  UNION ALL SELECT i, waiting - took, served + took, list_transform(rooms, lambda x, j: CASE WHEN j = shard + 1 THEN x - took ELSE x END), list_transform(nexts, lambda x, j: CASE WHEN j = shard + 1 THEN x + took ELSE x END), served, served + took, shard, nexts[shard + 1]
  FROM (SELECT a.i, w.waiting + a.sent AS waiting, w.served, w.rooms, w.nexts, a.shard, least(w.waiting + a.sent, w.rooms[a.shard + 1]) AS took FROM walk w JOIN arcs a ON a.i = w.i + 1)),
takes AS MATERIALIZED (SELECT start, stop, shard, slot FROM walk WHERE stop > start),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hash >> 16 ORDER BY hash, doc_id, size, text_crc32) - 1 AS rank FROM d),
placed AS (SELECT r.*, m.home, m.kept, m.before, m.moved + rank - m.kept AS g FROM ranked r JOIN m ON m.cell = r.hash >> 16)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(home AS INTEGER) AS shard, CAST(before + rank AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed WHERE rank < kept
UNION ALL SELECT doc_id, size, CAST(text_crc32 AS BIGINT), 'rows', t.shard, CAST(t.slot + g - t.start AS BIGINT), NULL FROM placed JOIN takes t ON rank >= kept AND g >= t.start AND g < t.stop"""
