"""DuckDB SQL for the queries whose results SQL can state."""

from __future__ import annotations

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP2 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
       FROM b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS g(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM bw), unnest(generate_series(1, len(w) - n + 1)) AS g(i)),
hits AS (SELECT rid, n, i, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) AS r FROM d GROUP BY k),
s1 AS (SELECT k, source_size, [5.0, 2.0, 1.0][(r - 1) % 3 + 1]::DOUBLE AS w, source_size::DOUBLE * 3 AS most, sum(source_size) OVER ()::DOUBLE AS total FROM s),
s2 AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
                 > most * sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM s1),
s3 AS (SELECT k, source_size, CASE WHEN is_full THEN most ELSE (total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)) * w
                                   / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS times FROM s3),
s5 AS (SELECT *, greatest(target - times * source_size::DOUBLE, 0) AS rest FROM s4),
g AS (SELECT k, h, sum(size) AS s FROM d GROUP BY k, h),
g1 AS (SELECT k, h, s, sum(s) OVER (PARTITION BY k ORDER BY h) AS upto FROM g),
e AS (SELECT g1.k, arg_min(g1.h, g1.h) AS edge, arg_min(upto - rest < rest - (upto - s), g1.h) AS with_edge FROM g1 JOIN s5 USING (k) WHERE upto > rest GROUP BY g1.k)
SELECT doc_id, size, source_size, target, size * (times + coalesce((h < edge OR (h = edge AND with_edge)), FALSE)::BIGINT) AS taken
FROM d JOIN s5 USING (k) LEFT JOIN e USING (k)
"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"


_KEY = r"""{host} || regexp_replace({path}, '/$', '') || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"""


def _key(host: str, path: str, query: str) -> str:
    return _KEY.format(host=host, path=path, q=rf"regexp_replace(regexp_replace({query}, '(^|&)utm_[^&]*', '', 'g'), '^&', '')")


_OP6 = rf"""
WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_A_Z}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM p),
r AS (SELECT *, CASE WHEN {_fits('www.example.com', '/en/')} THEN 'www.example.com/en/' WHEN {_fits('example.com', '/en/')} THEN 'example.com/en/'
                     WHEN {_fits('net', '/es/')} THEN 'net/es/' WHEN {_fits('net', '/fr/')} THEN 'net/fr/' WHEN {_fits('com', '/')} THEN 'com/' END AS rule,
             CASE WHEN host <> '' THEN {_key('host', 'path', 'query')} END AS k FROM q),
v AS (SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS rv,
             regexp_extract(regexp_extract(html, '(?i)<link\s[^<>]*rel\s*=\s*[\x22\x27]?canonical[^<>]*>', 0), '(?i)href\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)', 1) AS canon,
             regexp_extract(regexp_extract(html, '(?i)<meta\s[^<>]*http-equiv\s*=\s*[\x22\x27]?refresh[^<>]*>', 0), '(?i)url\s*=\s*[\x22\x27]?([^\x22\x27\s>;]+)', 1) AS jump FROM r),
l AS (SELECT k, host, path, replace(canon, '&amp;', '&') AS href FROM v WHERE canon <> '' AND k IS NOT NULL UNION SELECT k, host, path, replace(jump, '&amp;', '&') FROM v WHERE jump <> '' AND k IS NOT NULL),
f AS (SELECT k, CASE WHEN instr(href, '://') > 0 THEN substr(href, instr(href, '://') + 3) WHEN starts_with(href, '//') THEN substr(href, 3)
                     WHEN starts_with(href, '/') THEN host || href ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS rest FROM l),
t AS (SELECT k, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_A_Z}) AS h2, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p2, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q2 FROM f),
e AS (SELECT k AS a, {_key('h2', 'p2', 'q2')} AS b FROM t),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(k, other) AS (SELECT k, k FROM v WHERE k IS NOT NULL AND rv = 'block' UNION SELECT reach.k, u.b FROM reach JOIN u ON u.a = reach.other),
bad AS (SELECT DISTINCT other AS k FROM reach)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bad.k IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM v LEFT JOIN bad ON bad.k = v.k
"""

_OP7 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(generate_series(0, length(h) // 2 - 50)) AS g(i)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
gone AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, TRUE) AS fresh FROM w JOIN m USING (s) WHERE low < doc_id),
isles AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM gone) GROUP BY rid, k),
cuts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM isles),
kept AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
         FROM cuts JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

_OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NULL AS no_role, text IS NULL AS no_text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok', FALSE, FALSE FROM range(2) AS t(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, no_role DESC, role, no_text DESC, text) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT rid, doc_id, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nw FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, c GROUP BY term, nd),
s AS (SELECT q.item_id, n.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * nd) // nw))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN n USING (rid), c GROUP BY q.item_id, rid, n.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

_OP13 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
low AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(low < w.doc_id, FALSE)} AS fails
      FROM w JOIN low USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
s AS (SELECT part, n, good, toxic, concat(CASE WHEN fails.A THEN 'A' END, CASE WHEN fails.B THEN 'B' END, CASE WHEN fails.C THEN 'C' END, CASE WHEN fails.D THEN 'D' END, CASE WHEN fails.E THEN 'E' END) AS bad FROM g),
perm(o) AS (SELECT '' UNION ALL SELECT o || x FROM perm, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE instr(o, x) = 0),
steps AS (SELECT o AS filter_order, i::INTEGER AS step, o[i] AS c, o[:i - 1] AS earlier FROM perm, range(1, 6) AS r(i) WHERE length(o) = 5),
x AS (SELECT part, filter_order, step, c, n, good, toxic, bad, instr(bad, c) > 0 AS hit,
             translate(bad, earlier, '') <> bad AS gone FROM s, steps),
y AS (SELECT part, filter_order, step, c, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN bad = c THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM x GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM y
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op5_mix_sources": _OP5, "op6_url_filters": _OP6, "op7_repeated_strings": _OP7, "op10_chat_format": _OP10, "op11_search": _OP11, "op13_filter_audit": _OP13}
