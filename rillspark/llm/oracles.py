"""What some of the queries must return, in DuckDB's SQL."""

from __future__ import annotations

from rillspark.llm.fingerprints import ANCHORS, CHAIN, REACH
from rillspark.llm.url_filters import LOWER, RULES, UPPER

# The 4-bit patterns of hex digits and the alphabet of base 32.
_NIBBLES = "".join(f"{i:04b}" for i in range(16))
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP3_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, body, sha1(body) AS hex FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '') AS bits FROM h),
d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY body) AS response,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1
      + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
      + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
      + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest
  FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to,
  true AS intact
FROM d
"""

# All pairs that share a run of words, for the tables of tests; the operator itself compares no such pairs.
OP4_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS gram
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least_b FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT w.doc_id, least(w.doc_id, coalesce(least_b, w.doc_id)) AS class_id,
  CASE WHEN len(ws) > 0 THEN min(w.doc_id) OVER (PARTITION BY ws) ELSE w.doc_id END AS copy_of,
  coalesce(k, 0) AS n_links
FROM w LEFT JOIN m ON m.a = w.doc_id LEFT JOIN k ON k.a = w.doc_id
"""

OP8_FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, length(text) // 2 AS half,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS other,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
  FROM d),
e AS (SELECT *, left(text, length(text) - half) || left(other, half) AS edited FROM o),
t AS (
  SELECT doc_id, 'own' AS kind, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
w AS (
  SELECT doc_id, kind, text,
    list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM t),
x AS (
  SELECT doc_id, kind, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
y AS (SELECT *, word IN ({", ".join(f"'{a}'" for a in ANCHORS)}) AS anchor FROM x),
z AS (
  SELECT *,
    sum(anchor::INT) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS anchors,
    sum((NOT anchor)::INT) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS contents
  FROM y),
s AS (
  SELECT a.doc_id, a.kind, list_sort(list_distinct(list(substr(md5(
    a.word || ':' || c.word || coalesce(' ' || f.word, '')), 1, 8)))) AS spots
  FROM z a
  JOIN z c ON c.doc_id = a.doc_id AND c.kind = a.kind AND NOT c.anchor
    AND c.contents = a.contents + 1 AND c.anchors < a.anchors + {REACH}
  LEFT JOIN z f ON f.doc_id = a.doc_id AND f.kind = a.kind AND NOT f.anchor
    AND f.contents = a.contents + {CHAIN} AND f.anchors < a.anchors + {REACH}
  WHERE a.anchor GROUP BY ALL),
u AS (
  SELECT w.doc_id, w.kind, CASE
    WHEN spots IS NOT NULL THEN spots
    WHEN len(ws) > 0 THEN list_sort(list_distinct(list_transform(ws, lambda v: substr(md5('w:' || v), 1, 8))))
    ELSE [substr(md5('=' || text), 1, 8)] END AS spots
  FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.kind = w.kind)
SELECT e.doc_id, length(e.text) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(a.spots, ' ') AS fingerprint, array_to_string(b.spots, ' ') AS edited_fingerprint,
  len(list_intersect(a.spots, b.spots))::DOUBLE
    / (len(a.spots) + len(b.spots) - len(list_intersect(a.spots, b.spots))) AS near_edited,
  len(list_intersect(a.spots, c.spots))::DOUBLE
    / (len(a.spots) + len(c.spots) - len(list_intersect(a.spots, c.spots))) AS near_next
FROM e
JOIN u a ON a.doc_id = e.doc_id AND a.kind = 'own'
JOIN u b ON b.doc_id = e.doc_id AND b.kind = 'edited'
JOIN u c ON c.doc_id = e.next_id AND c.kind = 'own'
"""

# CRC-32 bit by bit, with its usual polynomial.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

# Nodes as strings of turn digests; subtrees by comparing beginnings, for the tables of tests.
OP11_PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list({{'key': md5(length(role) || ':' || role || text), 'chars': length(text)}}
    ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
s AS (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM o),
h AS (SELECT conv_id, own, {_CRC32} % 6 AS h FROM s),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own, [])[1 : h.h], h.own[h.h + 1 :]) AS turns
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
n AS (
  SELECT array_to_string(list_transform(turns[1 : depth], lambda x: x.key), '') AS name, depth,
    min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(turns[depth].chars), 0) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL),
c AS (
  SELECT a.name, count(b.name) AS n_children FROM n a
  LEFT JOIN n b ON b.depth = a.depth + 1 AND starts_with(b.name, a.name) GROUP BY a.name),
m AS (SELECT n.*, n_children FROM n JOIN c USING (name)),
u AS (
  SELECT a.name, count(*) FILTER (b.n_children = 0) AS n_leaves,
    CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens
  FROM m a JOIN m b ON starts_with(b.name, a.name) GROUP BY a.name)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN u USING (name)
LEFT JOIN m q ON m.depth > 0 AND q.name = left(m.name, 32 * (m.depth - 1)) AND q.depth = m.depth - 1
"""

OP12_FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
    CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (
  SELECT *, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle,
    array_to_string(units[b + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM x
"""

OP13_URL_FILTERS = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(map(str, RULES))}),
b AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS behind FROM pages),
h AS (SELECT page_id, behind, regexp_extract(behind, '^[^/?#]*') AS raw FROM b),
u AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(behind, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, u.host, u.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM u LEFT JOIN LATERAL (
  SELECT rules.host || rules.path AS rule, verdict FROM rules
  WHERE (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
  ORDER BY length(rules.host || rules.path) DESC LIMIT 1) r ON true
"""
