"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tessella.llm.url_filters import SUFFIXES

OP3 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v
), e AS (
  SELECT *, CASE WHEN contains(text, '\') OR regexp_matches(text, '</?s>|\[/?INST\]|<<SYS>>|<</SYS>>|\[OUT\]|\[/?ROLE\]|\[TURN\]')
    THEN regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|<SYS>>|</SYS>>|OUT\]|/?ROLE\]|TURN\])', '\1\\\2', 'g') ELSE text END AS x FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, x) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, x) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(x) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 9 ELSE 19 + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) q
), f AS (SELECT k, min(doc_id) AS m FROM p GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (k) WHERE m < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
y AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) FILTER (WHERE g.j IS NULL) AS s, count(g.j) AS gone
  FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN y ON d.doc_id = y.doc_id
"""

OP6 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), b AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INTEGER) AS bad FROM labels GROUP BY doc_id),
o AS (
  SELECT host, string_split(host, '.') AS l, bad FROM u
  LEFT JOIN b ON b.doc_id = TRY_CAST(regexp_extract(path, '^/[^/]*/([0-9]{1,18})', 1) AS BIGINT)
), h AS (
  SELECT host, CASE WHEN t IN ({suffixes}) THEN array_to_string(l[greatest(len(l) - 2, 1):], '.') ELSE t END AS domain,
    CASE WHEN t IN ({suffixes}) THEN t ELSE l[len(l)] END AS suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS t FROM o) GROUP BY ALL
), d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY ALL),
w AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS base FROM s0),
s1 AS (SELECT s0.*, base AS prior FROM s0, w), a1 AS (SELECT {strength} AS s FROM s1),
s2 AS (SELECT suffix, (k + s * prior) / (n + s) AS suffix_mean FROM s1, a1),
d1 AS (SELECT d0.*, suffix_mean AS prior FROM d0 JOIN s2 USING (suffix)), a2 AS (SELECT {strength} AS s FROM d1),
d2 AS (SELECT domain, (k + s * prior) / (n + s) AS domain_mean FROM d1, a2),
h1 AS (SELECT h.*, domain_mean AS prior FROM h JOIN d2 USING (domain)), a3 AS (SELECT {strength} AS s FROM h1),
h2 AS (SELECT host, k + s * prior AS a, n - k + s * (1 - prior) AS b FROM h1, a3),
h3 AS (SELECT host, a / (a + b) - 0.6745 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM h2),
r AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) v(rh, rp, rule, verdict)),
m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN r
  ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, CASE WHEN low > base THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id LEFT JOIN h3 ON u.host = h3.host CROSS JOIN w
""".replace("{suffixes}", ", ".join(f"'{s}'" for s in SUFFIXES)).replace(
    "{strength}",
    """(SELECT CASE WHEN g IS NULL OR g < 2 OR wi IS NULL OR wi = 0 OR free <= 0 OR be - wi / al * (g - 1) <= 0 THEN 200.0
  ELSE least(200.0, greatest(2.0, 1 / ((be - wi / al * (g - 1)) / (wi / al * free)) - 1)) END
  FROM (SELECT count(*) AS g, sum(n) AS al, sum(n * n) AS sq, sum(n * (k / n - prior) * (k / n - prior)) AS be, sum(n * prior * (1 - prior)) AS wi,
    sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free FROM {source} WHERE n > 0) q)""",
)
for _source in ("s1", "d1", "h1"):  # each strength reads the level it belongs to
    OP6 = OP6.replace("{source}", _source, 1).replace(f" AS s FROM {_source})", " AS s)", 1)

# No seeds: every alignment of a document and an item that share a token at all is counted.  A best
# window can be taken to end at a token that agrees.
OP9 = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM d),
dp AS (SELECT doc_id, hash(doc_id, text) AS r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM dw),
bw AS (SELECT item_id, hash(item_id, text) AS q, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bp AS (SELECT item_id, q, len(w) AS size, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS k FROM bw),
a AS (
  SELECT r, q, doc_id, item_id, size, i - k AS shift, k, count(*) OVER p AS total FROM dp JOIN bp ON dp.t = bp.t AND dp.t <> ''
  WINDOW p AS (PARTITION BY r, q, i - k) QUALIFY total >= ceil(least(13, size) * 0.8)
), g AS (
  SELECT r, q, doc_id, item_id, size, shift, total, count(*) OVER (PARTITION BY r, q, shift ORDER BY k RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS best FROM a
)
SELECT doc_id, item_id, max(total)::BIGINT AS matched, max(size)::BIGINT AS item_tokens FROM g WHERE best >= ceil(least(13, size) * 0.8) GROUP BY doc_id, item_id
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) q
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, t) AS (SELECT x, x FROM e UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.t)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.t), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(t) AS t FROM r GROUP BY v) m ON m.v = d.doc_id
"""

ORACLES = {
    "op3_chat_format": OP3, "op4_substring_dedup": OP4, "op6_url_filter": OP6, "op9_decontamination": OP9, "op10_jaccard_join": OP10,
}
