"""DuckDB SQL of the queries that SQL can express."""

from . import warc


def _sql_map(table: dict) -> str:
    """A map of SQL with the characters as code points."""
    text = lambda s: "concat(" + ", ".join(f"chr({ord(c)})" for c in s) + ")"
    key = lambda k: f"'{k}'" if isinstance(k, str) else str(k)
    return "MAP {" + ", ".join(f"{key(k)}: {text(v)}" for k, v in table.items()) + "}"


def _unescaped(text: str) -> str:
    """Character references of an SQL text undone; ``names`` and ``numbers`` are maps."""
    r = "x[2]"
    number = f"CASE WHEN {r}[3:3] IN ('x', 'X') THEN CAST('0x' || {r}[4:-2] AS BIGINT) ELSE CAST({r}[3:-2] AS BIGINT) END"
    point = f"CASE WHEN ({number}) > 1114111 OR ({number}) BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce(numbers[({number})], chr(CAST(({number}) AS INTEGER))) END"
    char = f"CASE WHEN {r} IS NULL THEN '' WHEN {r}[2:2] = '#' THEN {point} ELSE coalesce(names[{r}[2:]], {r}) END"
    return (f"array_to_string([x[1] || {char} FOR x IN list_zip(regexp_split_to_array({text}, '{warc.REFERENCE}'), "
            f"regexp_extract_all({text}, '{warc.REFERENCE}'))], '')")


OP2 = r"""
WITH refs AS (SELECT @NAMES AS names, @NUMBERS AS numbers),
r AS (SELECT coalesce(CAST(page_id AS VARCHAR), '') AS p, url AS target_uri, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, md5('response' || chr(10) || p || chr(10) || coalesce(target_uri, '') || chr(10) || html) AS h,
      'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10)
      || 'X-Page: ' || p AS source_headers FROM r),
t AS (SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to,
      'HTTP/1.1 200 OK' || chr(13) || chr(10) || source_headers || chr(13) || chr(10) || chr(13) || chr(10) || html AS response,
      regexp_replace(regexp_replace(html,
        '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>', '', 'g'),
        '[\t\r\n ]+', ' ', 'g') AS t1,
      trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1), '[\t\r\n ]+', ' ', 'g')) AS title FROM m),
u AS (SELECT *, regexp_replace(regexp_replace(t1,
        '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|footer|header|title|blockquote|pre)\b[^>]*>', chr(10), 'g'),
        '(?s)<[^>]*>', '', 'g') AS t2 FROM t),
v AS (SELECT *, @T2 AS t3, @TITLE AS title2,
      regexp_extract(html, '(?i)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1) AS language FROM u, refs),
w AS (SELECT *, trim(regexp_replace(regexp_replace(t3, ' *\n[ \n]*', chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS text,
      'software: derivative-builder/1.0' || chr(13) || chr(10) || 'http-status: 200' || chr(13) || chr(10)
      || 'http-content-type: text/html; charset=utf-8' || chr(13) || chr(10)
      || CASE WHEN title2 <> '' THEN 'title: ' || title2 || chr(13) || chr(10) ELSE '' END
      || CASE WHEN language <> '' THEN 'language: ' || language || chr(13) || chr(10) ELSE '' END
      || 'outlinks: ' || len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) || chr(13) || chr(10) AS metadata FROM v),
x AS (SELECT refers_to, target_uri, source_headers, html, response, 'metadata' AS type, 'application/warc-fields' AS content_type, metadata AS block FROM w
      UNION ALL SELECT refers_to, target_uri, source_headers, html, response, 'conversion', 'text/plain; charset=utf-8', text FROM w),
y AS (SELECT *, md5(type || chr(10) || refers_to) AS h FROM x)
SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id, type,
       refers_to, target_uri, '1970-01-01T00:00:00Z' AS date, source_headers, content_type, CAST(strlen(block) AS BIGINT) AS content_length,
       'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(html) AS payload_digest,
       'sha256:' || sha256(response) AS source_digest, block
FROM y
""".replace("@T2", _unescaped("t2")).replace("@TITLE", _unescaped("title")).replace("@NAMES", _sql_map(warc.NAMES)).replace("@NUMBERS", _sql_map(warc.NUMBERS))

OP3 = r"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
e0 AS (SELECT url, unnest([
      coalesce(nullif(regexp_extract(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1), ''),
               nullif(regexp_extract(html, '(?is)<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*?\brel\s*=\s*["'']?canonical\b', 1), '')),
      nullif(regexp_extract(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*?\burl\s*=\s*["'']?([^"''\s>;]+)', 1), '')]) AS t
      FROM p WHERE url IS NOT NULL AND (lower(html) LIKE '%canonical%' OR lower(html) LIKE '%refresh%')),
e1 AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
      WHEN t LIKE '//%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || t
      WHEN t LIKE '/%' THEN regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) || t END AS target FROM e0),
link AS (SELECT url, target FROM e1 WHERE url LIKE '%://%' AND target LIKE '%://%'),
known AS (SELECT DISTINCT url FROM (SELECT url FROM p UNION ALL SELECT url FROM link UNION ALL SELECT target FROM link)),
parts AS (SELECT url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS rest FROM known),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT url, max_by(verdict, length(rhost || rpath)) AS own, max_by(rhost || rpath, length(rhost || rpath)) AS rule
        FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url),
nodes AS (SELECT parts.*, own, rule, CASE WHEN parts.url LIKE '%://%' THEN regexp_replace(host, ':(80|443)?$', '') || CASE WHEN starts_with(rest, '/') THEN '' ELSE '/' END
        || array_to_string([CASE WHEN i = 1 THEN x WHEN regexp_matches(upper(x[1:2]), '^(2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])')
             THEN chr(CAST('0x' || x[1:2] AS INTEGER)) || x[3:] WHEN regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN '%' || upper(x[1:2]) || x[3:] ELSE '%' || x END
           FOR x, i IN string_split(rest, '%')], '') END AS node
        FROM parts LEFT JOIN fit ON fit.url = parts.url),
pair AS (SELECT a.node AS u, b.node AS v FROM link JOIN nodes a ON a.url = link.url JOIN nodes b ON b.url = link.target WHERE a.node <> b.node),
edges AS (SELECT u, v FROM pair UNION SELECT v, u FROM pair),
reach(node, other) AS (SELECT DISTINCT u, u FROM edges UNION SELECT reach.node, edges.v FROM reach JOIN edges ON edges.u = reach.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
passed AS (SELECT component, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS passed
        FROM comp JOIN nodes USING (node) WHERE url IN (SELECT url FROM link UNION SELECT target FROM link) GROUP BY component)
SELECT page_id, host, path, rule, coalesce(own, passed, 'allow') AS verdict, component
FROM p JOIN nodes ON nodes.url IS NOT DISTINCT FROM p.url LEFT JOIN comp USING (node) LEFT JOIN passed USING (component)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
bw AS (SELECT item_id, least(len(words), 10) AS size,
       unnest(list_transform(range(0, greatest(len(words) - 9, 1)), lambda i: list_slice(words, i + 1, i + 10))) AS terms
       FROM b WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, unnest(range(0, len(words) - size + 1)) AS st, words FROM d, sizes WHERE len(words) >= size),
m AS (SELECT DISTINCT r, st, dw.size, item_id FROM dw JOIN bw
      ON bw.size = dw.size AND bw.terms = list_slice(dw.words, st + 1, st + dw.size)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(st, st + size)) AS p FROM m) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
, terms AS (SELECT DISTINCT terms, size, spot, terms[spot + 1] AS term FROM (SELECT *, unnest(range(0, size)) AS spot FROM bw)),
post AS (SELECT r, unnest(words) AS term, unnest(range(0, len(words))) AS pos FROM d),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
ranked AS (SELECT t.*, row_number() OVER (PARTITION BY terms ORDER BY n, spot) AS rk, count(n) OVER (PARTITION BY terms) AS seen FROM terms t LEFT JOIN df USING (term)),
seeds AS (SELECT DISTINCT p.r, k.terms, k.size, p.pos - k.spot AS st FROM ranked k JOIN post p USING (term) WHERE rk = 1 AND seen = size),
near AS (SELECT s.r, s.terms, s.st FROM seeds s JOIN ranked k ON k.terms = s.terms JOIN post p ON p.r = s.r AND p.term = k.term
        AND (k.rk = 1 AND p.pos = s.st + k.spot OR k.rk > 1 AND abs(p.pos - s.st - k.spot) <= 2) GROUP BY s.r, s.terms, s.st, s.size HAVING count(DISTINCT k.spot) = s.size),
close AS (SELECT r, count(DISTINCT terms) AS n_near FROM near GROUP BY r)
SELECT CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r) LEFT JOIN close USING (r)
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
       1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 1) // (coalesce(t.total, 0) + v.v) AS p
       FROM groups g JOIN kept k USING (lang) JOIN kinds v USING (lang) LEFT JOIN totals t USING (lang, source)
       LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, 1 + 1000000000 * (sum(n)::HUGEINT + 1) // (any_value(total) + any_value(v)) AS q
       FROM counts JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY ALL) USING (lang) JOIN kinds USING (lang)
       GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
       FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT s.lang, s.source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
       FROM shares s JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
       FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP11 = r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
       FROM embeddings WHERE embedding IS NOT NULL
       AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id,
       CAST(coalesce(list_sum([x[1] * x[2] FOR x IN list_zip(q.e, c.e, true)]), 0) AS BIGINT) AS score
       FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id ASC NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
       FROM w, (VALUES (1), (2), (3), (4)) AS s(k)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
around AS (SELECT lang, phrase, max(a) AS a FROM (
       SELECT lang, a, unnest(flatten([[array_to_string(ws[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase
       FROM c WHERE k > 2) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN around o USING (lang, phrase) WHERE o.a IS NULL OR 100 * o.a < 80 * c.a),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS j FROM kept),
scored AS (SELECT x.lang, x.phrase, x.a, j, l.c AS l, r.c AS r, CAST(2000000 * x.a::HUGEINT // (l.c + r.c) AS BIGINT) AS score
       FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:j], ' ')
       JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
