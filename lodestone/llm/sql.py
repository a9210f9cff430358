"""DuckDB SQL for the queries of this subpackage that SQL can express."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT source, key, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 AS w
  FROM d GROUP BY source, key
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / w AS fill FROM s
), l AS (
  SELECT *, row_number() OVER o AS nth,
    (1.0::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM f
  WINDOW o AS (ORDER BY fill, source IS NULL, source), b AS (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT key, source_size, least(most, w * (SELECT arg_min(level, nth) FROM l WHERE fill >= level)) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END::DOUBLE AS rate,
    ('0x' || substr(md5('0/' || key), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM t
), n AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, h, doc_id) AS nth FROM d
)
SELECT doc_id, size, source_size, target, ((floor(nth * rate + u) - floor((nth - 1) * rate + u)) * size)::BIGINT AS taken
FROM n JOIN r USING (key)
"""

URL_FILTER = r"""
WITH RECURSIVE links AS (
  SELECT DISTINCT url, replace(t, '&amp;', '&') AS t FROM (
    SELECT url, unnest([
      regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1)]) AS t
    FROM pages)
  WHERE url IS NOT NULL AND t LIKE '%://%'
), urls AS (
  SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT t FROM links) WHERE url IS NOT NULL
), parts AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS q
  FROM urls
), rules(verdict, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS own
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url
), known AS (
  SELECT p.url, host, path, rule, own,
    CASE WHEN contains(p.url, '://') THEN host || rtrim(path, '/') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS node
  FROM parts p LEFT JOIN best b ON p.url = b.url
), edges AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM links l JOIN known a ON a.url = l.url JOIN known b ON b.url = l.t WHERE a.node <> b.node
), ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
  SELECT a, a FROM ways UNION SELECT r.a, ways.b FROM reach r JOIN ways ON ways.a = r.b
), comp AS (
  SELECT a AS node, min(b) AS component FROM reach GROUP BY a
), placed AS (
  SELECT k.*, coalesce(c.component, k.node) AS component FROM known k LEFT JOIN comp c ON c.node = k.node
), decided AS (
  SELECT component, CASE WHEN bool_or(own = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM placed WHERE own IS NOT NULL AND component IS NOT NULL GROUP BY component
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own, d.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN placed k ON k.url = p.url LEFT JOIN decided d ON d.component = k.component
"""

TIERED_SEARCH = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), d AS (
  SELECT k, doc_id, len(w)::BIGINT AS n FROM t WHERE len(w) > 0
), g AS (
  SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM d
), p AS (
  SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS term FROM t) GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)
), f AS (
  SELECT term, floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, g.n
), s AS (
  SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * d.n * g.n) // g.l))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (k), g GROUP BY item_id, k
), r AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (k) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), k AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
