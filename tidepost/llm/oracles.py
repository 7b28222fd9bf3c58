"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_bloom_lines"] = r"""
WITH lines AS (
  SELECT doc_id, u.i AS pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)),
                                             lambda x, i: {'i': i, 'line': x})) AS u FROM documents)),
gone AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k
         HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, g.k IS NOT NULL AND l.doc_id <> g.keeper AS dropped
           FROM lines l LEFT JOIN gone g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op5_dated_lists"] = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_at,
         nullif(lower(regexp_replace(regexp_replace(
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)', 1), '/'),
                     lambda x: x <> '') AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INTEGER AS v FROM captures WHERE host IS NOT NULL),
entries AS (
  SELECT CASE v % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'host' ELSE 'prefix' END AS kind,
         CASE WHEN v % 3 = 2 THEN host || '/en' ELSE host END AS value,
         CASE WHEN regexp_matches(host, 'casino|bets') THEN 'gambling' WHEN regexp_matches(host, 'pills') THEN 'pharma'
              WHEN regexp_matches(host, 'adult') THEN 'adult' WHEN regexp_matches(host, 'spam|ads') THEN 'spam'
              ELSE 'watch' END AS category,
         DATE '2024-01-01' + CAST(v % 200 AS INTEGER) AS d, v
  FROM hosts),
valid AS (
  SELECT kind, value, category, d AS valid_from, CASE WHEN v % 4 <> 0 THEN d + 60 END AS valid_to FROM entries
  UNION ALL
  SELECT kind, value, category, d + 90, NULL FROM entries WHERE v % 5 = 0 AND v % 4 <> 0),
hits AS (
  SELECT c.page_id, i.category FROM captures c JOIN valid i
    ON c.fetched_at >= i.valid_from AND (i.valid_to IS NULL OR c.fetched_at < i.valid_to)
   AND CASE i.kind WHEN 'host' THEN c.host = i.value
                   WHEN 'domain' THEN c.host = i.value OR ends_with(c.host, '.' || i.value)
                   ELSE c.host || '/' || array_to_string(c.parts[1:1], '/') = i.value END),
folded AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n_entries
           FROM hits GROUP BY page_id)
SELECT c.page_id, c.url, c.host, CAST(c.fetched_at AS VARCHAR) AS fetched_at, f.page_id IS NOT NULL AS blocked, coalesce(f.categories, '') AS categories,
       coalesce(f.n_entries, 0) AS n_entries
FROM captures c LEFT JOIN folded f USING (page_id)
"""

# Vectors of 64 components: parts of four. A nearest entry is the least of distance x 64 + entry.
_ASSIGN = """near{k} AS (
  SELECT s.id, s.p, min(((s.c1 - b.c1) ** 2 + (s.c2 - b.c2) ** 2 + (s.c3 - b.c3) ** 2 + (s.c4 - b.c4) ** 2)::BIGINT * 64 + b.e) AS m
  FROM parts s JOIN book{k} b ON s.p = b.p GROUP BY s.id, s.p)"""
_REFINE = """moved{k} AS (
  SELECT s.p, n.m % 64 AS e, floor(sum(s.c1) / count(*))::BIGINT AS c1, floor(sum(s.c2) / count(*))::BIGINT AS c2,
         floor(sum(s.c3) / count(*))::BIGINT AS c3, floor(sum(s.c4) / count(*))::BIGINT AS c4
  FROM parts s JOIN near{k} n ON s.id = n.id AND s.p = n.p GROUP BY s.p, n.m % 64),
book{next} AS (
  SELECT b.p, b.e, coalesce(m.c1, b.c1) AS c1, coalesce(m.c2, b.c2) AS c2, coalesce(m.c3, b.c3) AS c3, coalesce(m.c4, b.c4) AS c4
  FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e)"""

ORACLES["op13_grid_codes"] = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS id, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (
  SELECT id, r.p::BIGINT AS p, v[r.p * 4 + 1] AS c1, v[r.p * 4 + 2] AS c2, v[r.p * 4 + 3] AS c3, v[r.p * 4 + 4] AS c4
  FROM kept, range(16) r(p)),
book0 AS (SELECT p, id AS e, c1, c2, c3, c4 FROM parts WHERE id < 64),
{_ASSIGN.format(k=0)}, {_REFINE.format(k=0, next=1)},
{_ASSIGN.format(k=1)}, {_REFINE.format(k=1, next=2)},
{_ASSIGN.format(k=2)},
coded AS (
  SELECT id, string_agg(printf('%02x', (m % 64)::INTEGER), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error
  FROM near2 GROUP BY id),
digest AS (
  SELECT sha256(string_agg(c1 || ',' || c2 || ',' || c3 || ',' || c4, ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.codebooks_sha256
FROM kept k JOIN coded c USING (id), digest d
"""
