"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Longest runs: equal 13-word runs of a document and an item on one diagonal make an island; its length is what matches.
ORACLES["op7_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\v\f]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(text, '[ \t\n\r\v\f]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
bg AS (SELECT item_id, least(13, len(w)) AS need, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS q, w FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, need, q, list_slice(w, q, q + need - 1) AS g FROM bg),
first AS (SELECT DISTINCT need, g[1] AS head FROM bs),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
ds AS (SELECT dp.doc_id, dp.p, f.need, list_slice(dp.w, dp.p, dp.p + f.need - 1) AS g FROM dp JOIN first f ON dp.w[dp.p] = f.head WHERE dp.p + f.need - 1 <= len(dp.w)),
hit AS (SELECT ds.doc_id, bs.item_id, ds.need, ds.p, bs.q FROM ds JOIN bs ON ds.need = bs.need AND ds.g = bs.g),
isl AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM hit),
span AS (SELECT doc_id, item_id, min(p) AS p, min(q) AS q, count(*) + min(need) - 1 AS n FROM isl GROUP BY doc_id, item_id, p - q, run),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, p, q) AS k FROM span)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS match_words, CAST(p - 1 AS BIGINT) AS doc_word, CAST(q - 1 AS BIGINT) AS item_word FROM best WHERE k = 1
"""

ORACLES["op9_sharding"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"

ORACLES["op6_warc_revisits"] = r"""
WITH base AS (
  SELECT page_id AS n, url, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size, '"' || md5(coalesce(html, '')) || '"' AS tag,
    'day ' || CAST(page_id - page_id % 7 AS VARCHAR) AS day, 'max-age=' || CAST(page_id % 100 AS VARCHAR) AS age,
    CASE WHEN page_id % 5 = 0 THEN '"stale"' ELSE '"' || md5(coalesce(html, '')) || '"' END AS other,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', '')), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref)(=|$)'))), '&') AS query
  FROM base),
keyed AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM parts),
revisits AS (
  SELECT n * 4 + 1 AS record_id, canonical, n * 60 + 30 AS at, other, age FROM keyed
  UNION ALL SELECT n * 4 + 2, canonical, n * 60 - 30, other, age FROM keyed WHERE n % 11 = 0),
joined AS (
  SELECT r.*, k.n * 4 AS base_id, k.tag, k.day
  FROM revisits r ASOF LEFT JOIN keyed k ON r.canonical = k.canonical AND r.at >= k.n * 60)
, sized AS (SELECT j.*, k.size FROM joined j LEFT JOIN keyed k ON j.base_id = k.n * 4)
SELECT record_id, canonical, CAST(base_id AS VARCHAR) AS refers_to,
  CASE WHEN base_id IS NULL THEN 'missing' WHEN tag = other THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN base_id IS NOT NULL AND tag = other
    THEN 'cache-control: ' || age || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || other || chr(10) || 'last-modified: ' || day END AS headers
FROM sized
"""
