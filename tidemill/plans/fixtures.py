"""Input tables derived from the driver's test tables; the same text runs on Spark and on DuckDB."""

from __future__ import annotations

BASES = ("documents", "pages", "events", "orders", "lineitem", "conversations")

#: Name of the derived table: its SELECT over the base tables.
FIXTURES: dict[str, str] = {
    "attempts": """
SELECT event_id AS attempt_id, ts AS attempted_at,
  concat('https://site', CAST(user_id % 20 AS STRING), '.example/item/', CAST(user_id AS STRING)) AS url,
  concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain,
  CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class,
  CASE WHEN event_type = 'view' THEN 'OK'
       WHEN event_type = 'click' THEN CASE WHEN value < 5 THEN 'THIN_CONTENT' ELSE 'OK' END
       WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'NOT_MODIFIED' ELSE 'RATE_LIMITED' END
       WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'SOFT_BLOCK' WHEN 2 THEN 'CSR_REQUIRED' ELSE 'PARSE_FAIL' END
       ELSE CASE event_id % 4 WHEN 0 THEN 'ORIGIN_DOWN' WHEN 1 THEN 'DEAD_URL' WHEN 2 THEN 'ACCESS_DENIED' ELSE 'PROVIDER_ERROR' END END AS verdict,
  CASE WHEN event_type = 'purchase' THEN 'L3' ELSE concat('L', CAST(event_id % 3 AS STRING)) END AS level,
  CASE WHEN event_type = 'purchase' THEN concat('vendor', CAST(event_id % 3 AS STRING)) END AS provider,
  concat('s', CAST(event_id % 2 AS STRING)) AS strategy,
  concat(event_type, ' HTTP ', CAST(500 + event_id % 4 AS STRING)) AS reason,
  value * 10 AS latency_ms,
  CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) AS DECIMAL(18,2)) END AS cost_credits,
  CASE WHEN event_type <> 'purchase' THEN 'EXACT' WHEN event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 5 = 1 THEN 'PROVISIONAL' ELSE 'EXACT' END AS cost_certainty
FROM events
""",
    "responses": """
SELECT page_id, CASE WHEN page_id % 50 IN (11, 12, 13) THEN concat('https://api.example.org/v1/items/', CAST(page_id AS STRING)) ELSE url END AS url,
  CASE WHEN page_id % 50 = 8 THEN NULL WHEN page_id % 50 = 21 THEN 429 WHEN page_id % 50 = 22 THEN 407 WHEN page_id % 20 < 16 THEN 200 WHEN page_id % 20 < 18 THEN 503 WHEN page_id % 20 = 18 THEN 403 ELSE 404 END AS status,
  CASE WHEN page_id % 50 IN (11, 12, 13) THEN 'application/json' WHEN page_id % 10 = 3 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 20 = 18 THEN 'challenge' END AS cf_mitigated,
  CASE WHEN page_id % 50 IN (9, 37) THEN 'provider' ELSE 'target' END AS source,
  CASE WHEN page_id % 50 = 7 THEN 'timed out' END AS transport_error,
  CASE WHEN page_id % 100 = 21 THEN '120' END AS retry_after,
  CASE WHEN page_id % 50 = 11 THEN concat('{"items":[{"id":', CAST(page_id AS STRING), '}],"next":"c1"}')
       WHEN page_id % 50 = 12 THEN concat('{"items":[],"next":null,"at":', CAST(page_id AS STRING), '}')
       WHEN page_id % 50 = 13 THEN concat('{"items":[{"id":', CAST(page_id AS STRING), '}],"next":"c1"} and more')
       WHEN page_id % 20 IN (14, 15) THEN concat('<html><head><script src="/a.js"></script><script>window.__INITIAL_STATE__={};', repeat('var a=1;', 20), '</script></head><body><div id="root"></div></body></html>')
       WHEN page_id % 20 = 13 THEN concat('<html><body><h1>Just a moment</h1>', repeat('<p>wait</p>', 40), '</body></html>')
       WHEN page_id % 20 IN (16, 17) THEN 'Service Unavailable'
       WHEN page_id % 20 = 18 THEN '<html><body>verify you are human</body></html>'
       WHEN page_id % 20 = 19 THEN '<html><body>not found</body></html>'
       WHEN page_id % 3 = 0 THEN replace(html, '</title>', concat('</title><meta property="og:title" content="OG ', CAST(page_id AS STRING), '"><meta name="description" content="about ', CAST(page_id AS STRING), '">'))
       ELSE html END AS body
FROM pages
""",
    "observations": """
SELECT event_id AS obs_id, ts AS observed_at,
  concat('https://site', CAST(user_id % 20 AS STRING), '.example/item/', CAST(user_id AS STRING)) AS url,
  event_type = 'signup' AND event_id % 2 = 0 AS not_modified,
  CASE WHEN event_id % 3 = 0 THEN concat('"e', CAST(user_id AS STRING), '"') END AS etag,
  concat('v', CAST(CAST(floor(value / 40) AS BIGINT) AS STRING), '  body') AS body
FROM events
""",
    "listing_pages": """
SELECT l_suppkey % 25 AS listing_id, l_orderkey % 40 AS page_no,
  concat('c', CAST((l_orderkey % 40) % 37 AS STRING)) AS cursor_token,
  concat('k', CAST(l_partkey % 120 AS STRING)) AS record_key
FROM lineitem
GROUP BY 1, 2, 3, 4
""",
    "records": """
SELECT 'clean' AS side, 0 AS staged_at, concat('doc:', CAST(doc_id AS STRING)) AS natural_key, source AS url_class,
  concat('{"lang":"', lang, '","source": "', source, '","n_chars":', CAST(n_chars AS STRING), '}') AS data, 'json_ld' AS lang_source
FROM documents WHERE doc_id % 10 <> 0
UNION ALL
SELECT 'staging', 1, concat('doc:', CAST(doc_id AS STRING)), source,
  concat('{"lang":', CASE WHEN doc_id % 7 = 0 THEN 'null' ELSE concat('"', lang, '"') END,
         ',"n_chars":', CASE WHEN doc_id % 11 = 0 THEN concat('"', CAST(n_chars AS STRING), '"') ELSE CAST(n_chars AS STRING) END,
         ',"quality":', CAST(doc_id % 3 AS STRING), '}'),
  CASE WHEN doc_id % 5 < 3 THEN 'heuristic' ELSE 'json_ld' END
FROM documents WHERE doc_id % 4 <> 0
UNION ALL
SELECT 'staging', 2, concat('doc:', CAST(doc_id AS STRING)), 'second', concat('{"lang": "', lang, '","n_chars":1.5}'), 'meta'
FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 13 = 0
""",
    "provider_outcomes": """
SELECT event_id AS outcome_id, ts AS recorded_at, concat('session', CAST(event_id % 4 AS STRING)) AS session,
  concat('vendor', CAST(event_id % 3 AS STRING)) AS provider, concat('s', CAST(user_id % 4 AS STRING)) AS strategy,
  concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain,
  CASE user_id % 5 WHEN 0 THEN 'ssr_html' WHEN 1 THEN 'csr_shell' WHEN 2 THEN 'hard_block' WHEN 3 THEN 'dead_url' ELSE 'listing' END AS target_kind,
  event_id % 13 <> 0 AS attempted, event_id % 26 <> 0 AS eligible,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type IN ('view', 'click') THEN 'OK' WHEN event_type = 'signup' THEN 'DEAD_URL' WHEN event_type = 'error' THEN 'BLOCKED' ELSE 'PARSE_FAIL' END AS verdict,
  CASE WHEN event_id % 13 <> 0 AND event_id % 17 = 0 THEN 'TIMEOUT' END AS error_kind,
  CASE WHEN event_type = 'signup' THEN 404 ELSE 200 END AS target_status,
  CASE WHEN user_id % 5 = 3 THEN 404 ELSE 200 END AS expected_status,
  CASE WHEN event_type = 'error' THEN 'datadome' END AS block_signature,
  value AS latency_ms,
  CASE WHEN event_id % 5 <> 0 THEN CAST(1 + event_id % 4 AS DECIMAL(18,6)) END AS reported_credits
FROM events
""",
    "observed_requests": """
SELECT event_id AS req_id, ts AS observed_at, 'GET' AS method,
  CASE WHEN event_id % 19 = 0 THEN 'https://www.google-analytics.com/collect?v=1'
       WHEN event_id % 23 = 0 THEN 'http://10.0.0.5/api/meta'
       ELSE concat('https://api.site', CAST(user_id % 20 AS STRING), '.example/api/e', CAST(user_id % 7 AS STRING), '/', CAST(event_id AS STRING), '?page=', CAST(event_id % 9 AS STRING), '&region=', CASE WHEN user_id % 2 = 0 THEN 'eu' ELSE 'us' END) END AS url,
  CASE WHEN event_id % 29 = 0 THEN 500 ELSE 200 END AS status,
  CASE WHEN event_id % 31 = 0 THEN 'text/html' ELSE 'application/json' END AS content_type,
  CASE WHEN event_id % 37 = 0 THEN 'authorization' ELSE 'accept' END AS request_header_name,
  CASE WHEN user_id % 41 = 0 THEN concat('{"k":"', CAST(event_id AS STRING), '"}') ELSE props END AS body,
  concat('https://site', CAST(user_id % 20 AS STRING), '.example/p/', CAST(event_id % 50 AS STRING)) AS page_url
FROM events
""",
    "reservation_events": """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS reservation_id, 1 AS seq, 'created' AS event, o_orderdate AS event_at,
  concat('vendor', CAST(o_custkey % 3 AS STRING)) AS provider, CAST(10 + o_orderkey % 5 AS DECIMAL(18,2)) AS credits FROM orders
UNION ALL
SELECT concat('r', CAST(o_orderkey AS STRING)), 2, 'submitted', o_orderdate, concat('vendor', CAST(o_custkey % 3 AS STRING)), CAST(NULL AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL
SELECT concat('r', CAST(o_orderkey AS STRING)), 3, 'settled', o_orderdate, concat('vendor', CAST(o_custkey % 3 AS STRING)), CAST(8 + o_orderkey % 8 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 10 NOT IN (0, 1)
""",
    "social_entities": """
SELECT concat('reddit:', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS natural_key, CAST(conv_id AS STRING) AS conversation_id,
  CASE WHEN turn > 0 THEN concat('reddit:', CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) END AS reply_to_id,
  CASE WHEN turn = 0 THEN 'post' WHEN turn = 1 THEN 'comment' ELSE 'reply' END AS kind, role AS author_name, text
FROM conversations
""",
    "snapshot_pairs": """
SELECT page_id, url, html AS baseline_body,
  CASE WHEN page_id % 5 = 0 THEN replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>')
       WHEN page_id % 5 = 1 THEN '<html><body><div id="root"></div><script src="/a.js"></script><script src="/b.js"></script></body></html>'
       WHEN page_id % 5 = 2 THEN replace(html, '<title>', '<title>New ')
       ELSE html END AS current_body
FROM pages
""",
    "run_samples": """
SELECT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CAST(ts AS DATE) AS run_day, count(*) AS urls,
  sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS validated,
  count(*) AS critical_fields_expected, sum(CASE WHEN event_type <> 'error' OR user_id % 20 < 15 THEN 1 ELSE 0 END) AS critical_fields_found,
  count(*) AS quorum_comparisons, sum(CASE WHEN event_type = 'error' AND user_id % 20 = 3 THEN 1 ELSE 0 END) AS quorum_conflicts,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS paid_escalations
FROM events GROUP BY 1, 2
""",
    "secret_texts": """
SELECT doc_id, source, replace(text, 'token = "', 'access_token = "') AS text,
  concat('https://site.example/d/', CAST(doc_id AS STRING), CASE WHEN doc_id % 9 = 0 THEN '?api_key=abc&page=1' ELSE '?page=1' END) AS url
FROM documents
""",
    "price_texts": """
SELECT l_orderkey * 10 + l_linenumber AS text_id, CASE l_linenumber % 4
  WHEN 0 THEN concat('USD ', CAST(floor(l_extendedprice / 1000) AS BIGINT), '.', substring(CAST(1000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 2), ',50')
  WHEN 1 THEN concat('$', CAST(floor(l_extendedprice / 1000) AS BIGINT), ',', substring(CAST(1000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 2), '.25')
  WHEN 2 THEN concat('-', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), ' EUR') ELSE 'sold out' END AS raw
FROM lineitem
""",
    "seeds": """
SELECT concat('https://site', CAST(user_id % 20 AS STRING), '.example/item/', CAST(user_id AS STRING)) AS url FROM events
UNION ALL SELECT url FROM pages WHERE page_id % 7 = 0
""",
    "queued_pages": """
SELECT page_id FROM pages WHERE page_id % 3 = 0
""",
    "rules": """
SELECT 0 AS position, 'api' AS url_class, '^https?://api[.]' AS pattern, 2 AS min_body_bytes, '' AS canary, 'json' AS expected_type, 'items.0.id;next' AS json_paths, '' AS signatures
UNION ALL SELECT 1, 'english', '^https?://[^/]+/en/', 200, '<article', 'html', '', 'blocked by policy;spam-farm'
UNION ALL SELECT 2, 'spanish', '^https?://[^/]+/es/', 200, '<article;</p>', '', '', ''
UNION ALL SELECT 3, 'french', '^https?://[^/]+/fr/', 200, '<article', '', '', ''
UNION ALL SELECT 4, 'german', '^https?://[^/]+/de/', 200, '<article', '', '', ''
UNION ALL SELECT 5, 'paged', '[?&]page=', 200, '<article', '', '', ''
""",
    "profile_classes": """
SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class, user_id % 20 <> 1 AS has_freshness, user_id % 20 <> 1 AS has_promotion, user_id % 3 = 1 AS has_pagination FROM events
""",
    "profile_fields": """
SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class, 'title' AS field, CASE WHEN user_id % 20 = 5 THEN 'optional' ELSE 'critical' END AS importance FROM events
UNION ALL SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example'), CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END, 'lead', 'optional' FROM events
""",
    "case_outcomes": """
SELECT event_id AS case_id, concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class,
  CASE WHEN event_type = 'signup' THEN 'not_found' WHEN event_type = 'purchase' AND user_id % 3 = 1 AND user_id % 20 <> 8 THEN 'pagination' ELSE 'normal' END AS kind, event_type = 'signup' AS negative,
  CASE WHEN event_type = 'signup' THEN 'DEAD_URL' ELSE 'OK' END AS verdict, NOT (user_id % 20 = 3 AND event_id % 50 = 0) AS passed, 10 AS comparisons, CASE WHEN user_id % 20 = 4 THEN 1 ELSE 0 END AS conflicts
FROM events WHERE user_id % 20 <> 7
""",
    "case_fields": """
SELECT event_id AS case_id, 'title' AS field FROM events WHERE event_type <> 'signup' AND NOT (user_id % 20 = 6 AND event_id % 40 = 0)
UNION ALL SELECT event_id, 'lead' FROM events WHERE event_id % 2 = 0
""",
    "excused_kinds": """
SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class, 'pagination' AS kind FROM events WHERE user_id % 20 = 8
""",
    "extractor_grades": """
SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class, 'title' AS field, CASE WHEN user_id % 20 = 5 THEN 'optional' ELSE 'critical' END AS importance, CASE WHEN user_id % 20 = 9 THEN 'FRAGILE' ELSE 'STABLE' END AS grade FROM events
UNION ALL SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example'), CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END, 'title', 'critical', 'FRAGILE' FROM events WHERE user_id % 20 = 10
""",
    "api_routes": """
SELECT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class, concat('r', CAST(user_id % 60 AS STRING)) AS route_id, count(DISTINCT event_id % 50) AS distinct_pages, user_id % 20 <> 12 AS schema_stable, 'VALIDATED' AS state
FROM events WHERE user_id % 20 IN (11, 12) GROUP BY user_id % 20, user_id % 60, user_id % 3
""",
    "mutation_runs": """
SELECT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE event_id % 9 WHEN 0 THEN 'remove_optional_field' WHEN 1 THEN 'remove_critical_field' WHEN 2 THEN 'rename_css_class' WHEN 3 THEN 'wrap_dom_node' WHEN 4 THEN 'move_element' WHEN 5 THEN 'rename_json_key' WHEN 6 THEN 'empty_collection' WHEN 7 THEN 'change_field_type' ELSE 'remove_pagination_cursor' END AS kind,
  CASE WHEN event_id % 9 IN (0, 1) THEN 'title' ELSE '' END AS target,
  CASE WHEN user_id % 20 = 13 AND event_id % 9 = 1 THEN 'WARNS' WHEN user_id % 20 = 14 AND event_id % 9 = 7 THEN 'SURVIVES' WHEN event_id % 9 IN (0, 2, 3, 4) THEN 'SURVIVES' WHEN event_id % 9 = 6 THEN 'EMPTY' WHEN event_id % 9 = 8 THEN 'INCOMPLETE' WHEN event_id % 9 = 5 THEN 'DRIFT' ELSE 'FAILS' END AS observed
FROM events WHERE event_id % 10 = 0 AND user_id % 20 <> 15
""",
    "profile_texts": """
SELECT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE WHEN user_id % 20 = 16 THEN concat('api_key: ', 'abcdefgh', CAST(user_id % 20 AS STRING)) ELSE 'match: /item/' END AS text FROM events GROUP BY user_id % 20
""",
    "declared_routes": """
SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example') AS domain, CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END AS url_class, 0 AS position, 's0' AS strategy, CASE WHEN user_id % 20 < 15 THEN 'L2' ELSE 'L1' END AS level FROM events
UNION ALL SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example'), CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END, 1, 's1', 'L0' FROM events
UNION ALL SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example'), CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END, 2, 's1', 'L2' FROM events
UNION ALL SELECT DISTINCT concat('site', CAST(user_id % 20 AS STRING), '.example'), CASE user_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'listing' ELSE 'rankings' END, 3, 's0', 'L3' FROM events
""",
}
