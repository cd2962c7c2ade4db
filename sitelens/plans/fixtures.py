"""Adapters from the given tables to the engine's inputs: one SQL text each, the same for Spark and for the check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {
    "fx_search": """
SELECT CAST(l_shipdate AS DATE) AS date,
       concat('q', CAST(l_partkey % 400 AS STRING)) AS query,
       concat('/p/', CAST(l_suppkey AS STRING)) AS page,
       CASE l_linenumber % 3 WHEN 0 THEN 'MOBILE' WHEN 1 THEN 'DESKTOP' ELSE 'TABLET' END AS device,
       l_returnflag AS country,
       CASE WHEN l_linenumber = 7 THEN 'discover' WHEN l_linenumber = 6 THEN 'googleNews' ELSE 'web' END AS search_type,
       CAST(floor(l_quantity * 20) AS BIGINT) AS impressions,
       CAST(floor(l_quantity * 20 * l_discount * (l_suppkey % 4) * 0.5) AS BIGINT) AS clicks,
       CAST(10 + (l_suppkey * 37) % 250 + (l_partkey % 11) * 2 AS DOUBLE) / 10 AS position,
       concat('site', CAST(l_suppkey % 3 AS STRING)) AS site,
       CASE WHEN l_partkey % 5 = 0 THEN 'AI_OVERVIEW' WHEN l_partkey % 7 = 0 THEN 'RICH_RESULT' ELSE 'NONE' END AS search_appearance
FROM lineitem""",
    "fx_pages": """
SELECT page_id, url,
       regexp_extract(url, '^https?://([^/?#]+)', 1) AS site,
       regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
       regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
       regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
       length(html) AS html_chars
FROM pages""",
    "fx_evidence": """
SELECT page_id, url, site, path, title, h1, lang,
       CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 9 = 0 THEN concat(title, title, title, h1) ELSE concat(title, ' ', h1) END AS description,
       CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS canonical,
       CAST(floor(html_chars / 12.0) AS BIGINT) - 80 AS words,
       page_id % 3 <> 0 AS has_viewport, page_id % 11 = 0 AS noindex, page_id % 2 = 0 AND page_id % 13 <> 1 AS has_schema,
       CAST(page_id % 7 AS BIGINT) - 3 AS images_missing_alt, url LIKE 'https%' AS has_https
FROM fx_pages""",
    "fx_prose": """
SELECT source AS site, concat('/d/', CAST(doc_id AS STRING)) AS path, substring(text, 1, 60) AS title, substring(text, 1, 40) AS h1,
       substring(text, 41, 50) AS heading, text AS prose, CAST(doc_id % 5 AS DOUBLE) / 10 AS link_density
FROM documents""",
    "fx_links": """
SELECT concat('/n/', CAST(CAST(floor((c_custkey - 1) / 3.0) AS BIGINT) AS STRING)) AS src,
       concat('/n/', CAST(c_custkey AS STRING)) AS dst
FROM customer WHERE c_custkey > 0 AND c_custkey % 17 <> 0
UNION ALL
SELECT concat('/n/', CAST(c_custkey AS STRING)) AS src,
       concat('/n/', CAST((c_custkey * 7) % 100 AS STRING)) AS dst
FROM customer WHERE c_custkey % 5 = 0""",
    "fx_answers": """
SELECT d.source AS site, d.doc_id AS item_id, q.question_id, q.type,
       CAST((d.doc_id * 7919 + q.k * 104729) % 1001 AS DOUBLE) / 1000 AS p
FROM documents d CROSS JOIN (
  SELECT 1 AS k, 'is_real_query' AS question_id, 'noul' AS type UNION ALL
  SELECT 2, 'is_buyer_query', 'noul' UNION ALL SELECT 3, 'rival_serves', 'noul' UNION ALL
  SELECT 4, 'our_serves', 'noul' UNION ALL SELECT 5, 'our_own_subject', 'noul' UNION ALL
  SELECT 6, 'our_coverage', 'score' UNION ALL SELECT 7, 'deliverable', 'choice' UNION ALL
  SELECT 8, 'importance', 'score' UNION ALL SELECT 9, 'highest_impact_change', 'choice') q""",
    "fx_runs": """
SELECT d.source AS root, r.run_no, concat('/d/', CAST(d.doc_id AS STRING)) AS path,
       (d.doc_id * 31 + r.run_no * 17) % 11 <> 0 AS reachable,
       (d.doc_id * 31 + r.run_no * 17) % 11 <> 0 AND (d.doc_id * 13 + r.run_no * 7) % 5 < 3 AS raised,
       concat('k', CAST((d.doc_id + r.run_no * (d.doc_id % 7)) % 9 AS STRING)) AS change_key,
       CAST((d.doc_id * 5 + r.run_no * (d.doc_id % 3)) % 3 AS INT) AS band_rank
FROM documents d CROSS JOIN (SELECT 1 AS run_no UNION ALL SELECT 2) r
WHERE (d.doc_id + r.run_no * 7) % 13 <> 0""",
    "fx_events": """
SELECT event_id AS seq, ts, concat('run', CAST(user_id % 20 AS STRING)) AS run_id,
       CASE event_type WHEN 'view' THEN 'page-start' WHEN 'click' THEN 'page-done'
            WHEN 'signup' THEN 'keyword-done' WHEN 'purchase' THEN 'gap-done' ELSE 'error' END AS type,
       concat('i', CAST(user_id AS STRING), '.', CAST(event_id % 37 AS STRING)) AS item_key, value AS cost
FROM events""",
    "fx_typed": """
SELECT q.scope, d.source AS site, d.doc_id AS item_id, q.question_id, q.type,
       CASE q.type WHEN 'choice' THEN split_part(q.options, ',', CAST((d.doc_id * 31 + q.k * 17) % q.n AS INT) + 1) END AS choice,
       CASE q.type WHEN 'choice' THEN split_part(q.options, ',', CAST((d.doc_id * 31 + q.k * 17 + 1 + d.doc_id % (q.n - 1)) % q.n AS INT) + 1) END AS other,
       CASE q.type WHEN 'choice' THEN CAST(CASE WHEN q.scope = 'keyword' AND d.doc_id % 3 = 1 THEN (CASE WHEN q.scope = 'keyword' AND d.doc_id % 3 = 1 THEN 960 + (d.doc_id * 7919 + q.k * 104729) % 41 ELSE (d.doc_id * 7919 + q.k * 104729) END) ELSE 300 + (CASE WHEN q.scope = 'keyword' AND d.doc_id % 3 = 1 THEN 960 + (d.doc_id * 7919 + q.k * 104729) % 41 ELSE (d.doc_id * 7919 + q.k * 104729) END) % 701 END AS DOUBLE) / 1000 END AS confidence,
       CASE q.type WHEN 'score' THEN CAST(least(3000, ((d.doc_id + q.k) % 4) * 1000 + (CASE WHEN q.scope = 'keyword' AND d.doc_id % 3 = 1 THEN 960 + (d.doc_id * 7919 + q.k * 104729) % 41 ELSE (d.doc_id * 7919 + q.k * 104729) END) % 1001) AS DOUBLE) / 1000 END AS score,
       CASE q.type WHEN 'noul' THEN CAST((CASE WHEN q.scope = 'keyword' AND d.doc_id % 3 = 1 THEN 960 + (d.doc_id * 7919 + q.k * 104729) % 41 ELSE (d.doc_id * 7919 + q.k * 104729) END) % 1001 AS DOUBLE) / 1000 END AS noul, q.n AS levels, (CASE WHEN q.scope = 'keyword' AND d.doc_id % 3 = 1 THEN 960 + (d.doc_id * 7919 + q.k * 104729) % 41 ELSE (d.doc_id * 7919 + q.k * 104729) END) AS h, (d.doc_id + q.k) % 4 AS low
FROM documents d CROSS JOIN (
  SELECT 'page' AS scope, 1 AS k, 'page_type' AS question_id, 'choice' AS type, 11 AS n, 'homepage,product_or_service,category_or_listing,article_or_guide,about_or_team,contact_or_location,pricing,case_study_or_proof,support_or_docs,legal_or_policy,other' AS options
  UNION ALL SELECT 'page', 2, 'intent', 'choice', 6, 'informational,commercial,transactional,navigational,local,unclear'
  UNION ALL SELECT 'page', 3, 'action', 'choice', 4, 'keep_or_improve,rewrite,merge_or_remove,cannot_tell'
  UNION ALL SELECT 'page', 4, 'highest_impact_change', 'choice', 10, 'answer_in_the_first_two_sentences,add_self_contained_facts,add_proof_and_sources,name_an_author,link_onward,break_it_into_sections,name_one_action,retitle_for_the_searcher,narrow_or_split_the_page,nothing_missing'
  UNION ALL SELECT 'page', 5, 'importance', 'score', 4, '' UNION ALL SELECT 'page', 6, 'helpfulness', 'score', 4, '' UNION ALL SELECT 'page', 7, 'specificity', 'score', 4, ''
  UNION ALL SELECT 'page', 8, 'citable', 'score', 4, '' UNION ALL SELECT 'page', 9, 'trust', 'score', 4, '' UNION ALL SELECT 'page', 10, 'title_fit', 'score', 4, ''
  UNION ALL SELECT 'page', 11, 'meta_fit', 'score', 4, '' UNION ALL SELECT 'page', 12, 'structure_ease', 'score', 4, '' UNION ALL SELECT 'page', 13, 'content_freshness', 'score', 4, ''
  UNION ALL SELECT 'page', 14, 'h1_fit', 'noul', 0, '' UNION ALL SELECT 'page', 15, 'answer_first', 'noul', 0, '' UNION ALL SELECT 'page', 16, 'clear_next_step', 'noul', 0, '' UNION ALL SELECT 'page', 17, 'competitor_distinctiveness', 'noul', 0, ''
  UNION ALL SELECT 'keyword', 21, 'intent', 'choice', 6, 'informational,commercial,transactional,navigational,local,unclear'
  UNION ALL SELECT 'keyword', 22, 'cluster', 'choice', 7, 'products_or_services,pricing_or_commercial,trust_and_proof,how_to_and_support,location_and_local,brand,other'
  UNION ALL SELECT 'keyword', 23, 'is_buyer_query', 'noul', 0, '' UNION ALL SELECT 'keyword', 24, 'is_real_query', 'noul', 0, '' UNION ALL SELECT 'keyword', 25, 'coverage_gap', 'noul', 0, ''
  UNION ALL SELECT 'keyword', 26, 'trust_bar', 'noul', 0, '' UNION ALL SELECT 'keyword', 27, 'difficulty_proxy', 'score', 4, ''
  UNION ALL SELECT 'gap', 31, 'is_real_query', 'noul', 0, '' UNION ALL SELECT 'gap', 32, 'is_buyer_query', 'noul', 0, '' UNION ALL SELECT 'gap', 33, 'rival_serves', 'noul', 0, '' UNION ALL SELECT 'gap', 34, 'our_serves', 'noul', 0, ''
  UNION ALL SELECT 'gap', 35, 'our_own_subject', 'noul', 0, '' UNION ALL SELECT 'gap', 36, 'our_coverage', 'score', 4, '' UNION ALL SELECT 'gap', 37, 'deliverable', 'choice', 7, 'pillar,how_to,comparison,faq,product,refresh_existing,none'
  UNION ALL SELECT 'competitor', 41, 'business_model', 'choice', 4, 'services,shop,software,other' UNION ALL SELECT 'competitor', 42, 'ai_gap', 'choice', 4, 'facts,authors,structure,none' UNION ALL SELECT 'competitor', 43, 'worth_copying', 'noul', 0, ''
  UNION ALL SELECT 'competitor', 44, 'value_prop', 'score', 4, '' UNION ALL SELECT 'competitor', 45, 'topical_focus', 'score', 4, '') q
WHERE (d.doc_id + q.k) % 23 <> 0""",
    "fx_probs": """
SELECT scope, site, item_id, question_id, type, levels, choice AS label, confidence AS p FROM fx_typed WHERE type = 'choice'
UNION ALL SELECT scope, site, item_id, question_id, type, levels, other, CAST(CASE WHEN h <= 1000 THEN 1000 - h ELSE 700 - h % 701 END * 6 AS DOUBLE) / 10000 FROM fx_typed WHERE type = 'choice'
UNION ALL SELECT scope, site, item_id, question_id, type, levels, CAST(least(3, low + 1) AS STRING), CAST(h % 1001 AS DOUBLE) / 1000 FROM fx_typed WHERE type = 'score'
UNION ALL SELECT scope, site, item_id, question_id, type, levels, CAST(low AS STRING), CAST(1000 - h % 1001 AS DOUBLE) / 1000 FROM fx_typed WHERE type = 'score'
UNION ALL SELECT scope, site, item_id, question_id, type, levels, 'yes', noul FROM fx_typed WHERE type = 'noul'""",
    "fx_items": """
SELECT source AS site, doc_id AS item_id, concat('/d/', CAST(doc_id AS STRING)) AS path, concat('The ', CASE doc_id % 5 WHEN 0 THEN 'boiler' WHEN 1 THEN 'drain' WHEN 2 THEN 'heat-pump' WHEN 3 THEN 'tap' ELSE 'of it' END, ' repair plan ', CAST(doc_id % 97 AS STRING)) AS term,
       CAST(floor(n_chars / 6.0) AS BIGINT) AS words, CAST((doc_id * 37) % 100 AS DOUBLE) / 1000 AS inbound_share, CAST(doc_id % 5 AS BIGINT) AS in_headings, CAST(doc_id % 6 AS BIGINT) AS page_count, CAST(doc_id % 3 AS BIGINT) AS rival_pages,
       CASE WHEN doc_id % 6 <> 0 AND doc_id % 2 = 0 THEN concat('/own/', CAST(doc_id % 11 AS STRING)) END AS existing, CASE WHEN doc_id % 6 <> 0 THEN concat('/first/', CAST(doc_id % 7 AS STRING)) END AS first_path, doc_id % 4 = 0 AS is_seed
FROM documents""",
    "fx_titles": """
SELECT source AS site, concat('https://rival', CAST(doc_id % 4 AS STRING), '.org/x') AS rival, doc_id AS place, concat(CASE doc_id % 5 WHEN 0 THEN 'Boiler' WHEN 1 THEN 'A drain' WHEN 2 THEN 'Heat pump' WHEN 3 THEN 'Tap' ELSE 'Roof' END, ' repair, ', CAST(doc_id % 31 AS STRING)) AS title
FROM documents WHERE doc_id % 7 = 0 AND CAST(right(source, 1) AS STRING) NOT IN ('3', '8')""",
    "fx_robots": """
SELECT s_suppkey AS n, concat('site', CAST(s_suppkey AS STRING)) AS site, concat('/p/', CAST(s_suppkey % 37 AS STRING)) AS path,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL
            WHEN s_suppkey % 3 = 0 THEN concat_ws(chr(10), '# made by hand', 'User-agent: *', 'Disallow: /private # not this', concat('Disallow: /p/', CAST(s_suppkey % 5 AS STRING)), 'Disallow:', '', 'Sitemap: https://x.example/sitemap.xml', 'Disallow: /after')
            WHEN s_suppkey % 3 = 1 THEN concat_ws(chr(10), 'User-agent: GPTBot', 'User-agent: CCBot', 'Disallow: /', '', 'USER-AGENT: *', ' Allow : /p/1', 'Disallow: /p', 'Crawl-delay: 5', 'no directive')
            ELSE concat_ws(chr(10), 'User-agent: *', 'User-agent: claudebot', 'Disallow: /p/2', 'Allow: /p/21', '', 'Disallow: /p/3', 'User-agent: perplexitybot', '', 'User-agent: spider', 'Disallow: /p', 'sitemap: https://y.example/a.xml') END AS text
FROM supplier""",
    "fx_sitemaps": """
SELECT p_partkey AS n, concat('https://m.example/', CAST(p_partkey AS STRING), '.xml') AS url,
       CASE WHEN p_partkey % 5 = 0 THEN concat('<?xml version="1.0"?><SitemapIndex><sitemap><loc> https://m.example/', CAST(p_partkey + 1 AS STRING), '.xml </loc></sitemap><sitemap><LOC>https://m.example/', CAST((p_partkey * 3) % 40 AS STRING), '.xml</LOC></sitemap><sitemap><loc>https://m.example/', CAST(p_partkey AS STRING), '.xml</loc></sitemap><loc>https://m.example/', CASE WHEN p_partkey % 20 = 0 THEN 'none' ELSE CAST(p_partkey - 5 AS STRING) END, '.xml</loc></SitemapIndex>')
            ELSE concat('<urlset><url><loc>https://w.example/', CAST(p_partkey % 83 AS STRING), '</loc></url><url><loc>https://w.example/n', CAST(p_partkey AS STRING), '</loc></url><url><loc></loc></url></urlset>') END AS body
FROM part""",
    "fx_hreflang": """
SELECT page_id, c, k, concat('https://s.example/', CASE m WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END, '/', CAST(c AS STRING)) AS url, CASE WHEN c % 4 = 0 THEN '' ELSE concat('https://s.example/', CASE m WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END, '/', CAST(c AS STRING), '/') END AS canonical,
       CASE WHEN k = 3 THEN 'x-default' WHEN k = 0 THEN CASE c % 9 WHEN 0 THEN 'jp' WHEN 1 THEN 'eng-US' WHEN 2 THEN 'en-UK' WHEN 3 THEN 'zh-Hans' WHEN 4 THEN 'xx' WHEN 5 THEN 'EN-gb' ELSE 'en' END WHEN k = 1 THEN 'de' ELSE 'fr-CA' END AS lang,
       concat(CASE WHEN c % 11 = 0 AND k = 2 THEN 'http' ELSE 'https' END, '://s.example/', CASE k WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'en' END, '/', CAST(c AS STRING), CASE WHEN k = 1 THEN '/' ELSE '' END) AS href,
       NOT (k = 3 AND c % 2 = 1 OR k = m AND c % 5 = 0 OR m = 2 AND k = 0 AND c % 3 = 0 OR c % 13 = 0) AS used
FROM (SELECT page_id, CAST(floor(page_id / 3.0) AS BIGINT) AS c, page_id % 3 AS m, k FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks) t""",
    "fx_blocks": """
SELECT page_id, concat('https://s.example/', CASE page_id % 5 WHEN 0 THEN 'FAQ' WHEN 1 THEN 'blog/x' WHEN 2 THEN 'products' WHEN 3 THEN 'contact' ELSE 'a' END, '/', CAST(page_id AS STRING)) AS url, k AS place,
       CASE (page_id + k * 3) % 8 WHEN 0 THEN '{"@type": "Article", "headline": "h", "datePublished": "2024-01-01"}'
            WHEN 1 THEN '[{"@type": "Product", "name": "a", "offers": {}}, 5, {"@type": ["WebSite", "Thing", 3], "name": "n", "url": "u"}]'
            WHEN 2 THEN '{"@context": "c", "@graph": [{"@type": "Organization", "name": "o", "@graph": [{"@type": "FAQPage"}, [1], {"name": "no type"}]}, {"@type": 7}, "text"]}'
            WHEN 3 THEN 'not json {'
            WHEN 4 THEN '{"@type": "A0", "@graph": [{"@type": "A1", "@graph": [{"@type": "A2", "@graph": [{"@type": "A3", "@graph": [{"@type": "A4", "@graph": [{"@type": "A5"}]}]}]}]}]}'
            WHEN 5 THEN NULL WHEN 6 THEN '{"@type": "FAQPage", "mainEntity": [1, 2]}' ELSE '{"@type": "BlogPosting", "headline": "h", "author": {"name": "n"}, "datePublished": null}' END AS block
FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) ks""",
    "fx_replies": """
SELECT scope, site, item_id, question_id,
       CASE WHEN item_id % 13 = 5 THEN '{"cut": {"type": "no' WHEN item_id % 13 = 6 THEN '[1, 2]'
            ELSE concat('{"', question_id, '": {', CASE WHEN item_id % 3 = 0 THEN '' ELSE concat('"type": "', upper(type), '", ') END,
                 CASE type WHEN 'choice' THEN concat('"choice": "', choice, '", "confidence": ', CAST(confidence AS STRING), ', "probabilities": {"', choice, '": ', CAST(confidence AS STRING), ', "', other, '": 0.25}')
                      WHEN 'score' THEN concat('"score": ', CAST(score AS STRING), ', "confidence": "0.5"') ELSE concat('"noul": ', CAST(noul AS STRING)) END,
                 '}, "note": "text", "half": {"confidence": 1}}') END AS reply
FROM fx_typed""",
    "fx_research": """
SELECT doc_id AS item_id, concat('run', CAST(doc_id % 20 AS STRING)) AS run_id, doc_id % 14 AS variant,
       CASE doc_id % 14 WHEN 0 THEN '{"business_name": ' WHEN 1 THEN '[1]'
            WHEN 2 THEN '{"business_name": null, "business_summary": "s", "market": null, "competitors": [], "keyword_seeds": [], "metrics": [], "notes": [], "verdict": "good"}'
            WHEN 3 THEN '{"business_name": "", "business_summary": 5, "competitors": {}, "keyword_seeds": [], "metrics": [], "notes": ["a", 2]}'
            WHEN 4 THEN '{"business_name": "b", "business_summary": "s", "market": "m", "competitors": [{"name": "n", "url": "u", "why": "w", "evidence_tool": "error", "evidence_query": "q"}], "keyword_seeds": [{"term": "t", "intent": "buying", "evidence_tool": "t", "score": 1}], "metrics": [], "notes": []}'
            WHEN 5 THEN '{"business_name": "b", "business_summary": "s", "market": "m", "competitors": [], "keyword_seeds": [7], "metrics": [{"key": "k", "label": "l", "number": {"value": "5", "source_tool": "", "raw": "5", "more": 1}}, {"key": "k", "label": "l", "number": 5}], "notes": null}'
            ELSE concat('{"business_name": "b', CAST(doc_id AS STRING), '", "business_summary": null, "market": "m", "competitors": [{"name": "rival', CAST(doc_id % 9 AS STRING), '", "url": "u", "why": "w", "evidence_tool": " Page-Done ", "evidence_query": "q", "angle": "direct"}], "keyword_seeds": [{"term": "term', CAST(doc_id % 30 AS STRING), '", "intent": "commercial", "evidence_tool": "',
                        CASE WHEN doc_id % 2 = 0 THEN 'gap-done' ELSE 'error' END, '"}], "metrics": [{"key": "m', CAST(doc_id % 4 AS STRING), '", "label": "l", "number": {"value": ', CAST(1000 + doc_id % 50 AS STRING), ', "source_tool": "keyword-done", "raw": "about ', CASE WHEN doc_id % 3 = 0 THEN '1,' ELSE '9.' END, CAST(doc_id % 50 + 1000 AS STRING), CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' visits' END, '"}}, {"key": "x", "label": "l", "number": {"value": ', CAST(doc_id % 7 + 20 AS STRING), ', "source_tool": "keyword-done", "raw": "2', CAST(doc_id % 3 AS STRING), '"}}], "notes": []}') END AS output
FROM documents""",
    "fx_responses": """
SELECT page_id, url, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 301 ELSE 200 END AS status,
       concat('{"Cache-Control": "', CASE WHEN page_id % 6 = 0 THEN 'No-Store' ELSE 'max-age=5' END, '"', CASE WHEN page_id % 2 = 0 THEN ', "X-Frame-Options": "DENY", "referrer-policy": "same-origin"' ELSE '' END, CASE WHEN page_id % 3 = 0 THEN ', "x-content-type-options": "nosniff"' ELSE '' END, CASE WHEN page_id % 8 = 3 THEN ', "Speculation-Rules": "rules.json"' ELSE '' END, '}') AS headers,
       CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 4 = 0 THEN concat(title, ' and something that makes it longer than it was') ELSE substring(title, 1, CAST(20 + page_id % 30 AS INT)) END AS title,
       CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 5 = 0 THEN substring(title, 1, 30) WHEN page_id % 7 = 0 THEN concat(title, title, title, title, title, title, title, title) ELSE concat(title, ' ', title, ' ', title) END AS description,
       CASE WHEN page_id % 10 = 0 THEN 'NoIndex, nofollow' WHEN page_id % 10 = 1 THEN 'nofollow' ELSE '' END AS robots, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN concat(url, '/') WHEN page_id % 5 = 2 THEN 'https://other.example/' ELSE url END AS canonical,
       CASE WHEN page_id % 3 = 0 THEN '' ELSE 'width=device-width' END AS viewport, CASE WHEN page_id % 4 = 1 THEN NULL ELSE lang END AS lang, CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id % 11 = 3 END AS blocked,
       concat('<html><head>', CASE page_id % 5 WHEN 0 THEN '<script type="speculationrules">{"prefetch": [], "prerender": [1]}</script>' WHEN 1 THEN '<SCRIPT async type = "speculationrules">{"prefetch": {}}</SCRIPT><script type="speculationrules" id="x">  {"prefetch": [1]} </script>' WHEN 2 THEN '<script type="speculationrules">broken</script>' ELSE '<script>speculationrules</script>' END,
              CASE page_id % 3 WHEN 0 THEN '<link rel="preload" as="image" href="/a.png">' WHEN 1 THEN '<link href="/h.png" rel="preload" as="image" fetchpriority="high"><link rel="preload" as="font">' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN '<LINK rel="prerender" href="/x">' ELSE '' END, '</head></html>') AS html
FROM fx_pages""",
    "fx_reports": """
SELECT page_id, CASE WHEN page_id % 19 = 0 THEN 'no report' WHEN page_id % 19 = 1 THEN '{"lighthouseResult": {"audits": {}}}'
            ELSE concat('{"lighthouseResult": {"categories": {"performance": {"score": ', CAST(CAST(page_id % 101 AS DOUBLE) / 100 AS STRING), '}}, "audits": {"first-contentful-paint": {"score": 0.5, "numericValue": ', CAST(page_id AS STRING), '.5, "displayValue": "x"}, "interactive": {"numericValue": 7},',
                 '"b-late": {"score": 0.', CAST(page_id % 10 AS STRING), ', "details": {"type": "opportunity"}}, "a-early": {"score": 0.', CAST(page_id % 7 AS STRING), ', "title": "t", "details": {"type": "opportunity"}}, "none": {"score": null, "details": {"type": "opportunity"}}, "table": {"score": 0.1, "details": {"type": "table"}}, "c": {"score": 0.3, "details": {"type": "opportunity"}}, "d": {"score": 0.3, "details": {"type": "opportunity"}}}}}') END AS report
FROM pages""",
    "fx_console": """
SELECT c_custkey AS n, concat('acc', CAST(c_custkey % 40 AS STRING)) AS account, concat('https://', CASE WHEN c_custkey % 2 = 0 THEN 'WWW.' ELSE '' END, 'h', CAST(c_custkey % 50 AS STRING), '.example/x') AS url,
       CASE WHEN c_custkey % 29 = 0 THEN 'bad' ELSE concat('{"siteEntry": [{"siteUrl": "https://h', CAST(c_custkey % 50 AS STRING), '.example/", "permissionLevel": "siteFullUser"}, {"permissionLevel": "siteOwner"}, {"siteUrl": "sc-domain:h', CAST((c_custkey + c_custkey % 3) % 50 AS STRING), '.example", "permissionLevel": "', CASE c_custkey % 4 WHEN 0 THEN 'siteOwner' WHEN 1 THEN 'siteRestrictedUser' WHEN 2 THEN 'other' ELSE 'siteFullUser' END, '"}, {"siteUrl": "https://www.h', CAST((c_custkey + 1) % 50 AS STRING), '.example/"}]}') END AS listing,
       CASE WHEN c_custkey % 23 = 0 THEN 'bad' WHEN c_custkey % 23 = 1 THEN '{"inspectionResult": {"inspectionResultLink": "l"}}' ELSE concat('{"inspectionResult": {"inspectionResultLink": "l', CAST(c_custkey AS STRING), '", "mobileUsabilityResult": {"verdict": "PASS"}, "indexStatusResult": {"verdict": "', CASE WHEN c_custkey % 3 = 0 THEN 'PASS' ELSE 'NEUTRAL' END, '", "coverageState": "', CASE c_custkey % 4 WHEN 0 THEN 'Excluded by noindex tag' WHEN 1 THEN 'Duplicate' WHEN 2 THEN 'Crawled - currently not indexed' ELSE '' END, '", "pageFetchState": "SUCCESSFUL", "sitemap": ["a", "b"]', CASE WHEN c_custkey % 5 = 0 THEN ', "crawledAs": "MOBILE", "robotsTxtState": "BLOCKED_BY_ROBOTS_TXT"' ELSE '' END, '}}}') END AS response,
       CASE WHEN c_custkey % 31 = 0 THEN '{"sitemap": []}' ELSE concat('{"sitemap": [{"path": "s', CAST(c_custkey AS STRING), '", "isPending": ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ', "warnings": "', CAST(c_custkey % 6 AS STRING), '", "contents": [{"type": "web", "submitted": "5"}]}, {"path": "t", "isSitemapsIndex": true, "errors": ', CAST(c_custkey % 3 AS STRING), '}]}') END AS sitemaps,
       CASE c_custkey % 6 WHEN 0 THEN '{"sessionID": "s1", "part": {"type": "text", "text": "abc"}}' WHEN 1 THEN '{"part": {"type": "tool", "tool": "search", "state": {"status": "completed", "output": "out"}}}' WHEN 2 THEN concat('{"part": {"type": "step-finish", "tokens": {"input": ', CAST(c_custkey AS STRING), ', "output": 5}, "cost": 0.25}}')
                          WHEN 3 THEN ' not json' WHEN 4 THEN '{"part": {"type": "tool", "state": {"error": "failed"}}}' ELSE '{"part": {"type": "tex' END AS line
FROM customer""",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The adapter ``name`` over the tables of ``folder``."""
    plain = ADAPTERS[name].replace("{", "{{").replace("}", "}}")
    if re.search(r"\bFROM fx_", plain):
        inner = re.search(r"\bFROM (fx_\w+)", plain)[1]
        return spark.sql(plain.replace(f"FROM {inner}", f"FROM {{{inner}}}"), **{inner: frame(spark, folder, inner)})
    used = [t for t in _TABLES if re.search(rf"\bFROM {t}\b", plain)]
    text = re.sub(r"\bFROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in used else m[0], plain)
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def with_adapters(sql: str) -> str:
    """SQL with the adapters that it names put before it."""
    names, text = [], sql
    for n in reversed(ADAPTERS):  # an adapter reads only those before it
        if re.search(rf"\b{n}\b", text):
            names.insert(0, n)
            text += ADAPTERS[n]
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in names)
    if not names:
        return sql.strip()
    sql = sql.strip()
    return f"WITH {ctes},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes}\n{sql}"
