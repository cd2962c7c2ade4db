"""Queries of page audits and of what a search console and transcripts say, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page_audit as A
from ..sources import console as C
from .audit_plans import over

_CODES = "array_to_string(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), ',')"
_HEAD = lambda name: f"coalesce(CASE WHEN contains(lower(headers), '\"{name}\"') THEN 'x' END, '') <> ''"


def _coded(frame):
    return frame.withColumn("issues", F.array_join(F.array_sort(F.transform("issues", lambda i: F.concat(i["severity"], F.lit(":"), i["issue"]))), ","))


def _fetched(rows):
    return rows.withColumn("headers", F.from_json("headers", "map<string,string>"))


_TECH = _CODES.format(", ".join([
    "CASE WHEN status = 301 THEN 'low:redirect' END", "CASE WHEN t = 0 THEN 'high:title_missing' WHEN t < 30 THEN 'medium:title_short' WHEN t > 60 THEN 'low:title_long' END",
    "CASE WHEN d = 0 THEN 'medium:description_missing' WHEN d < 50 THEN 'low:description_short' WHEN d > 160 THEN 'low:description_long' END", "CASE WHEN page_id % 10 = 0 THEN 'critical:noindex' END", "CASE WHEN page_id % 10 < 2 THEN 'medium:nofollow' END",
    "CASE WHEN canonical = '' THEN 'medium:canonical_missing' WHEN rtrim(canonical, '/') <> rtrim(url, '/') THEN 'high:canonical_differs' END", "CASE WHEN viewport = '' THEN 'medium:viewport_missing' END", "CASE WHEN coalesce(lang, '') = '' THEN 'low:lang_missing' END",
    "CASE WHEN page_id % 2 <> 0 THEN 'low:no x-frame-options' END", "CASE WHEN page_id % 3 <> 0 THEN 'low:no x-content-type-options' END", "CASE WHEN page_id % 2 <> 0 THEN 'low:no referrer-policy' END", "CASE WHEN blocked THEN 'critical:robots_blocked' END",
]))
over("technical_audit", "fx_responses", f"SELECT page_id, redirected, title_length, description_length, CASE WHEN bad THEN '' ELSE codes END AS issues, CASE WHEN bad OR codes = '' THEN 0 ELSE len(string_split(codes, ',')) END AS issues_count, CASE WHEN bad THEN 0 ELSE len(regexp_extract_all(codes, 'critical:')) END AS critical_count, CASE WHEN bad THEN 'fetch_error' WHEN codes = '' THEN 'healthy' ELSE 'issues_found' END AS verdict FROM (SELECT page_id, status = 301 AS redirected, t AS title_length, d AS description_length, status >= 400 AS bad, {_TECH} AS codes FROM (SELECT *, CAST(length(trim(title)) AS INTEGER) AS t, CAST(length(coalesce(description, '')) AS INTEGER) AS d FROM fx_responses) a) b")(
    lambda r: _coded(A.technical_audit(_fetched(r))).drop("url")
)
_PRE = _CODES.format("CASE WHEN NOT rules THEN 'high:no_rules' END, CASE WHEN rules AND NOT pf THEN 'medium:no_prefetch' END, CASE WHEN rules AND NOT pr THEN 'medium:no_prerender' END, CASE WHEN no_store THEN 'high:no_store' END, CASE WHEN prerender_link THEN 'medium:prerender_link' END, CASE WHEN page_id % 3 = 0 THEN 'medium:image_without_priority' END")
over("preload_audit", "fx_responses", f"SELECT page_id, in_html, in_header, array_to_string(list_filter([CASE WHEN pf THEN 'prefetch' END, CASE WHEN pr THEN 'prerender' END], lambda x: x IS NOT NULL), ',') AS actions, CASE page_id % 3 WHEN 0 THEN 'image|/a.png|' WHEN 1 THEN 'image|/h.png|high,font||' ELSE '' END AS preloads, prerender_link, no_store, CASE WHEN status >= 400 THEN '' ELSE {_PRE} END AS issues, CASE WHEN status >= 400 THEN 'fetch_error' WHEN NOT rules THEN 'not_implemented' WHEN pf AND pr AND NOT no_store THEN 'optimised' ELSE 'improvements_available' END AS verdict FROM (SELECT *, in_html OR in_header AS rules FROM (SELECT page_id, status, page_id % 5 < 3 AS in_html, page_id % 8 = 3 AS in_header, page_id % 5 < 2 AS pf, page_id % 5 = 0 AS pr, contains(lower(html), 'rel=\"prerender\"') AS prerender_link, page_id % 6 = 0 AS no_store FROM fx_responses) a) b")(
    lambda r: _coded(A.preload_audit(_fetched(r))).select("page_id", "in_html", "in_header", F.array_join("actions", ",").alias("actions"), F.array_join(F.transform("preloads", lambda p: F.concat(F.coalesce(p["as"], F.lit("")), F.lit("|"), F.coalesce(p["href"], F.lit("")), F.lit("|"), F.coalesce(p["fetchpriority"], F.lit("")))), ",").alias("preloads"), "prerender_link", "no_store", "issues", "verdict")
)
_AUDIT = "CASE WHEN json_valid(report) THEN CAST(json_extract(report, '$.lighthouseResult.{}') AS {}) END"
over("pagespeed_verdict", "fx_reports", "WITH r AS (SELECT page_id, " + _AUDIT.format("categories.performance.score", "DOUBLE") + " AS score, " + _AUDIT.format('audits."first-contentful-paint".numericValue', "DOUBLE") + " AS fcp, " + _AUDIT.format("audits.interactive.numericValue", "DOUBLE") + " AS tti FROM fx_reports), "
     "o AS (SELECT page_id, unnest(['a-early', 'b-late', 'c', 'd']) AS id, unnest([CAST(page_id % 7 AS DOUBLE) / 10, CAST(page_id % 10 AS DOUBLE) / 10, 0.3, 0.3]) AS score FROM fx_reports WHERE page_id % 19 > 1), "
     "b AS (SELECT page_id, array_to_string(list(id ORDER BY score, id)[1:3], ',') AS opportunities FROM o WHERE score < 0.9 GROUP BY page_id) "
     "SELECT r.page_id, CAST(round_even(score * 100, 0) AS INTEGER) AS performance, fcp, tti, coalesce(opportunities, '') AS opportunities, CASE WHEN score IS NULL THEN 'fetch_error' WHEN round_even(score * 100, 0) >= 90 THEN 'good' WHEN round_even(score * 100, 0) >= 50 THEN 'needs_improvement' ELSE 'poor' END AS verdict FROM r LEFT JOIN b ON b.page_id = r.page_id")(lambda r: A.pagespeed_verdict(r).select("page_id", "performance", "fcp", "tti", F.array_join("opportunities", ",").alias("opportunities"), "verdict"))  # fmt: skip

# ---- the console -----------------------------------------------------------------------------------------------------

_OK, _FULL = "n % 23 > 0", "n % 23 > 1"
over("read_inspections", "fx_console", f"SELECT account AS site, url, CASE WHEN {_FULL} THEN CASE WHEN n % 3 = 0 THEN 'PASS' ELSE 'NEUTRAL' END ELSE 'UNKNOWN' END AS verdict, CASE WHEN {_FULL} THEN CASE n % 4 WHEN 0 THEN 'Excluded by noindex tag' WHEN 1 THEN 'Duplicate' WHEN 2 THEN 'Crawled - currently not indexed' ELSE '' END ELSE 'UNKNOWN' END AS coverage_state, CASE WHEN {_FULL} AND n % 5 = 0 THEN 'MOBILE' ELSE 'UNKNOWN' END AS crawled_as, CASE WHEN {_FULL} THEN 'PASS' ELSE 'UNKNOWN' END AS mobile_verdict, CASE WHEN {_FULL} THEN 'SUCCESSFUL' END AS page_fetch_state, CASE WHEN {_FULL} THEN 'a,b' ELSE '' END AS sitemap, CASE WHEN {_FULL} THEN concat('l', CAST(n AS VARCHAR)) WHEN {_OK} THEN 'l' END AS link, CASE WHEN NOT ({_FULL}) THEN 'not_indexed' WHEN n % 3 = 0 THEN 'indexed' WHEN n % 5 = 0 THEN 'robots_blocked' ELSE CASE n % 4 WHEN 0 THEN 'excluded' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'crawled_not_indexed' ELSE 'not_indexed' END END AS category FROM fx_console")(
    lambda r: C.read_inspections(r.withColumnRenamed("account", "site")).select("site", "url", "verdict", "coverage_state", "crawled_as", "mobile_verdict", "page_fetch_state", F.array_join("sitemap", ",").alias("sitemap"), "link", "category")
)
_ENTRIES = """ent AS (SELECT concat(account, '/', CAST(n AS VARCHAR)) AS account, CAST(k AS INTEGER) AS place, json_extract_string(listing, '$.siteEntry[' || k || '].siteUrl') AS url, json_extract_string(listing, '$.siteEntry[' || k || '].permissionLevel') AS level FROM fx_console, range(0, 4) r(k) WHERE json_valid(listing)),
prop AS (SELECT account, place, url, CASE WHEN level IN ('siteOwner', 'siteFullUser', 'siteRestrictedUser') THEN level ELSE 'unverified' END AS permission FROM ent WHERE url IS NOT NULL)"""


def _listed(rows):
    return rows.withColumn("account", F.concat("account", F.lit("/"), "n"))


over("read_properties", "fx_console", f"WITH {_ENTRIES} SELECT * FROM prop")(lambda r: C.read_properties(_listed(r)))
over("best_property", "fx_console", f"WITH {_ENTRIES} SELECT account, url, permission FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY CASE permission WHEN 'siteOwner' THEN 3 WHEN 'siteFullUser' THEN 2 WHEN 'siteRestrictedUser' THEN 1 ELSE 0 END DESC, place) AS r FROM prop) x WHERE r = 1")(lambda r: C.best_property(C.read_properties(_listed(r))))
_HOST = "regexp_replace(lower(CASE WHEN starts_with({0}, 'sc-domain:') THEN substr({0}, 11) ELSE regexp_extract({0}, '^https?://([^/]*)', 1) END), '^www\\.', '')"
over("match_property", "fx_console", f"WITH {_ENTRIES}, ask AS (SELECT concat(account, '/', CAST(n AS VARCHAR)) AS account, url, concat('sc-domain:', {_HOST.format('url')}) AS k, {_HOST.format('url')} AS host FROM fx_console), hit AS (SELECT a.account, a.url, p.url AS property, permission, row_number() OVER (PARTITION BY a.account, a.url ORDER BY p.url <> a.k, place) AS r FROM ask a JOIN prop p ON p.account = a.account AND {_HOST.format('p.url')} = a.host) SELECT a.account, a.url, coalesce(h.property, a.k) AS property, h.permission, h.property IS NOT NULL AS verified FROM ask a LEFT JOIN hit h ON h.account = a.account AND h.url = a.url AND h.r = 1")(lambda r: C.match_property(_listed(r), C.read_properties(_listed(r))))
over("read_sitemap_status", "fx_console", "SELECT account AS site, CASE k WHEN 0 THEN concat('s', CAST(n AS VARCHAR)) ELSE 't' END AS url, k = 0 AND n % 2 = 0 AS is_pending, k = 1 AS is_index, CAST(CASE k WHEN 0 THEN n % 6 ELSE 0 END AS INTEGER) AS warnings, CAST(CASE k WHEN 1 THEN n % 3 ELSE 0 END AS INTEGER) AS errors, CAST(1 - k AS INTEGER) AS contents FROM fx_console, range(0, 2) r(k) WHERE n % 31 <> 0")(
    lambda r: C.read_sitemap_status(r.select(F.col("account").alias("site"), F.col("sitemaps").alias("listing"))).drop("last_submitted", "last_downloaded")
)
over("read_transcript", "fx_console", "SELECT account AS run_id, n AS line, CASE n % 6 WHEN 1 THEN 'search' ELSE 'unknown' END AS tool, CASE n % 6 WHEN 1 THEN 'completed' ELSE 'unknown' END AS status, n % 6 = 1 AS ok, CASE n % 6 WHEN 1 THEN 'out' ELSE 'failed' END AS output FROM fx_console WHERE n % 6 IN (1, 4)")(lambda r: C.read_transcript(r.select(F.col("account").alias("run_id"), F.col("n").alias("line"), F.col("line").alias("text")))[0])
over("transcript_totals", "fx_console", "SELECT account AS run_id, max(CASE WHEN n % 6 = 0 THEN 's1' END) AS session_id, coalesce(max(CASE WHEN n % 6 = 2 THEN n END), 0) AS input_tokens, CASE WHEN count(*) FILTER (n % 6 = 2) > 0 THEN 5 ELSE 0 END AS output_tokens, CASE WHEN count(*) FILTER (n % 6 = 2) > 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cost, 3 * count(*) FILTER (n % 6 = 0) AS text_chars FROM fx_console WHERE n % 6 NOT IN (3, 5) GROUP BY account")(lambda r: C.read_transcript(r.select(F.col("account").alias("run_id"), F.col("n").alias("line"), F.col("line").alias("text")))[1])
