"""Queries of what is read from files beside pages: robots, sitemaps, replies, structured data, language alternatives; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locales as L
from ..sources import answers as A
from ..sources import robots as R
from ..sources import sitemaps as M
from ..sources import structured as D
from .audit_plans import over
from .catalog import query
from .fixtures import frame, with_adapters

# ---- robots ----------------------------------------------------------------------------------------------------------

_LINES = r"""raw AS (SELECT site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM fx_robots WHERE text IS NOT NULL),
lines AS (SELECT site, CAST(line AS INTEGER) AS line, CASE WHEN raw <> '' THEN lower(trim(split_part(trim(split_part(raw, '#', 1)), ':', 1))) END AS key, CASE WHEN contains(split_part(raw, '#', 1), ':') THEN trim(regexp_replace(split_part(raw, '#', 1), '^[^:]*:', '')) ELSE '' END AS value FROM raw)"""
over("read_robots", "fx_robots", f"WITH {_LINES} SELECT site, line, key AS kind, value FROM (SELECT *, last_value(CASE WHEN key = 'user-agent' THEN value = '*' END IGNORE NULLS) OVER (PARTITION BY site ORDER BY line) AS for_all FROM lines) x WHERE key = 'sitemap' OR key = 'disallow' AND for_all AND value <> ''")(R.read_robots)
_ACCESS = f"""{_LINES}, kinds AS (SELECT *, CASE WHEN key IS NULL THEN 'end' WHEN key = 'user-agent' THEN 'agent' WHEN key IN ('allow', 'disallow', 'crawl-delay', 'request-rate') THEN 'rule' END AS kind FROM lines),
told AS (SELECT *, last_value(CASE WHEN kind <> 'rule' THEN kind END IGNORE NULLS) OVER (PARTITION BY site ORDER BY line) AS scope, lag(kind, 1, 'end') OVER (PARTITION BY site ORDER BY line) AS above FROM kinds WHERE kind IS NOT NULL),
grp AS (SELECT *, sum(CASE WHEN kind = 'agent' AND above <> 'agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY line) AS g FROM told),
valid AS (SELECT * FROM grp WHERE scope = 'agent' AND kind <> 'end'),
named AS (SELECT site, g, lower(value) AS name FROM valid v WHERE kind = 'agent' AND EXISTS (SELECT 1 FROM valid r WHERE r.site = v.site AND r.g = v.g AND r.kind = 'rule')),
asked AS (SELECT site, path, unnest([{', '.join(f"'{a}'" for a in R.AI_AGENTS)}]) AS agent FROM fx_robots),
pick AS (SELECT a.*, coalesce((SELECT min(g) FROM named n WHERE n.site = a.site AND contains(lower(a.agent), n.name) AND NOT EXISTS (SELECT 1 FROM named s WHERE s.site = n.site AND s.g = n.g AND s.name = '*')), (SELECT min(g) FROM named n WHERE n.site = a.site AND n.name = '*')) AS g FROM asked a),
acc AS (SELECT p.site, p.path, p.agent, coalesce((SELECT arg_min(v.key = 'allow' OR v.value = '', {{rank}}) FROM valid v WHERE v.site = p.site AND v.g = p.g AND v.key IN ('allow', 'disallow') AND (starts_with(p.path, v.value) OR v.value = '*')), true) AS allowed FROM pick p)"""
over("ai_crawler_access", "fx_robots", f"WITH {_ACCESS.format(rank='v.line')} SELECT * FROM acc")(lambda f: R.ai_crawler_access(f, f))
_LONGEST = "(-length(v.value), NOT (v.key = 'allow' OR v.value = ''), v.line)"
over("ai_crawler_access_longest", "fx_robots", f"WITH {_ACCESS.format(rank=_LONGEST)} SELECT * FROM acc")(lambda f: R.ai_crawler_access(f, f, longest=True))
over("ai_visibility", "fx_robots", f"WITH {_ACCESS.format(rank='v.line')} SELECT a.site, a.path, r.text IS NOT NULL AS robots_found, count(*) FILTER (allowed) AS allowed_count, count(*) AS total, CASE WHEN count(*) = count(*) FILTER (allowed) THEN 'open' WHEN count(*) FILTER (allowed) = 0 THEN 'closed' ELSE 'partial' END AS verdict FROM acc a JOIN fx_robots r ON r.site = a.site GROUP BY a.site, a.path, r.text")(lambda f: R.ai_visibility(f, R.ai_crawler_access(f, f)))

# ---- sitemaps --------------------------------------------------------------------------------------------------------

_SITEMAPS = with_adapters(r"WITH locs AS (SELECT DISTINCT url, contains(lower(body), '<sitemapindex') AS is_index, unnest(regexp_extract_all(body, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1)) AS loc FROM fx_sitemaps), walk AS (SELECT concat('site', CAST(n % 7 AS VARCHAR)) AS site, url FROM fx_sitemaps WHERE n % 50 = 0 UNION SELECT w.site, l.loc FROM walk w JOIN locs l ON l.url = w.url AND l.is_index) SELECT DISTINCT site, loc FROM walk JOIN locs USING (url) WHERE NOT is_index").replace("WITH ", "WITH RECURSIVE ", 1)


@query("read_sitemap_urls", _SITEMAPS)
def _sitemaps(spark, folder):
    files = frame(spark, folder, "fx_sitemaps")
    return M.read_sitemap_urls(files.filter("n % 50 = 0").select(F.concat(F.lit("site"), F.col("n") % 7).alias("site"), "url"), files)


# ---- replies ---------------------------------------------------------------------------------------------------------

over("read_answers", "fx_replies", "SELECT scope, site, item_id, question_id, type, choice, score, noul, CASE type WHEN 'choice' THEN confidence WHEN 'score' THEN 0.5 END AS confidence, CASE type WHEN 'choice' THEN CASE WHEN choice = other THEN 0.25 ELSE confidence END END AS p, CASE type WHEN 'choice' THEN CASE WHEN choice = other THEN 1 ELSE 2 END WHEN 'score' THEN 0 END AS n FROM fx_typed WHERE item_id % 13 NOT IN (5, 6)")(
    lambda r: A.read_answers(r)[0].select("scope", "site", "item_id", "question_id", "type", "choice", "score", "noul", "confidence", F.try_element_at("probabilities", F.col("choice")).alias("p"), F.when(F.col("probabilities").isNotNull(), F.size("probabilities")).alias("n"))
)
over("read_answers_rejected", "fx_replies", "SELECT scope, question, reason, count(*) AS n FROM (SELECT scope, unnest(CASE WHEN item_id % 13 IN (5, 6) THEN [''] ELSE ['note', 'half'] END) AS question, unnest(CASE WHEN item_id % 13 IN (5, 6) THEN ['reply'] ELSE ['not an object', 'no type'] END) AS reason FROM fx_replies) x GROUP BY scope, question, reason")(
    lambda r: A.read_answers(r)[1].groupBy("scope", F.coalesce("question_id", F.lit("")).alias("question"), "reason").agg(F.count("*").alias("n"))
)

# ---- structured data -------------------------------------------------------------------------------------------------

_NODES = """walk AS (SELECT page_id, url, place, 0 AS depth, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS node FROM (SELECT *, CAST(block AS JSON) AS j FROM fx_blocks WHERE json_valid(block)) b
  UNION ALL SELECT page_id, url, place, depth + 1, unnest(json_extract(node, '$."@graph"[*]')) FROM walk WHERE depth < 4 AND json_type(node) = 'OBJECT'),
nodes AS (SELECT page_id, url, place, depth, list_filter(CASE WHEN json_type(node, '$."@type"') = 'ARRAY' THEN list_transform(list_filter(json_extract(node, '$."@type"[*]'), lambda t: json_type(t) = 'VARCHAR'), lambda t: t ->> '$') WHEN json_type(node, '$."@type"') = 'VARCHAR' THEN [node ->> '$."@type"'] ELSE [] END, lambda t: t IS NOT NULL) AS types, list_sort(json_keys(node)) AS fields FROM walk WHERE json_type(node) = 'OBJECT')"""
_NEEDED = "CASE coalesce(types[1], 'Unknown') " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in {"LocalBusiness": ["name", "@type"], "Organization": ["name", "@type"], "FAQPage": ["mainEntity"], "Article": ["headline", "author", "datePublished"], "BlogPosting": ["headline", "author", "datePublished"], "WebSite": ["name", "url"], "BreadcrumbList": ["itemListElement"], "Product": ["name", "offers"], "SoftwareApplication": ["name", "applicationCategory", "operatingSystem"]}.items()) + " ELSE [] END"
_FINDINGS = f"finds AS (SELECT *, coalesce(types[1], 'Unknown') AS type, list_filter({_NEEDED}, lambda x: NOT list_contains(fields, x)) AS missing FROM nodes)"
_OLD = "('FAQPage', 'HowTo', 'ClaimReview', 'EstimatedSalary', 'VehicleListing', 'SpecialAnnouncement')"


def _recursive(sql: str) -> str:
    return with_adapters(sql).replace("WITH ", "WITH RECURSIVE ", 1)


def _nodes(spark, folder):
    return D.json_ld_nodes(frame(spark, folder, "fx_blocks"))


query("json_ld_nodes", _recursive(f"WITH {_NODES} SELECT page_id, place, depth, array_to_string(types, '|') AS types, array_to_string(fields, ',') AS fields FROM nodes"))(lambda s, f: _nodes(s, f).select("page_id", "place", "depth", F.array_join("types", "|").alias("types"), F.array_join("fields", ",").alias("fields")))
query("schema_findings", _recursive(f"WITH {_NODES}, {_FINDINGS} SELECT page_id, place, depth, type, array_to_string(missing, ',') AS missing, len(missing) = 0 AS valid, type IN {_OLD} AS deprecated FROM finds"))(lambda s, f: D.schema_findings(_nodes(s, f)).select("page_id", "place", "depth", "type", F.array_join("missing", ",").alias("missing"), "valid", "deprecated"))
_CALLED = "list_filter([CASE WHEN contains(lower(p.url), '/faq') THEN 'FAQPage' END, CASE WHEN contains(lower(p.url), '/blog/') THEN 'BlogPosting' END, CASE WHEN contains(lower(p.url), '/contact') THEN 'ContactPage' END, CASE WHEN contains(lower(p.url), '/product') THEN 'Product' END, CASE WHEN contains(lower(p.url), '/glossary') THEN 'DefinedTermSet' END], lambda t: t IS NOT NULL AND NOT list_contains(coalesce(f.has, []), t))"
query("schema_validate", _recursive(f"WITH {_NODES}, {_FINDINGS} SELECT p.page_id, coalesce(n, 0) AS nodes, coalesce(bad, 0) AS invalid, coalesce(old, 0) AS deprecated, array_to_string({_CALLED}, ',') AS recommended, CASE WHEN coalesce(n, 0) = 0 THEN 'missing_schemas' WHEN bad = 0 THEN 'healthy' ELSE 'invalid_schemas' END AS verdict FROM (SELECT DISTINCT page_id, url FROM fx_blocks) p LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (len(missing) > 0) AS bad, count(*) FILTER (type IN {_OLD}) AS old, list(type) AS has FROM finds WHERE depth = 0 GROUP BY page_id) f ON f.page_id = p.page_id"))(
    lambda s, f: D.schema_validate(frame(s, f, "fx_blocks").select("page_id", "url").distinct(), D.schema_findings(_nodes(s, f))).select("page_id", "nodes", "invalid", "deprecated", F.array_join("recommended", ",").alias("recommended"), "verdict")
)
query("schema_type_counts", _recursive(f"WITH {_NODES} SELECT type, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(types) AS type FROM nodes) x GROUP BY type"))(lambda s, f: D.schema_type_counts(_nodes(s, f)))

# ---- language alternatives -------------------------------------------------------------------------------------------

_CODES = f"CASE WHEN lang = 'x-default' THEN [] ELSE list_filter([CASE WHEN split_part(lower(lang), '-', 1) = 'jp' THEN 'use_ja' WHEN split_part(lower(lang), '-', 1) IN ({', '.join(f'{chr(39)}{x}{chr(39)}' for x in L.LANGUAGES)}) THEN NULL WHEN length(split_part(lower(lang), '-', 1)) = 3 THEN 'three_letters' ELSE 'unknown_language' END, CASE WHEN split_part(lang, '-', 2) = '' THEN NULL WHEN NOT regexp_full_match(split_part(lower(lang), '-', 2), '[a-z][a-z]') THEN 'bad_region' WHEN split_part(lower(lang), '-', 2) = 'uk' THEN 'use_gb' END], lambda x: x IS NOT NULL) END"
_TAGS = "tags AS (SELECT *, rtrim(href, '/') AS b, rtrim(url, '/') AS a FROM fx_hreflang WHERE used), pg AS (SELECT DISTINCT url, canonical, rtrim(url, '/') AS a FROM fx_hreflang)"


def _alternates(rows):
    """Pages with their tags, from a row for each tag."""
    tags = F.sort_array(F.collect_list(F.when(F.col("used"), F.struct("k", "lang", "href"))))
    return rows.groupBy("url", "canonical").agg(tags.alias("t")).select("url", "canonical", F.transform("t", lambda t: F.struct(t["lang"].alias("lang"), t["href"].alias("href"))).alias("tags"))


over("lang_code_issues", "fx_hreflang", f"SELECT DISTINCT lang, array_to_string({_CODES}, ',') AS issues FROM fx_hreflang")(lambda r: r.select("lang", F.array_join(L.lang_code_issues(F.col("lang")), ",").alias("issues")).distinct())
over("hreflang_audit", "fx_hreflang", f"WITH {_TAGS}, per AS (SELECT pg.url, count(b) AS tags_count, coalesce(bool_or(lang = 'x-default'), false) AS has_x_default, coalesce(bool_or(b = pg.a OR b = rtrim(pg.canonical, '/') AND pg.canonical <> ''), false) AS has_self_ref, coalesce(bool_or(starts_with(href, 'http://')) AND bool_or(starts_with(href, 'https://')), false) AS mixed, coalesce(list_sort(flatten(list({_CODES}) FILTER (b IS NOT NULL))), []) AS codes FROM pg LEFT JOIN tags ON tags.url = pg.url GROUP BY pg.url) SELECT url, CAST(tags_count AS INTEGER) AS tags_count, has_x_default, has_self_ref, CASE WHEN tags_count = 0 THEN '' ELSE array_to_string(list_sort(list_concat(codes, list_filter([CASE WHEN NOT has_self_ref THEN 'no_self' END, CASE WHEN NOT has_x_default THEN 'no_x_default' END, CASE WHEN mixed THEN 'mixed_protocols' END], lambda x: x IS NOT NULL))), ',') END AS issues, CASE WHEN tags_count = 0 THEN 'no_hreflang' WHEN len(codes) = 0 AND has_self_ref AND has_x_default AND NOT mixed THEN 'valid' ELSE 'issues_found' END AS verdict FROM per")(
    lambda r: L.hreflang_audit(_alternates(r)).withColumn("issues", F.array_join(F.array_sort(F.transform("issues", lambda i: i["issue"])), ","))
)
over("missing_return_tags", "fx_hreflang", f"WITH {_TAGS} SELECT DISTINCT t.url, t.lang, t.href FROM tags t WHERE t.a <> t.b AND t.b IN (SELECT a FROM pg) AND NOT EXISTS (SELECT 1 FROM tags r WHERE r.a = t.b AND r.b = t.a)")(lambda r: L.missing_return_tags(_alternates(r)))
