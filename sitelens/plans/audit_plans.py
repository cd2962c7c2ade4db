"""Queries of rules, link graph, judgements, history and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bands import SEVERITY_WEIGHT
from ..functions.numbers import half_up_sql as h
from ..functions.text import FILLER_PHRASES
from ..operators import audit as A
from ..operators import digest as D
from ..operators import graph as G
from ..operators import rules as R
from .catalog import query
from .fixtures import frame, table, with_adapters


def over(name: str, adapter: str, sql: str):
    def keep(f):
        query(name, with_adapters(sql))(lambda spark, folder: f(frame(spark, folder, adapter)))
        return f

    return keep


# ---- rules -----------------------------------------------------------------------------------------------------------

_HITS = "\nUNION ALL ".join(f"SELECT site, '{i}' AS rule_id, '{s}' AS severity, path FROM fx_evidence WHERE {w}" for i, s, w in R._RULES)
_DUPES = "SELECT site, path, lower(trim(title)) AS title_key, count(*) OVER (PARTITION BY site, lower(trim(title))) AS n FROM fx_evidence WHERE title <> ''"
_HITS = f"hits AS ({_HITS} UNION ALL SELECT site, 'dupe-titles', 'serious', path FROM ({_DUPES}) d WHERE n > 1 UNION ALL SELECT site, 'no-schema', 'moderate', path FROM fx_evidence WHERE site IN (SELECT site FROM fx_evidence GROUP BY site HAVING NOT bool_or(has_schema)))"
_FIND = "find AS (SELECT site, rule_id, severity, count(*) AS hits, array_to_string(list_sort(list(path) FILTER (r <= 12)), ',') AS paths FROM (SELECT *, row_number() OVER (PARTITION BY site, rule_id ORDER BY path) AS r FROM hits) x GROUP BY site, rule_id, severity)"
_STATS = f"stats AS (SELECT site, count(*) AS pages, CAST({h('sum(words) / CAST(count(*) AS DOUBLE)')} AS BIGINT) AS avg_words, count(*) FILTER (has_schema) AS with_schema, count(*) FILTER (description <> '') AS with_description, count(*) FILTER (h1 <> '') AS with_h1, bool_or(has_https) AS https, count(*) FILTER (title <> '' AND length(title) <= 60) AS title_length_ok, count(*) FILTER (description <> '' AND length(description) <= 160) AS description_length_ok FROM fx_evidence GROUP BY site)"
_POINTS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_WEIGHT.items()) + " END"
over("rule_findings", "fx_evidence", f"WITH {_HITS}, {_FIND} SELECT * FROM find")(lambda p: R.rule_findings(R.rule_hits(p)))
over("duplicate_titles", "fx_evidence", f"SELECT * FROM ({_DUPES}) d WHERE n > 1")(R.duplicate_titles)
over("rule_stats", "fx_evidence", f"WITH {_STATS} SELECT * FROM stats")(R.rule_stats)
over("rule_only_score", "fx_evidence", f"WITH {_HITS}, {_FIND}, {_STATS} SELECT s.site, CAST({h('greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), 80 - coalesce(load, 0) + (CAST(with_schema AS DOUBLE) / pages * 10 + CAST(with_description AS DOUBLE) / pages * 8 + CAST(with_h1 AS DOUBLE) / pages * 8 + CASE WHEN https THEN 8 ELSE 0 END)))')} AS INTEGER) AS score FROM stats s LEFT JOIN (SELECT site, sum({_POINTS}) AS load FROM find GROUP BY site) l ON l.site = s.site")(lambda p: R.rule_only_score(R.rule_findings(R.rule_hits(p)), R.rule_stats(p)))
_PER = "per AS (SELECT p.site, p.path, count(DISTINCT rule_id) AS findings FROM (SELECT DISTINCT site, path FROM fx_evidence) p LEFT JOIN hits USING (site, path) GROUP BY p.site, p.path)"
over("rule_count_per_page", "fx_evidence", f"WITH {_HITS}, {_PER} SELECT * FROM per")(lambda p: R.rule_count_per_page(p, R.rule_hits(p)))
over("crawl_totals", "fx_evidence", f"WITH {_HITS}, {_PER} SELECT e.site, CAST(sum(words) AS BIGINT) AS words, CAST(sum(findings) AS BIGINT) AS findings, count(*) FILTER (words < 200) AS thin FROM fx_evidence e JOIN per USING (site, path) GROUP BY e.site")(lambda p: R.crawl_totals(p, R.rule_count_per_page(p, R.rule_hits(p))))
_KIND, _AUTHOR = "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Article' ELSE concat('Type', CAST(page_id % 17 AS VARCHAR)) END", "CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('author ', CAST(page_id % 11 AS VARCHAR)) END"


def _named(p):
    text = lambda x: F.expr(x.replace("VARCHAR", "STRING"))
    p = p.withColumns({"schema_types": F.array(text(_KIND)), "authors": F.filter(F.array(text(_AUTHOR)), lambda x: x != ""), "external_hosts": F.array(F.concat(F.lit("x"), F.col("page_id") % 7)), "text": F.concat(F.lit("in "), F.col("page_id") % 4000, F.lit(" and on"))})
    return p


_LISTED = lambda x, n: f"array_to_string(list_slice(list_sort(list(DISTINCT {x}) FILTER ({x} <> '')), 1, {n}), '|')"
over("entity_block", "fx_evidence", f"SELECT site, coalesce({_LISTED(_KIND, 12)}, '') AS schema_types, coalesce({_LISTED(_AUTHOR, 8)}, '') AS named_authors, coalesce({_LISTED('lang', 99)}, '') AS languages, count(*) FILTER (has_schema) AS pages_with_schema, count(*) FILTER (h1 <> '') AS pages_with_h1, bool_or(has_https) AS https FROM fx_evidence GROUP BY site")(lambda p: R.entity_facts(_named(p)))
over("proof_block", "fx_evidence", f"SELECT site, count(*) AS pages, count(*) FILTER ({_AUTHOR} <> '') AS with_author, count(*) FILTER (page_id % 4000 BETWEEN 1900 AND 2099) AS with_date, count(*) FILTER (has_schema) AS with_schema, CAST({h('sum(words) / CAST(count(*) AS DOUBLE)')} AS BIGINT) AS avg_words, count(DISTINCT page_id % 7) AS external_sources, count(*) FILTER (page_id % 6 = 0) AS orphans, count(*) FILTER (page_id % 10 = 1) AS dead_ends FROM fx_evidence GROUP BY site")(lambda p: R.proof_block(_named(p), p.select("site", (F.col("page_id") % 6 == 0).alias("orphan"), (F.col("page_id") % 10 == 1).alias("dead_end"))))
_CATEGORY = "CASE WHEN page_id % 3 = 0 THEN 'indexed' WHEN page_id % 7 = 1 THEN 'robots_blocked' WHEN page_id % 11 = 2 THEN 'fetch_error' WHEN page_id % 5 = 1 AND page_id % 13 <> 4 THEN 'canonical_issue' WHEN page_id % 6 = 1 THEN 'unknown' WHEN page_id % 6 = 2 THEN 'discovered_not_indexed' WHEN page_id % 6 = 4 THEN 'crawled_not_indexed' WHEN page_id % 6 = 5 AND page_id % 4 = 1 THEN 'duplicate' WHEN page_id % 6 = 5 AND page_id % 4 = 3 THEN 'excluded' ELSE 'not_indexed' END"


def _inspected(p):
    i = F.col("page_id")
    coverage = F.when(i % 6 == 1, "URL is unknown to Google").when(i % 6 == 2, "Discovered - currently not indexed").when(i % 6 == 4, "Crawled - currently not indexed").when((i % 6 == 5) & (i % 4 == 1), "Duplicate, Google chose another").when((i % 6 == 5) & (i % 4 == 3), "Excluded by noindex tag").otherwise("")
    fields = {"verdict": F.when(i % 3 == 0, "PASS").otherwise("NEUTRAL"), "robots": F.when(i % 7 == 1, "BLOCKED_BY_ROBOTS_TXT").otherwise("ALLOWED"), "fetch": F.when(i % 11 == 2, "SOFT_404").otherwise("SUCCESSFUL"), "coverage": coverage, "google": F.col("url"), "user": F.when((i % 5 == 1) & (i % 13 != 4), F.concat("url", F.lit("?x"))).otherwise(F.col("url"))}
    return p.select("site", "page_id", R.inspection_category(fields).alias("category"))


over("inspection_category", "fx_pages", f"SELECT site, page_id, {_CATEGORY} AS category FROM fx_pages")(_inspected)
over("indexing_summary", "fx_pages", f"SELECT s.site, c.category, count(p.page_id) AS n FROM (SELECT DISTINCT site FROM fx_pages) s CROSS JOIN (SELECT unnest([{', '.join(repr(c) for c in R.CATEGORIES)}]) AS category) c LEFT JOIN (SELECT site, page_id, {_CATEGORY} AS category FROM fx_pages) p ON p.site = s.site AND p.category = c.category GROUP BY s.site, c.category")(lambda p: R.indexing_summary(_inspected(p)))
_FILLER = " + ".join(f"CAST(contains(lower(text), '{x.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for x in FILLER_PHRASES)
#: There, a word boundary knows ASCII letters only; accented ones are made word characters for it.
_PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g')"
_QUALITY = f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''\\-]*'), lambda t: lower(t)) AS w FROM documents),
b AS (SELECT *, len(w) AS n, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS p FROM a),
c AS (SELECT *, len(list_distinct(p)) AS kinds, (SELECT count(*) FROM (SELECT x FROM unnest(p) u(x) GROUP BY x HAVING count(*) > 1)) AS again, {_FILLER} AS hits,
  len(regexp_extract_all({_PLAIN}, '\\b[0-9]+(?:[.,][0-9]+)?(?:%|st|nd|rd|th)?\\b')) + len(regexp_extract_all({_PLAIN}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')) AS facts FROM b),
d AS (SELECT *, {h('least(1.0, facts * CAST(10.0 AS DOUBLE) / greatest(1, n))', 3)} AS density, CAST(round_even(again * CAST(100.0 AS DOUBLE) / greatest(1, kinds), 0) AS INTEGER) AS repetition, least(100, CAST(round_even(hits * CAST(25.0 AS DOUBLE) / greatest(1.0, n / CAST(1000.0 AS DOUBLE)), 0) AS INTEGER)) AS filler FROM c),
e AS (SELECT *, CAST({h('(100 - filler) * CAST(0.35 AS DOUBLE) + density * CAST(35.0 AS DOUBLE) + (100 - repetition) * CAST(0.2 AS DOUBLE) + least(CAST(100.0 AS DOUBLE), n / CAST(10.0 AS DOUBLE)) * CAST(0.1 AS DOUBLE)')} AS INTEGER) AS overall FROM d)
SELECT doc_id, CAST(n AS INTEGER) AS word_count, CAST(len(list_distinct(w)) AS INTEGER) AS unique_tokens, filler, density, repetition, overall, array_to_string(list_filter([CASE WHEN filler >= 50 THEN 'filler' END, CASE WHEN density < 0.2 THEN 'low-density' END, CASE WHEN repetition >= 30 THEN 'repetitive' END, CASE WHEN n < 300 THEN 'thin-content' END], lambda x: x IS NOT NULL), ',') AS flags, CASE WHEN n < 300 THEN 'thin_content' WHEN overall >= 60 THEN 'good' ELSE 'needs_work' END AS verdict FROM e"""
query("content_quality", _QUALITY)(lambda s, f: R.content_quality(table(s, f, "documents")))

# ---- link graph ------------------------------------------------------------------------------------------------------

_NODES = "nodes AS (SELECT DISTINCT path FROM (SELECT src AS path FROM fx_links UNION ALL SELECT '/n/0') n)"
_EDGES = "edges AS (SELECT DISTINCT src, dst FROM fx_links WHERE src <> dst AND src IN (SELECT path FROM nodes) AND dst IN (SELECT path FROM nodes))"
_DEG = "deg AS (SELECT n.path, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound, coalesce(i.p, '') AS inbound_paths FROM nodes n LEFT JOIN (SELECT dst, count(*) AS n, array_to_string(list_slice(list_sort(list(src)), 1, 25), ',') AS p FROM edges GROUP BY dst) i ON i.dst = n.path LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = n.path)"
_HOPS = "walk AS (SELECT '/n/0' AS path, 0 AS hops UNION SELECT e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.path WHERE w.hops < 40), hop AS (SELECT n.path, coalesce(min(w.hops), -1) AS hops FROM nodes n LEFT JOIN walk w ON w.path = n.path GROUP BY n.path)"


def _graph(links):
    links = links.select(F.lit("net").alias("site"), "src", "dst")
    nodes = links.select("site", F.col("src").alias("path")).union(links.select("site", F.lit("/n/0")).limit(1)).distinct()
    return links, nodes, G.link_edges(links, nodes)


def _with_recursive(sql: str) -> str:
    return with_adapters(sql).replace("WITH ", "WITH RECURSIVE ", 1)


def graph_query(name: str, sql: str):
    def keep(f):
        query(name, _with_recursive(f"WITH {_NODES}, {_EDGES}, {_DEG}, {_HOPS} {sql}"))(lambda spark, folder: f(*_graph(frame(spark, folder, "fx_links")), spark))
        return f

    return keep


def _hops(e, n, spark):
    from ..session import ensure_checkpoint

    ensure_checkpoint(spark)
    return G.hops_from_home(e, n, "/n/0")


graph_query("link_edges", "SELECT 'net' AS site, src, dst FROM edges")(lambda l, n, e, s: e)
graph_query("link_degrees", "SELECT 'net' AS site, * FROM deg")(lambda l, n, e, s: G.link_degrees(e, n))
graph_query("inbound_share_rank", f"SELECT 'net' AS site, path, inbound, {h('inbound / CAST(sum(inbound) OVER () AS DOUBLE)', 4)} AS inbound_share, CAST(row_number() OVER (ORDER BY inbound DESC, path) - 1 AS INTEGER) AS inbound_rank FROM deg")(lambda l, n, e, s: G.inbound_share_rank(G.link_degrees(e, n)))
graph_query("orphans_dead_ends", "SELECT 'net' AS site, path, inbound = 0 AS orphan, outbound = 0 AS dead_end FROM deg WHERE path <> '/n/0' AND (inbound = 0 OR outbound = 0)")(lambda l, n, e, s: G.orphans_dead_ends(G.link_degrees(e, n), "/n/0"))
graph_query("hops_from_home", "SELECT 'net' AS site, path, hops FROM hop")(lambda l, n, e, s: _hops(e, n, s))
graph_query("graph_summary", f"SELECT 'net' AS site, count(*) AS pages, {h('sum(inbound) / CAST(count(*) AS DOUBLE)', 2)} AS avg_in_degree, max(inbound) AS max_in_degree, (SELECT count(*) FROM hop WHERE hops >= 0) AS reachable, {h('least(1.0, count(*) / CAST((SELECT count(DISTINCT dst) FROM fx_links) AS DOUBLE))', 3)} AS coverage FROM deg")(lambda l, n, e, s: G.graph_summary(G.link_degrees(e, n), _hops(e, n, s), l.select("site", F.col("dst").alias("path"))))
graph_query("stamp_positions", "SELECT 'net' AS site, d.path, inbound, outbound, hops FROM deg d JOIN hop USING (path)")(lambda l, n, e, s: G.stamp_positions(n, G.link_degrees(e, n), _hops(e, n, s)))
graph_query("discovered_not_crawled", "SELECT DISTINCT 'net' AS site, dst AS path FROM fx_links WHERE dst NOT IN (SELECT path FROM nodes)")(lambda l, n, e, s: G.discovered_not_crawled(l.select("site", F.col("dst").alias("path")), n))
_ALLOWED = "NOT starts_with({0}, '/n/1') AND NOT starts_with({0}, '/n/27')"


def _robots(spark):
    return spark.createDataFrame([("net", "/n/1"), ("net", "/n/27"), ("net", "/"), ("net", "")], "site string, prefix string")


graph_query("robots_filter", f"SELECT 'net' AS site, path FROM nodes WHERE {_ALLOWED.format('path')}")(lambda l, n, e, s: G.robots_filter(n, _robots(s)))
graph_query("crawl_frontier", f"SELECT DISTINCT 'net' AS site, dst AS path FROM (SELECT *, dense_rank() OVER (ORDER BY dst) AS r FROM fx_links WHERE src IN (SELECT path FROM hop WHERE hops BETWEEN 0 AND 2) AND dst NOT IN (SELECT path FROM hop WHERE hops BETWEEN 0 AND 2) AND {_ALLOWED.format('dst')}) x WHERE r <= 40")(lambda l, n, e, s: (lambda seen: G.crawl_frontier(l, seen, seen, _robots(s)))(_hops(e, n, s).filter("hops between 0 and 2").select("site", "path")))

# ---- answers ---------------------------------------------------------------------------------------------------------

_D = lambda x: f"CAST({x} AS DOUBLE)"
_JUDGED = "jud AS (SELECT site, item_id, coalesce(max(CASE WHEN question_id = 'importance' THEN p END), 0.5) AS importance FROM fx_answers GROUP BY site, item_id)"


def _weighed(a):
    return a.groupBy("site", "item_id").agg(F.coalesce(F.max(F.when(F.col("question_id") == "importance", F.col("p"))), F.lit(0.5)).alias("importance"))


_W = "(0.35 + importance)"
over("site_score", "fx_answers", f"WITH {_JUDGED}, fin AS (SELECT site, item_id, sum(CASE WHEN p < 0.1 THEN 9 ELSE 4 END) AS load FROM fx_answers WHERE p < 0.3 GROUP BY site, item_id) SELECT site, CAST({h(f'''greatest(0.0, least(100.0, sum({h(f'(CAST(0.35 AS DOUBLE) + importance) * greatest(0.0, 1 - coalesce(load, 0) / CAST(100.0 AS DOUBLE))', 9)}) / sum({h('CAST(0.35 AS DOUBLE) + importance', 9)}) * 100 - 7))''')} AS INTEGER) AS score FROM jud LEFT JOIN fin USING (site, item_id) GROUP BY site")(lambda a: A.site_score(_weighed(a), a.filter("p < 0.3").select("site", "item_id", F.when(F.col("p") < 0.1, 9).otherwise(4).alias("points")), a.select("site").distinct().withColumn("penalty", F.lit(7))))
over("ledger_totals", "fx_events", f"SELECT run_id AS site, count(*) AS calls, CAST(sum(CAST(floor(cost * 10) AS BIGINT)) AS BIGINT) AS tokens, {h('CAST(sum(CAST(cost AS DECIMAL(18,8))) AS DOUBLE)', 6)} AS cost, CAST({h('(max(CASE WHEN r = (n - 1) // 2 THEN ms END) + max(CASE WHEN r = n // 2 THEN ms END)) / CAST(2 AS DOUBLE)')} AS BIGINT) AS median_ms, max(CASE WHEN r = least(n - 1, CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT)) THEN ms END) AS p95_ms FROM (SELECT *, CAST(floor(cost) AS BIGINT) AS ms, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY CAST(floor(cost) AS BIGINT)) - 1 AS r FROM fx_events) x GROUP BY run_id")(lambda e: A.ledger_totals(e.select(F.col("run_id").alias("site"), F.floor(F.col("cost") * 10).cast("long").alias("tokens"), "cost", F.floor("cost").cast("long").alias("ms"))))

# ---- history ---------------------------------------------------------------------------------------------------------

_STATE = """sta AS (SELECT coalesce(c.root, p.root) AS root, coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN CASE WHEN p.raised THEN 'not_comparable' ELSE 'unreachable_before' END
  WHEN p.path IS NULL THEN CASE WHEN c.raised THEN 'newly_raised' ELSE 'clean' END WHEN c.raised AND NOT p.reachable THEN 'newly_raised' WHEN p.raised AND NOT c.reachable THEN 'not_comparable'
  WHEN NOT c.reachable OR NOT p.reachable THEN 'unreachable_before' WHEN NOT c.raised THEN CASE WHEN p.raised THEN 'not_longer_raised' ELSE 'clean' END
  WHEN NOT p.raised OR c.band_rank > p.band_rank THEN 'regressed' WHEN c.change_key IS DISTINCT FROM p.change_key THEN 'changed' ELSE 'still_open' END AS state
  FROM (SELECT * FROM fx_runs WHERE run_no = 2) c FULL JOIN (SELECT * FROM fx_runs WHERE run_no = 1) p ON c.root = p.root AND c.path = p.path)"""
_both = lambda r: A.diff_runs(r.filter("run_no = 2"), r.filter("run_no = 1"))
over("diff_runs", "fx_runs", f"WITH {_STATE} SELECT * FROM sta")(_both)
over("delta_summary", "fx_runs", f"WITH {_STATE} SELECT root, count(*) AS pages, count(*) FILTER (state IN ('regressed', 'changed', 'still_open', 'not_longer_raised', 'clean')) AS comparable, count(*) FILTER (state = 'clean') AS clean, count(*) FILTER (state IN ('unreachable_before', 'not_comparable')) AS unreachable, count(*) FILTER (state IN ('not_longer_raised', 'newly_raised', 'regressed')) AS moved FROM sta GROUP BY root")(lambda r: A.delta_summary(_both(r)))
over("moved_counts", "fx_runs", f"WITH {_STATE} SELECT root, state, count(*) AS n FROM sta GROUP BY root, state")(lambda r: _both(r).groupBy("root", "state").agg(F.count("*").alias("n")))
over("latest_pair", "fx_runs", "SELECT root, max(run_no) AS current, CASE WHEN count(DISTINCT run_no) > 1 THEN min(run_no) END AS previous FROM fx_runs GROUP BY root")(A.latest_pair)
over("read_history", "fx_runs", "SELECT root, run_no, path FROM fx_runs WHERE (root, run_no) IN (SELECT (root, max(run_no)) FROM fx_runs GROUP BY root)")(lambda r: A.keep_newest(r, 1).select("root", "run_no", "path"))

# ---- events ----------------------------------------------------------------------------------------------------------

_N = lambda t: f"count(*) FILTER (type = '{t}')"
over("live_counters", "fx_events", f"SELECT run_id, {_N('page-done')} AS pages, {_N('keyword-done')} AS keywords, {_N('gap-done')} AS gaps, {_N('error')} AS errors, CAST(sum(CAST(cost AS DECIMAL(18,8))) AS DOUBLE) AS cost FROM fx_events GROUP BY run_id")(A.live_counters)
over("latest_by_key", "fx_events", "SELECT run_id, item_key, arg_max(type, seq) AS type, max(seq) AS seq FROM fx_events GROUP BY run_id, item_key")(A.latest_by_key)
over("pending_items", "fx_events", "SELECT DISTINCT run_id, item_key FROM fx_events s WHERE type = 'page-start' AND NOT EXISTS (SELECT 1 FROM fx_events d WHERE d.type = 'page-done' AND d.run_id = s.run_id AND d.item_key = s.item_key)")(A.pending_items)
over("rival_slots", "fx_events", "SELECT run_id, item_key, min(CASE WHEN type = 'page-start' THEN seq END) AS started, min(CASE WHEN type = 'page-done' THEN seq END) AS done FROM fx_events WHERE type IN ('page-start', 'page-done') GROUP BY run_id, item_key")(A.slots)
_HEADS = "heads AS (SELECT DISTINCT root, run_no, CAST(length(root) * 3 + run_no * 5 AS INTEGER) AS score, CASE WHEN run_no = 1 OR length(root) % 2 = 0 THEN 'm1' ELSE 'm2' END AS model FROM fx_runs)"


def _heads(r, k):
    return r.filter(F.col("run_no") == k).select("root", (F.length("root") * 3 + 5 * k).cast("int").alias("score"), F.when((F.lit(k) == 1) | (F.length("root") % 2 == 0), "m1").otherwise("m2").alias("model")).distinct()


over("score_delta", "fx_runs", f"WITH {_HEADS} SELECT c.root, CASE WHEN c.model = p.model THEN c.score - p.score END AS score_delta FROM heads c LEFT JOIN heads p ON p.root = c.root AND p.run_no = 1 WHERE c.run_no = 2")(lambda r: A.score_delta(_heads(r, 2), _heads(r, 1)))
over("recent_problems", "fx_events", "SELECT run_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM fx_events WHERE type = 'error') x WHERE r <= 12")(A.recent_problems)
over("crawl_rows", "fx_evidence", "SELECT coalesce(b.site, a.site) AS site, coalesce(b.path, a.path) AS path, coalesce(b.words, a.words) AS words, coalesce(b.title, a.title) AS title FROM (SELECT site, concat(path, page_id) AS path, words, title FROM fx_evidence WHERE page_id % 3 <> 0) a FULL JOIN (SELECT site, concat(path, page_id) AS path, words + 1 AS words, concat(title, '!') AS title FROM fx_evidence WHERE page_id % 4 <> 0) b ON a.site = b.site AND a.path = b.path")(lambda p: (lambda q: A.crawl_rows(q.filter("page_id % 3 <> 0"), q.filter("page_id % 4 <> 0").withColumns({"words": F.col("words") + 1, "title": F.concat("title", F.lit("!"))})))(p.withColumn("path", F.concat("path", "page_id"))))
_LINE = "CASE CAST(seq % 4 AS INT) WHEN 0 THEN concat('— ', type, ' completed') WHEN 1 THEN concat('— ', type, ' running') WHEN 2 THEN concat('— note about ', type) ELSE concat('▶ ', type) END"
_TOOL = "'^— \\S+ (completed|running|pending|error)$'"
over("log_counters", "fx_events", f"SELECT run_id, count(*) FILTER (regexp_matches(t, '^— \\S+ (completed|error|pending)')) AS searches, count(*) FILTER (regexp_matches(t, {_TOOL})) AS tools, count(*) FILTER (starts_with(t, '— ') AND NOT regexp_matches(t, {_TOOL})) AS messages FROM (SELECT run_id, {_LINE} AS t FROM fx_events) x GROUP BY run_id")(lambda e: A.log_counters(e.select("run_id", F.expr(_LINE).alias("text"))))
over("stage_of_run", "fx_events", "SELECT run_id, arg_max(CASE WHEN starts_with(type, 'crawl') THEN 'crawl' WHEN starts_with(type, 'keyword') THEN 'keywords' WHEN starts_with(type, 'competitor') THEN 'rivals' ELSE 'site' END, seq) AS stage FROM fx_events WHERE type <> 'error' GROUP BY run_id")(A.stage_of_run)
over("recent_log", "fx_events", "SELECT run_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM fx_events) x WHERE r <= 200")(A.recent_log)
over("event_windows", "fx_events", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start, type, count(*) AS n FROM fx_events GROUP BY 1, 2")(A.event_windows)
over("session_counters", "fx_events", "SELECT run_id, session, count(*) AS n, count(*) FILTER (type = 'error') AS errors FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, seq) AS BIGINT) AS session FROM (SELECT *, CASE WHEN CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY ts, seq) <= 21600 THEN 0 ELSE 1 END AS fresh FROM fx_events) a) b GROUP BY run_id, session")(A.sessions)

# ---- digest ----------------------------------------------------------------------------------------------------------

_CLIP = lambda x, n: f"CASE WHEN length({x}) > {n} THEN concat(substring({x}, 1, {n - 1}), '…') WHEN {x} = '' THEN '(none)' ELSE {x} END"
_FLAT = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_LINE_SQL = f"""concat('- path=', CASE WHEN path = '' THEN '/' ELSE path END, ' | status=200 | words=', words, ' | title=', {_CLIP(_FLAT('title'), 90)}, ' | h1=', {_CLIP(_FLAT('h1'), 70)}, ' | description=', {_CLIP(_FLAT('description'), 110)}, ' | internal_links=', page_id % 9, ' | external_links=1 | images=3 | images_missing_alt=', page_id % 3,
 ' | structured_data=', CASE WHEN has_schema THEN 'A,B,C,D' ELSE 'none' END, ' | noindex=', CASE WHEN noindex THEN 'yes' ELSE 'no' END, ' | lang=', CASE WHEN lang = '' THEN '(none)' ELSE lang END, CASE WHEN page_id % 2 = 0 THEN ' | opening="say \\"hi\\""' ELSE '' END)"""


def _digested(pages):
    some = F.when(F.col("has_schema"), F.array(*map(F.lit, "ABCDE"))).otherwise(F.array().cast("array<string>"))
    full = pages.withColumns({"status": F.lit(200), "internal_links": F.col("page_id") % 9, "external_links": F.lit(1), "images": F.lit(3), "images_missing_alt": F.col("page_id") % 3, "schema_types": some, "opening": F.when(F.col("page_id") % 2 == 0, ' say  "hi" ')})
    terms = pages.select("site", F.concat(F.lit("t"), "page_id").alias("term"), F.col("page_id").alias("page_count"), (F.col("page_id") % 4).alias("in_headings"), (F.col("page_id") % 2 == 0).alias("question"), (F.col("page_id") % 50).alias("weight"))
    return D.crawl_digest(full, R.rule_stats(pages), terms)


over("crawl_digest", "fx_evidence", f"""WITH {_STATS} SELECT site, 'page' AS part, CAST(row_number() OVER (PARTITION BY site ORDER BY path, line) - 1 AS INTEGER) AS place, line FROM (SELECT site, path, {_LINE_SQL} AS line FROM fx_evidence) a
UNION ALL SELECT site, 'counts', 0, concat(pages, ' pages, ', avg_words, ' words a page, ', with_h1, ' with an H1, ', with_description, ' described, ', with_schema, ' with structured data, titles right ', title_length_ok, ', descriptions right ', description_length_ok, ', https=', https) FROM stats
UNION ALL SELECT site, 'term', CAST(r - 1 AS INTEGER), concat('- t', page_id, ' (pages ', page_id, ', in headings ', page_id % 4, ', question ', page_id % 2 = 0, ')') FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id % 50 DESC, concat('t', page_id)) AS r FROM fx_evidence) b WHERE r <= 25""")(_digested)
