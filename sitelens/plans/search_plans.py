"""Queries of the search operators over fx_search, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from ..operators import search as S
from .catalog import query
from .fixtures import frame, with_adapters

AS_OF = date(2001, 10, 26)
_END, _D28, _D90 = "DATE '2001-10-23'", "DATE '2001-09-26'", "DATE '2001-07-26'"
_CTR = "CASE WHEN sum(impressions) > 0 THEN (CAST(floor((sum(clicks) / CAST(sum(impressions) AS DOUBLE)) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) ELSE 0.0 END AS ctr"
_POS = "CASE WHEN sum(impressions) > 0 THEN (CAST(floor((sum(position * impressions) / CAST(sum(impressions) AS DOUBLE)) * 10.0 + 0.5) AS DOUBLE) / 10.0) ELSE 0.0 END AS position"
_SUMS = "CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions"


def grouped(dims: str, where: str = "search_type = 'web'", start: str = _D28) -> str:
    return f"SELECT {dims}, {_SUMS}, {_CTR}, {_POS} FROM fx_search WHERE {where} AND date BETWEEN {start} AND {_END} GROUP BY {dims}"


def ranked(inner: str, order: str, k: int) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {order}) AS rn FROM ({inner}) g) r WHERE rn <= {k}"


def _periods(dims: str, b: tuple[str, str], a: tuple[str, str]) -> str:
    parts = []
    for p, (start, end) in (("a", a), ("b", b)):
        c = f"date BETWEEN {start} AND {end}"
        parts += [f"CAST(sum(CASE WHEN {c} THEN clicks END) AS BIGINT) AS clicks_{p}", f"CAST(sum(CASE WHEN {c} THEN impressions END) AS BIGINT) AS impressions_{p}", f"sum(CASE WHEN {c} THEN position * impressions END) AS w_{p}"]
    return f"SELECT {dims}, {', '.join(parts)} FROM fx_search WHERE search_type = 'web' AND date BETWEEN {a[0]} AND {b[1]} GROUP BY {dims}"


_LAGGED = _periods("site", (_D28, _END), ("DATE '2001-08-29'", "DATE '2001-09-25'"))
_RECENT = _periods("site, query", ("DATE '2001-09-29'", "DATE '2001-10-26'"), ("DATE '2001-09-01'", "DATE '2001-09-28'"))
_RATES = f"SELECT *, CASE WHEN impressions_a > 0 THEN (CAST(floor((clicks_a / CAST(impressions_a AS DOUBLE)) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) END AS ctr_a, CASE WHEN impressions_b > 0 THEN (CAST(floor((clicks_b / CAST(impressions_b AS DOUBLE)) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) END AS ctr_b, CASE WHEN impressions_a > 0 THEN (CAST(floor((w_a / impressions_a) * 10.0 + 0.5) AS DOUBLE) / 10.0) END AS position_a, CASE WHEN impressions_b > 0 THEN (CAST(floor((w_b / impressions_b) * 10.0 + 0.5) AS DOUBLE) / 10.0) END AS position_b FROM ({_RECENT}) p"
_BENCH = "list_extract([" + ", ".join(map(str, S.BENCHMARK_CTR)) + "], greatest(1, least(15, CAST(round_even(position, 0) AS INTEGER))))"


def search_query(name: str, sql: str):
    """A query of (rows) over fx_search."""

    def keep(f):
        query(name, with_adapters(sql))(lambda spark, folder: f(frame(spark, folder, "fx_search")))
        return f

    return keep


for _dim in ("query", "page", "country", "device", "date"):
    search_query(f"search_analytics_{_dim}", ranked(grouped(f"site, {_dim}"), f"clicks DESC, {_dim}", 100))(lambda r, d=_dim: S.search_analytics(r, [d], AS_OF, row_limit=100))
search_query("page_query", ranked(grouped("site, page, query"), "clicks DESC, page, query", 1000))(lambda r: S.search_analytics(r, ["page", "query"], AS_OF))
search_query("advanced_search_analytics", ranked(grouped("site, page, device", "search_type = 'googleNews'"), "clicks DESC, page, device", 1000))(lambda r: S.search_analytics(r, ["page", "device"], AS_OF, search_type="googleNews"))
search_query("read_search_rows", "SELECT site, query, page, " + _SUMS + f", {_CTR}, {_POS} FROM fx_search GROUP BY site, query, page")(lambda r: S.measures(r, ["site", "query", "page"]))
search_query("performance_overview", f"SELECT site, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, (CAST(floor((sum(clicks) / CAST(sum(impressions) AS DOUBLE)) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS ctr, (CAST(floor((CAST(sum(CAST((CAST(floor((position * 10) * 1.0 + 0.5) AS DOUBLE) / 1.0) AS BIGINT) * impressions) AS DOUBLE) / 10.0 / sum(impressions)) * 10.0 + 0.5) AS DOUBLE) / 10.0) AS avg_position FROM ({grouped('site, query')}) q GROUP BY site")(lambda r: S.performance_overview(r, AS_OF))
search_query("compare_periods", f"SELECT site, coalesce(clicks_a, 0) AS clicks_a, coalesce(clicks_b, 0) AS clicks_b, coalesce(impressions_a, 0) AS impressions_a, coalesce(impressions_b, 0) AS impressions_b, coalesce(clicks_b, 0) - coalesce(clicks_a, 0) AS clicks_delta, coalesce(impressions_b, 0) - coalesce(impressions_a, 0) AS impressions_delta FROM ({_LAGGED}) p")(lambda r: S.compare_periods(r, AS_OF))
search_query("click_anomalies", f"SELECT site, date, clicks, (CAST(floor((z) * 100.0 + 0.5) AS DOUBLE) / 100.0) AS z_score, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS type FROM (SELECT *, (clicks - avg(clicks) OVER (PARTITION BY site)) / stddev_pop(clicks) OVER (PARTITION BY site) AS z FROM (SELECT site, date, CAST(sum(clicks) AS BIGINT) AS clicks FROM fx_search WHERE date BETWEEN {_D90} AND {_END} GROUP BY site, date) d) e WHERE abs(z) > 2.5")(lambda r: S.click_anomalies(r, AS_OF))
search_query("discover_performance", ranked(grouped("site, page", "search_type = 'discover'"), "impressions DESC, page", 50))(lambda r: S.type_performance(r, "discover", AS_OF))
search_query("news_performance", ranked(grouped("site, page", "search_type = 'googleNews'"), "impressions DESC, page", 50))(lambda r: S.type_performance(r, "googleNews", AS_OF))
search_query("search_type_breakdown", f"SELECT s.site, t.search_type, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions FROM (SELECT DISTINCT site FROM fx_search) s CROSS JOIN (SELECT unnest(['web', 'discover', 'googleNews', 'image', 'video']) AS search_type) t LEFT JOIN fx_search f ON f.site = s.site AND f.search_type = t.search_type AND f.date BETWEEN {_D28} AND {_END} GROUP BY s.site, t.search_type")(lambda r: S.search_type_breakdown(r, AS_OF))
search_query("ai_overview_rows", ranked(grouped("site, query, search_appearance"), "impressions DESC, query, search_appearance", 100))(lambda r: S.ai_overview_rows(r, AS_OF))
search_query("quick_wins", f"SELECT *, CAST(round_even(benchmark_ctr * impressions, 0) AS BIGINT) AS expected_clicks, CAST(round_even((benchmark_ctr - ctr) * impressions, 0) AS BIGINT) AS opportunity_score FROM (SELECT *, CAST({_BENCH} AS DOUBLE) AS benchmark_ctr FROM ({grouped('site, page')}) g WHERE position BETWEEN 4 AND 15 AND impressions >= 10) b WHERE ctr < benchmark_ctr")(lambda r: S.quick_wins(r, AS_OF))
search_query("traffic_drops", f"SELECT site, query, clicks_b - clicks_a AS clicks_delta, impressions_b - impressions_a AS impressions_delta, position_b AS position_current, position_a AS position_previous, CASE WHEN position_b > position_a + 2 THEN 'ranking_loss' WHEN ctr_b < ctr_a * 0.7 THEN 'ctr_collapse' ELSE 'demand_decline' END AS diagnosis FROM ({_RATES}) r WHERE clicks_b < clicks_a")(lambda r: S.traffic_drops(r, AS_OF))
search_query("striking_distance", f"SELECT * FROM ({grouped('site, query')}) g WHERE position BETWEEN 8 AND 15")(lambda r: S.striking_distance(r, AS_OF))
_HHI = f"SELECT site, query, count(*) AS pages, CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(impressions) AS BIGINT) AS total_impressions, sum(s) AS hhi, arg_max(page, (clicks, page)) AS top_page FROM (SELECT *, CASE WHEN sum(clicks) OVER w > 0 THEN pow(clicks / CAST(sum(clicks) OVER w AS DOUBLE), 2) END AS s FROM ({grouped('site, query, page')}) g WINDOW w AS (PARTITION BY site, query)) h GROUP BY site, query"
for _name, _cut in (("query_cannibalization", 0.1), ("query_cannibalization_strict", 0.5)):
    search_query(_name, f"SELECT site, query, pages, total_clicks, total_impressions, (CAST(floor((c) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS conflict_score, top_page FROM (SELECT *, 1 - coalesce(hhi, 1.0 / pages) AS c FROM ({_HHI}) i) j WHERE pages >= 2 AND total_impressions >= 50 AND c > {_cut}")(lambda r, c=_cut: S.query_cannibalization(r, AS_OF, min_conflict=c))
search_query("lost_queries", f"SELECT site, query, clicks_a AS clicks_previous, coalesce(clicks_b, 0) AS clicks_current, (CAST(floor(((clicks_a - coalesce(clicks_b, 0)) / CAST(clicks_a AS DOUBLE) * 100) * 10.0 + 0.5) AS DOUBLE) / 10.0) AS drop_pct FROM ({_RECENT}) p WHERE clicks_a >= 5 AND (clicks_a - coalesce(clicks_b, 0)) / CAST(clicks_a AS DOUBLE) >= 0.8")(lambda r: S.lost_queries(r, AS_OF))
search_query("search_alerts", f"SELECT site, page, query, type, CASE WHEN type = 'traffic_concentration' THEN 'high' ELSE 'medium' END AS severity, clicks, impressions, position FROM (SELECT *, CASE WHEN sum(clicks) OVER (PARTITION BY site) > 0 AND clicks / CAST(sum(clicks) OVER (PARTITION BY site) AS DOUBLE) > 0.5 THEN 'traffic_concentration' WHEN position > 10 AND impressions > 900 THEN 'high_impression_low_rank' END AS type FROM ({grouped('site, page, query')}) g) a WHERE type IS NOT NULL")(lambda r: S.search_alerts(r, AS_OF, impressions=900))
_A, _B = "SELECT DISTINCT site, page AS url FROM fx_search WHERE device <> 'TABLET'", "SELECT DISTINCT site, page AS url FROM fx_search WHERE date BETWEEN DATE '2001-10-17' AND DATE '2001-10-23' AND search_type = 'web'"
search_query("sitemap_audit", f"SELECT *, (CAST(floor((CASE WHEN declared > 0 THEN only_declared / CAST(declared AS DOUBLE) ELSE 0.0 END) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS missing_ratio, CASE WHEN declared = 0 THEN 'empty' WHEN only_declared / CAST(declared AS DOUBLE) > 0.2 THEN 'partial' ELSE 'healthy' END AS verdict, coalesce((SELECT string_agg(u, '|' ORDER BY u) FROM (SELECT a.url AS u FROM ({_A}) a LEFT JOIN ({_B}) b ON a.site = b.site AND a.url = b.url WHERE a.site = x.site AND b.url IS NULL ORDER BY u LIMIT 20) m), '') AS missing_sample FROM (SELECT coalesce(a.site, b.site) AS site, count(a.url) AS declared, count(b.url) AS seen, count(*) FILTER (a.url IS NOT NULL AND b.url IS NOT NULL) AS in_both, count(*) FILTER (a.url IS NOT NULL AND b.url IS NULL) AS only_declared, count(*) FILTER (a.url IS NULL) AS only_seen FROM ({_A}) a FULL JOIN ({_B}) b ON a.site = b.site AND a.url = b.url GROUP BY 1) x")(lambda r: S.sitemap_audit(r.filter("device <> 'TABLET'").select("site", r.page.alias("url")), S.window_of(r.filter("search_type = 'web'"), AS_OF, 7).select("site", r.page.alias("url"))))
