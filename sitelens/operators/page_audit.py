"""Audits of fetched pages: tags and headers, hints for the next page, and performance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths that titles and descriptions should have, and headers that a response should.
TITLE_LENGTH, DESCRIPTION_LENGTH = (30, 60), (50, 160)
SECURITY_HEADERS = ["x-frame-options", "x-content-type-options", "referrer-policy"]
#: The audits of a report that measure what a visitor waits for.
VITALS = {"fcp": "first-contentful-paint", "lcp": "largest-contentful-paint", "tbt": "total-blocking-time", "cls": "cumulative-layout-shift", "speed_index": "speed-index", "tti": "interactive"}

REPORT = (
    "lighthouseResult struct<categories:struct<performance:struct<score:double>>, "
    "audits:map<string,struct<title:string,description:string,displayValue:string,score:double,numericValue:double,details:struct<type:string>>>>"
)


def _issues(*found: tuple[Column, str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue"))) for when, severity, name in found]))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _lower_keys(headers: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), e["value"])))


def technical_audit(pages: DataFrame) -> DataFrame:
    """(page_id, url, redirected, title_length, description_length, issues, issues_count, critical_count, verdict) of fetched pages.

    Pages are (page_id, url, status, headers map, title, description, robots, canonical, viewport, lang, blocked): ``blocked``
    says whether robots.txt keeps the search crawler out, null where there is none. A missing text counts as empty, the names
    of headers don't mind case, addresses don't mind slashes at the end. A status of 400 or more is a ``fetch_error`` without issues.
    """
    n, d = F.length(F.trim(_text("title"))), F.length(_text("description"))
    header = lambda h: F.coalesce(F.try_element_at("_headers", F.lit(h)), F.lit(""))
    bare = lambda name: F.regexp_replace(_text(name), "/+$", "")
    says = lambda word: F.contains(F.lower(_text("robots")), F.lit(word))
    redirected = F.col("status").isin(301, 302, 303, 307, 308)
    found = _issues(
        (redirected, "low", "redirect"),
        (n == 0, "high", "title_missing"), ((n > 0) & (n < TITLE_LENGTH[0]), "medium", "title_short"), (n > TITLE_LENGTH[1], "low", "title_long"),
        (d == 0, "medium", "description_missing"), ((d > 0) & (d < DESCRIPTION_LENGTH[0]), "low", "description_short"), (d > DESCRIPTION_LENGTH[1], "low", "description_long"),
        (says("noindex"), "critical", "noindex"), (says("nofollow"), "medium", "nofollow"),
        (_text("canonical") == "", "medium", "canonical_missing"), ((_text("canonical") != "") & (bare("canonical") != bare("url")), "high", "canonical_differs"),
        (_text("viewport") == "", "medium", "viewport_missing"), (_text("lang") == "", "low", "lang_missing"),
        *[(header(h) == "", "low", f"no {h}") for h in SECURITY_HEADERS], (F.coalesce("blocked", F.lit(False)), "critical", "robots_blocked"),
    )
    failed = F.col("status") >= 400
    none = F.array().cast("array<struct<severity:string,issue:string>>")
    t = pages.withColumn("_headers", _lower_keys(F.col("headers")))
    t = t.select("page_id", "url", "status", redirected.alias("redirected"), n.alias("title_length"), d.alias("description_length"), F.when(failed, none).otherwise(found).alias("issues"))
    verdict = F.when(failed, "fetch_error").when(F.size("issues") > 0, "issues_found").otherwise("healthy")
    return t.select("page_id", "url", "redirected", "title_length", "description_length", "issues", F.size("issues").alias("issues_count"), F.size(F.filter("issues", lambda i: i["severity"] == "critical")).alias("critical_count"), verdict.alias("verdict"))


_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']{}[\"'][^>]*>"


def preload_audit(pages: DataFrame) -> DataFrame:
    """(page_id, url, in_html, in_header, actions, preloads, prerender_link, no_store, issues, verdict) of pages (page_id, url, status, headers map, html).

    ``actions`` are what the rule blocks of the page ask for as lists, of prefetch and prerender; a block that is no JSON asks
    for nothing. ``preloads`` are structs (as, href, fetchpriority). ``optimised`` with both actions and a page that may be
    kept for going back, ``not_implemented`` without any rules.
    """
    html = _text("html")
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*\btype\s*=\s*[\"']speculationrules[\"'][^>]*>(.*?)</script>"), F.lit(1))
    asks = lambda kind: F.exists("_blocks", lambda b: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.trim(b)), f"$.{kind}", "variant")).startswith("ARRAY"), F.lit(False)))
    attribute = lambda tag, name: F.when(tag.rlike(rf"(?i)\b{name}\s*=\s*[\"'][^\"']*[\"']"), F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    tags = F.transform(F.regexp_extract_all(html, F.lit(_TAG.format("preload")), F.lit(0)), lambda t: F.struct(attribute(t, "as").alias("as"), attribute(t, "href").alias("href"), attribute(t, "fetchpriority").alias("fetchpriority")))
    t = pages.withColumns({"_blocks": blocks, "_headers": _lower_keys(F.col("headers"))})
    t = t.select(
        "page_id", "url", "status", (F.size("_blocks") > 0).alias("in_html"), F.map_contains_key("_headers", "speculation-rules").alias("in_header"),
        F.array_compact(F.array(*[F.when(asks(k), k) for k in ("prefetch", "prerender")])).alias("actions"), tags.alias("preloads"), html.rlike(_TAG.format("prerender")).alias("prerender_link"),
        F.contains(F.lower(F.coalesce(F.try_element_at("_headers", F.lit("cache-control")), F.lit(""))), F.lit("no-store")).alias("no_store"),
    )
    rules = F.col("in_html") | F.col("in_header")
    lacks = lambda kind: rules & ~F.array_contains("actions", kind)
    image = F.filter("preloads", lambda p: F.coalesce(p["as"] == "image", F.lit(False)))
    slow = (F.size(image) > 0) & ~F.exists(image, lambda p: F.coalesce(p["fetchpriority"] == "high", F.lit(False)))
    found = _issues((~rules, "high", "no_rules"), (lacks("prefetch"), "medium", "no_prefetch"), (lacks("prerender"), "medium", "no_prerender"), (F.col("no_store"), "high", "no_store"), (F.col("prerender_link"), "medium", "prerender_link"), (slow, "medium", "image_without_priority"))
    failed = F.col("status") >= 400
    verdict = F.when(failed, "fetch_error").when(~rules, "not_implemented").when((F.size("actions") == 2) & ~F.col("no_store"), "optimised").otherwise("improvements_available")
    return t.withColumns({"issues": F.when(failed, F.array().cast("array<struct<severity:string,issue:string>>")).otherwise(found), "verdict": verdict}).drop("status")


def pagespeed_verdict(reports: DataFrame, most: int = 3, bar: float = 0.9) -> DataFrame:
    """(page_id, performance, a number for each vital, opportunities, verdict) of performance reports (page_id, report as JSON text).

    ``performance`` is the score in hundredths, rounded half to even. ``opportunities`` are the ids of up to ``most`` audits of
    that kind with a score under ``bar``, the lowest first, then by id; one without a score is passed over. A report that
    doesn't parse or has no score is a ``fetch_error``.
    """
    r = reports.select("page_id", F.from_json("report", REPORT).alias("r")).select("page_id", F.col("r.lighthouseResult.categories.performance.score").alias("score"), F.col("r.lighthouseResult.audits").alias("audits"))
    p = F.bround(F.col("score") * 100).cast("int")
    low = F.filter(F.map_entries("audits"), lambda e: F.coalesce((e["value"]["details"]["type"] == "opportunity") & (e["value"]["score"] < bar), F.lit(False)))
    ids = F.transform(F.slice(F.array_sort(F.transform(low, lambda e: F.struct(e["value"]["score"].alias("score"), e["key"].alias("id")))), 1, most), lambda x: x["id"])
    vital = [F.try_element_at("audits", F.lit(a))["numericValue"].alias(name) for name, a in VITALS.items()]
    verdict = F.when(p.isNull(), "fetch_error").when(p >= 90, "good").when(p >= 50, "needs_improvement").otherwise("poor")
    return r.select("page_id", p.alias("performance"), *vital, F.coalesce(ids, F.array().cast("array<string>")).alias("opportunities"), verdict.alias("verdict"))
