"""Queries of the page-evidence job over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.html_job import extract_pages, meta_tags, read_pages
from .catalog import query
from .fixtures import table



@query("extract_pages")
def _evidence(spark, folder):
    rows = extract_pages(table(spark, folder, "pages"))
    return rows.select("page_id", "site", "title", "description", "lang", "h1", "words", "internal_links", "external_links", "images", "alt_ratio", "link_density", "noindex", "has_viewport", "has_https", "has_schema", F.size("paragraphs").alias("paragraphs"), F.length("text").alias("text_chars"), F.length("prose").alias("prose_chars"))


_DECODED = lambda x: "trim(regexp_replace(" + "".join("replace(" for _ in range(5)) + x + "".join(f", '{a}', '{b}')" for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))) + ", '\\s+', ' ', 'g'))"


@query("title_h1_lang", f"SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links, url LIKE 'https:%' AS has_https, {_DECODED('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')} AS title, {_DECODED('regexp_extract(html, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)')} AS h1 FROM pages")
def _titles(spark, folder):
    return extract_pages(table(spark, folder, "pages")).select("page_id", "lang", (F.col("internal_links") + F.col("external_links")).alias("links"), "has_https", "title", "h1")


@query("meta_tags", f"SELECT page_id, nullif({_DECODED('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')}, '') AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def _meta(spark, folder):
    return meta_tags(extract_pages(table(spark, folder, "pages"))).select("page_id", F.regexp_replace("title", r"\s+", " ").alias("title"), F.coalesce("lang", F.lit("")).alias("lang"))


@query("page_dates")
def _dates(spark, folder):
    return extract_pages(table(spark, folder, "pages")).select("page_id", "stated_dates", "published", "modified")


@query("breadcrumbs")
def _trails(spark, folder):
    return extract_pages(table(spark, folder, "pages")).select("page_id", "breadcrumb_source", F.array_join("breadcrumbs", " > ").alias("trail"), F.length("opening").alias("opening_chars"), F.length("quality_text").alias("quality_chars"))


_H1 = _DECODED("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")


@query("heading_outline", f"SELECT page_id, 0 AS place, 1 AS level, {_H1} AS text FROM pages WHERE {_H1} <> ''")
def _outline(spark, folder):
    return extract_pages(table(spark, folder, "pages")).select("page_id", F.posexplode("headings").alias("place", "h")).select("page_id", "place", "h.level", "h.text")


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"


@query("extract_links", f"SELECT DISTINCT page_id, {_HOST} AS site, {_DECODED("regexp_extract(href, '^([^?#]*)', 1)")} AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href=\"(/[^\"]*)\"', 1)) AS href FROM pages) x")
def _links(spark, folder):
    return extract_pages(table(spark, folder, "pages")).select("page_id", "site", F.explode("internal_targets").alias("target"))


@query("read_pages", "SELECT page_id FROM pages WHERE page_id % 4 IN (0, 2)")
def _pages(spark, folder):
    kind = F.when(F.col("page_id") % 4 == 0, F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"))).when(F.col("page_id") % 4 == 1, F.create_map(F.lit("content-type"), F.lit("application/pdf"))).when(F.col("page_id") % 4 == 2, F.create_map(F.lit("content-type"), F.lit("application/xhtml+xml")))
    return read_pages(table(spark, folder, "pages").withColumn("headers", kind)).select("page_id")
