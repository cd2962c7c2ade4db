"""What a crawl found, as lines of text that a reader can go through: a line a page, the counts, the mined terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clip


def _or_none(name: str, size: int | None = None) -> Column:
    text = F.coalesce(F.col(name), F.lit(""))
    text = text if size is None else clip(text, size)
    return F.when(text == "", "(none)").otherwise(text)


def page_lines(pages: DataFrame) -> DataFrame:
    """(site, path, line) of pages with their evidence: field by field, long texts clipped, what is missing said so."""
    part = lambda name, value: F.concat(F.lit(f"{name}="), value)
    types = F.when(F.size("schema_types") > 0, F.array_join(F.slice("schema_types", 1, 4), ",")).otherwise("none")
    opening = clip(F.coalesce("opening", F.lit("")), 220)
    quoted = F.to_json(F.array(opening))
    parts = [
        part("path", F.when(F.coalesce("path", F.lit("")) == "", "/").otherwise(F.col("path"))), *[part(n, F.col(n).cast("string")) for n in ("status", "words")], part("title", _or_none("title", 90)), part("h1", _or_none("h1", 70)), part("description", _or_none("description", 110)),
        *[part(n, F.col(n).cast("string")) for n in ("internal_links", "external_links", "images", "images_missing_alt")], part("structured_data", types), part("noindex", F.when(F.col("noindex"), "yes").otherwise("no")), part("lang", _or_none("lang")),
        F.when(opening != "", part("opening", F.substr(quoted, F.lit(2), F.length(quoted) - 2))),
    ]
    return pages.select("site", "path", F.concat(F.lit("- "), F.concat_ws(" | ", *parts)).alias("line"))


def crawl_digest(pages: DataFrame, stats: DataFrame, terms: DataFrame, most: int = 25) -> DataFrame:
    """(site, part, place, line) of pages, site statistics and mined terms (site, term, page_count, in_headings, question, weight).

    ``page`` has a line for each page, by path; ``counts`` one; ``term`` the ``most`` heaviest terms. Lines stay rows: a site's
    digest is read in order of part and place and is never one text in one task.
    """
    nth = lambda *order: (F.row_number().over(Window.partitionBy("site").orderBy(*order)) - 1).alias("place")
    lines = page_lines(pages).select("site", F.lit("page").alias("part"), nth("path", "line"), "line")
    said = F.format_string("%d pages, %d words a page, %d with an H1, %d described, %d with structured data, titles right %d, descriptions right %d, https=%s", "pages", "avg_words", "with_h1", "with_description", "with_schema", "title_length_ok", "description_length_ok", F.col("https").cast("string"))
    counts = stats.select("site", F.lit("counts").alias("part"), F.lit(0).alias("place"), said.alias("line"))
    ranked = terms.select("site", F.lit("term").alias("part"), nth(F.desc("weight"), "term"), F.concat(F.lit("- "), "term", F.format_string(" (pages %d, in headings %d, question %s)", "page_count", "in_headings", F.col("question").cast("string"))).alias("line"))
    return lines.unionByName(counts).unionByName(ranked.filter(F.col("place") < most))
