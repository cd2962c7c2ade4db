"""Sitemap files as tables: indexes are followed to the files they name until there is nothing new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder


def sitemap_locs(files: DataFrame) -> DataFrame:
    """(url, is_index, loc) of sitemap texts (url, body), one row an address that a file names."""
    locs = F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return files.select("url", F.col("body").rlike("(?i)<sitemapindex").alias("is_index"), F.explode(locs).alias("loc")).distinct()


def read_sitemap_urls(roots: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """(site, loc): the page addresses of the sitemaps ``roots`` (site, url), through indexes of any depth, each address once.

    A round joins the files that were named and not read before with what they name. It ends when none is new, so indexes
    that name each other or themselves end too; files that are not in ``files`` (url, body) name nothing. With ``most``
    a site keeps its first addresses by name.
    """
    spark, base = roots.sparkSession, f"{shared_folder(roots.sparkSession)}/sitemaps-{uuid.uuid4().hex}"

    def kept(frame: DataFrame, name: str) -> DataFrame:  # each round reads what the last one wrote, so no plan grows with their number
        frame.write.parquet(f"{base}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{base}/{name}")

    locs = kept(sitemap_locs(files), "locs")
    indexes = locs.filter("is_index").select("url", "loc")
    frontier = kept(roots.select("site", "url").filter("url IS NOT NULL").distinct(), "0")
    seen, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        named = frontier.join(indexes, "url").select("site", F.col("loc").alias("url")).distinct()
        frontier = kept(named.join(seen, ["site", "url"], "left_anti"), str(level))
        seen = seen.unionByName(frontier)
    found = seen.join(locs.filter("NOT is_index").select("url", "loc"), "url").select("site", "loc").distinct()
    if most is None:
        return found
    return found.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy("loc"))).filter(F.col("r") <= most).drop("r")
