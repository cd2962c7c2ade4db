"""Link graph of a crawl: edges (site, src, dst) between nodes (site, path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up


def link_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct links between known nodes, none from a node to itself."""
    known = nodes.select("site", "path").distinct()
    found = links.filter("src <> dst").select("site", "src", "dst").distinct()
    return found.join(known.withColumnRenamed("path", "src"), ["site", "src"], "left_semi").join(known.withColumnRenamed("path", "dst"), ["site", "dst"], "left_semi").select("site", "src", "dst")


def link_degrees(edges: DataFrame, nodes: DataFrame, most: int = 25) -> DataFrame:
    """In and out degree of every node, zeros included, and the first paths that link to it.

    A hub's paths are ranked and cut before they are gathered, so no group is collected whole.
    """
    inward = edges.groupBy("site", F.col("dst").alias("path")).agg(F.count("*").alias("inbound"))
    outward = edges.groupBy("site", F.col("src").alias("path")).agg(F.count("*").alias("outbound"))
    rank = F.row_number().over(Window.partitionBy("site", "dst").orderBy("src"))
    some = edges.withColumn("r", rank).filter(F.col("r") <= most).groupBy("site", F.col("dst").alias("path")).agg(F.array_sort(F.collect_list("src")).alias("p"))
    joined = nodes.select("site", "path").distinct().join(inward, ["site", "path"], "left").join(outward, ["site", "path"], "left").join(some, ["site", "path"], "left")
    return joined.select("site", "path", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"), F.coalesce(F.array_join("p", ","), F.lit("")).alias("inbound_paths"))


def inbound_share_rank(degrees: DataFrame) -> DataFrame:
    """Share of a site's inbound links and rank by them, from 0."""
    total = F.sum("inbound").over(Window.partitionBy("site"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("inbound"), "path")) - 1
    return degrees.select("site", "path", "inbound", F.when(total > 0, half_up(F.col("inbound") / total, 4)).otherwise(0.0).alias("inbound_share"), rank.alias("inbound_rank"))


def orphans_dead_ends(degrees: DataFrame, home: str = "/") -> DataFrame:
    return degrees.filter((F.col("path") != home) & ((F.col("inbound") == 0) | (F.col("outbound") == 0))).select("site", "path", (F.col("inbound") == 0).alias("orphan"), (F.col("outbound") == 0).alias("dead_end"))


def hops_from_home(edges: DataFrame, nodes: DataFrame, home: str = "/", merge_after: int = 32) -> DataFrame:
    """Least number of links from each site's home; -1 if there is no way. One frontier join a level, until a level is empty.

    Levels are written once each and stay apart; after ``merge_after`` of them they become one, so that no plan grows with
    their number and none of them is written at every level.
    """
    every = nodes.select("site", "path").distinct()
    levels = [every.filter(F.col("path") == home).withColumn("hops", F.lit(0)).checkpoint()]
    seen = lambda: reduce(DataFrame.unionByName, levels)
    front, level = levels[0], 0
    while not front.isEmpty():
        level += 1
        found = edges.join(front.select("site", F.col("path").alias("src")), ["site", "src"], "left_semi").select("site", F.col("dst").alias("path")).distinct()
        front = found.join(seen(), ["site", "path"], "left_anti").withColumn("hops", F.lit(level)).checkpoint()
        levels.append(front)
        if len(levels) > merge_after:
            levels = [seen().checkpoint()]
    return every.join(seen(), ["site", "path"], "left").select("site", "path", F.coalesce("hops", F.lit(-1)).alias("hops"))


def graph_summary(degrees: DataFrame, hops: DataFrame, discovered: DataFrame) -> DataFrame:
    """Per site: pages, mean and largest in-degree, reachable pages, share of discovered pages that are nodes."""
    base = degrees.groupBy("site").agg(F.count("*").alias("pages"), half_up(F.sum("inbound") / F.count("*"), 2).alias("avg_in_degree"), F.max("inbound").alias("max_in_degree"))
    reached = hops.groupBy("site").agg(F.count_if(F.col("hops") >= 0).alias("reachable"))
    known = discovered.groupBy("site").agg(F.count_distinct("path").alias("discovered"))
    return base.join(reached, "site").join(known, "site").select("site", "pages", "avg_in_degree", "max_in_degree", "reachable", half_up(F.least(F.lit(1.0), F.col("pages") / F.col("discovered")), 3).alias("coverage"))


def stamp_positions(pages: DataFrame, degrees: DataFrame, hops: DataFrame) -> DataFrame:
    return pages.join(degrees.select("site", "path", "inbound", "outbound"), ["site", "path"], "left").join(hops, ["site", "path"], "left").fillna({"inbound": 0, "outbound": 0, "hops": -1})


def robots_filter(urls: DataFrame, rules: DataFrame, honour_disallow_all: bool = False) -> DataFrame:
    """Rows of ``urls`` (site, path) that no rule (site, prefix) forbids; the rule ``/`` counts only if asked for.

    Paths meet rules by their own prefixes of the lengths that rules have, so this is an equi-join.
    """
    own = rules.filter("prefix <> ''" if honour_disallow_all else "prefix not in ('', '/')").select("site", "prefix").distinct()
    sizes = own.select("site", F.length("prefix").alias("n")).distinct()
    hit = urls.select("site", "path").distinct().join(sizes, "site").withColumn("prefix", F.substr(F.col("path"), F.lit(1), F.col("n"))).join(own, ["site", "prefix"], "left_semi").select("site", "path").distinct()
    return urls.join(hit, ["site", "path"], "left_anti")


def crawl_frontier(links: DataFrame, level: DataFrame, seen: DataFrame, rules: DataFrame, most: int = 40) -> DataFrame:
    """The next level: unseen, allowed targets of the pages of ``level``, ``most`` a site by path."""
    found = links.join(level.select("site", F.col("path").alias("src")), ["site", "src"], "left_semi").select("site", F.col("dst").alias("path")).distinct().join(seen, ["site", "path"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("path"))
    return robots_filter(found, rules).withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def discovered_not_crawled(discovered: DataFrame, pages: DataFrame) -> DataFrame:
    return discovered.select("site", "path").distinct().join(pages, ["site", "path"], "left_anti")
