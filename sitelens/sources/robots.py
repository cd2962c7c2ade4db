"""Robots files as tables: the order of their lines is a window, a group of agents is a running count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Crawlers that fetch for language models.
AI_AGENTS = "GPTBot ChatGPT-User OAI-SearchBot ClaudeBot anthropic-ai PerplexityBot Google-Extended Applebot-Extended CCBot Bytespider".split()


def robots_lines(files: DataFrame) -> DataFrame:
    """(site, line, key, value) of robots texts (site, text): keys in lower case, comments cut off, key null where a line is empty.

    A line that has only a comment or spaces has the key ''. A null text is no file and gives no lines.
    """
    lines = files.select("site", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace(F.split("raw", "#", 2)[0], r"^\s+|\s+$", ""))
    key = F.lower(F.trim(F.split(bare, ":", 2)[0]))
    return lines.select("site", "line", F.when(F.regexp_replace("raw", "\r$", "") == "", None).otherwise(key).alias("key"), F.trim(F.coalesce(F.get(F.split(bare, ":", 2), 1), F.lit(""))).alias("value"))


def read_robots(files: DataFrame) -> DataFrame:
    """(site, line, kind, value): ``disallow`` prefixes that hold for every agent, and ``sitemap`` addresses.

    The nearest line above that names an agent decides whether a prefix is for all; empty prefixes forbid nothing.
    """
    before = Window.partitionBy("site").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for_all = F.last(F.when(F.col("key") == "user-agent", F.col("value") == "*"), ignorenulls=True).over(before)
    marked = robots_lines(files).withColumn("for_all", for_all)
    return marked.filter("key = 'sitemap' OR key = 'disallow' AND for_all AND value <> ''").select("site", "line", F.col("key").alias("kind"), "value")


def robots_groups(files: DataFrame) -> DataFrame:
    """(site, group, line, key, value): lines that name agents (``user-agent``) or rule (``allow``, ``disallow``), by group.

    Agents that follow one another share a group. An empty line ends it: what rules come after it, before other agents,
    hold for nobody, and agents without a rule before it are forgotten.
    """
    by = Window.partitionBy("site").orderBy("line")
    upto, above = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(F.col("key").isNull(), "end").when(F.col("key") == "user-agent", "agent").when(F.col("key").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    told = robots_lines(files).withColumn("kind", kind).filter("kind IS NOT NULL")
    opens = (F.col("kind") == "agent") & (F.coalesce(F.last("kind").over(above), F.lit("end")) != "agent")
    told = told.withColumns({"group": F.sum(opens.cast("int")).over(upto), "scope": F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(upto)})
    return told.filter("scope = 'agent' AND kind <> 'end'").select("site", "group", "line", "key", "value")


def ai_crawler_access(files: DataFrame, urls: DataFrame, agents: list[str] | None = None, *, longest: bool = False, honour_disallow_all: bool = True) -> DataFrame:
    """(site, path, agent, allowed) for each of ``urls`` (site, path) and agent.

    The first group that names a part of the agent's name counts, else the first group of ``*``, else all is allowed. In it
    the first rule that the path begins with decides, or with ``longest`` the longest (allowing, of two equal ones); an
    empty disallow allows. Without ``honour_disallow_all`` the rule ``/`` forbids nothing.
    """
    told = robots_groups(files)
    rules = told.filter("key IN ('allow', 'disallow')").select("site", "group", "line", F.col("value").alias("prefix"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"))
    ruled = told.filter("key <> 'user-agent'").select("site", "group").distinct()
    named = told.filter("key = 'user-agent'").select("site", "group", F.lower("value").alias("name")).join(ruled, ["site", "group"], "left_semi")
    general = named.filter("name = '*'").select("site", "group").distinct()
    first_general = general.groupBy("site").agg(F.min("group").alias("general"))
    special = named.join(general, ["site", "group"], "left_anti").withColumn("agent", F.explode(F.array(*map(F.lit, agents or AI_AGENTS))))
    special = special.filter(F.contains(F.lower("agent"), F.col("name"))).groupBy("site", "agent").agg(F.min("group").alias("special"))
    asked = urls.select("site", "path").distinct().withColumn("agent", F.explode(F.array(*map(F.lit, agents or AI_AGENTS))))
    asked = asked.join(special, ["site", "agent"], "left").join(first_general, "site", "left").withColumn("group", F.coalesce("special", "general"))
    fits = F.col("path").startswith(F.col("prefix")) | (F.col("prefix") == "*")
    if not honour_disallow_all:
        rules = rules.filter("prefix <> '/' OR allow")
    rank = F.struct(-F.length("prefix"), ~F.col("allow"), "line") if longest else F.struct("line")
    met = asked.join(rules, ["site", "group"]).filter(fits).groupBy("site", "path", "agent").agg(F.min_by("allow", rank).alias("allowed"))
    return asked.select("site", "path", "agent").join(met, ["site", "path", "agent"], "left").select("site", "path", "agent", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def ai_visibility(files: DataFrame, access: DataFrame) -> DataFrame:
    """(site, path, robots_found, allowed_count, total, verdict): ``open`` if all agents may, ``closed`` if none may, else ``partial``."""
    found = files.select("site", F.col("text").isNotNull().alias("robots_found"))
    counts = access.groupBy("site", "path").agg(F.count_if("allowed").alias("allowed_count"), F.count("*").alias("total"))
    verdict = F.when(F.col("allowed_count") == F.col("total"), "open").when(F.col("allowed_count") == 0, "closed").otherwise("partial")
    return counts.join(found, "site", "left").select("site", "path", F.coalesce("robots_found", F.lit(False)).alias("robots_found"), "allowed_count", "total", verdict.alias("verdict"))
