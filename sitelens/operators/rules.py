"""Rule checks and statistics over page evidence (site, path, title, h1, description, lang, canonical, words, flags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bands import SEVERITY_WEIGHT
from ..functions.numbers import half_up
from ..functions.text import FILLER_PHRASES

#: Rule, severity, and when a page breaks it.
#: What each rule is called, how grave it is and when it holds.
_RULES: list[tuple[str, str, str]] = [
    ("viewport", "serious", "not has_viewport"),
    ("noindex", "critical", "noindex"),
    ("missing-title", "serious", "title = ''"),
    ("missing-h1", "moderate", "h1 = ''"),
    ("missing-description", "moderate", "description = ''"),
    ("thin-content", "moderate", "words > 0 and words < 200"),
    ("empty-content", "serious", "words < 40"),
    ("alt-missing", "minor", "images_missing_alt > 0"),
    ("long-titles", "minor", "length(title) > 60"),
    ("long-descriptions", "minor", "length(description) > 160"),
    ("no-lang", "minor", "lang = ''"),
    ("no-canonical", "minor", "canonical = '' and path <> '/'"),
    ("https", "critical", "path = '/' and not has_https"),
]


def rule_hits(pages: DataFrame) -> DataFrame:
    """(site, rule_id, severity, path): every page that breaks a rule, in one pass over the pages."""
    each = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, when in _RULES]))
    simple = pages.select("site", "path", F.explode(each).alias("x")).select("site", "x.rule_id", "x.severity", "path")
    twice = duplicate_titles(pages).select("site", F.lit("dupe-titles").alias("rule_id"), F.lit("serious").alias("severity"), "path")
    bare = pages.groupBy("site").agg(F.bool_or("has_schema").alias("_any")).filter("not _any").select("site")
    none = pages.join(bare, "site", "left_semi").select("site", F.lit("no-schema").alias("rule_id"), F.lit("moderate").alias("severity"), "path")
    return simple.unionByName(twice).unionByName(none)


def rule_findings(hits: DataFrame, most: int = 12) -> DataFrame:
    """One finding of each site and rule with its count and its first paths."""
    rank = F.row_number().over(Window.partitionBy("site", "rule_id").orderBy("path"))
    ranked = hits.withColumn("r", rank)
    return ranked.groupBy("site", "rule_id", "severity").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("path")))), ",").alias("paths"))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    key = F.lower(F.trim("title"))
    n = F.count("*").over(Window.partitionBy("site", "key"))
    return pages.filter("title <> ''").select("site", "path", key.alias("key")).withColumn("n", n).filter("n > 1").select("site", "path", F.col("key").alias("title_key"), "n")


def rule_stats(pages: DataFrame) -> DataFrame:
    count = lambda when: F.count_if(F.expr(when))
    return pages.groupBy("site").agg(F.count("*").alias("pages"), half_up(F.sum("words") / F.count("*")).cast("long").alias("avg_words"), count("has_schema").alias("with_schema"), count("description <> ''").alias("with_description"), count("h1 <> ''").alias("with_h1"), F.bool_or("has_https").alias("https"), count("title <> '' and length(title) <= 60").alias("title_length_ok"), count("description <> '' and length(description) <= 160").alias("description_length_ok"))


def severity_points(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv])[severity]


def rule_only_score(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """80 less the weights of a site's findings, up to 10, 8 and 8 more by its pages' shares with structured data, description and H1, 8 with https; within 0 and 100."""
    load = findings.groupBy("site").agg(F.sum(severity_points(F.col("severity"))).alias("load"))
    bonus = F.col("with_schema") / F.col("pages") * 10 + F.col("with_description") / F.col("pages") * 8 + F.col("with_h1") / F.col("pages") * 8 + F.when(F.col("https"), 8).otherwise(0)
    return stats.join(load, "site", "left").select("site", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 80 - F.coalesce("load", F.lit(0)) + bonus))).cast("int").alias("score"))


def rule_count_per_page(pages: DataFrame, hits: DataFrame) -> DataFrame:
    n = hits.groupBy("site", "path").agg(F.count_distinct("rule_id").alias("findings"))
    return pages.select("site", "path").distinct().join(n, ["site", "path"], "left").fillna({"findings": 0})


def crawl_totals(pages: DataFrame, counts: DataFrame) -> DataFrame:
    return pages.join(counts, ["site", "path"], "left").groupBy("site").agg(F.sum("words").alias("words"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.count_if(F.col("words") < 200).alias("thin"))


def _some(column: str, most: int) -> Column:
    """The first values by name of an array column, of a whole group; empty ones don't count."""
    return F.array_join(F.slice(F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set(column))), F.array(F.lit("")))), 1, most), "|")


def entity_facts(pages: DataFrame, most_types: int = 12, most_authors: int = 8) -> DataFrame:
    """Who a site says it is (site, schema_types, authors, lang, has_schema, h1, has_https): types, named authors, languages, counts.

    The values are distinct names, of which a site has few.
    """
    return pages.groupBy("site").agg(_some("schema_types", most_types).alias("schema_types"), _some("authors", most_authors).alias("named_authors"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("lang") != "", F.col("lang")))), "|").alias("languages"), F.count_if("has_schema").alias("pages_with_schema"), F.count_if(F.col("h1") != "").alias("pages_with_h1"), F.bool_or("has_https").alias("https"))


def proof_block(pages: DataFrame, graph: DataFrame) -> DataFrame:
    """What a site can prove (site, authors, text, has_schema, words, external_hosts), with its orphans and dead ends (site, orphan, dead_end)."""
    own = pages.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.size("authors") > 0).alias("with_author"), F.count_if(F.col("text").rlike(r"\b(19|20)[0-9]{2}\b")).alias("with_date"), F.count_if("has_schema").alias("with_schema"), half_up(F.sum("words") / F.count("*")).cast("long").alias("avg_words"))
    hosts = pages.select("site", F.explode("external_hosts").alias("h")).distinct().groupBy("site").agg(F.count("*").alias("external_sources"))
    ends = graph.groupBy("site").agg(F.count_if("orphan").alias("orphans"), F.count_if("dead_end").alias("dead_ends"))
    return own.join(hosts, "site", "left").join(ends, "site", "left").fillna(0, ["external_sources", "orphans", "dead_ends"])


def content_quality(docs: DataFrame) -> DataFrame:
    """Score, flags and verdict of each (doc_id, text): filler, density of names and figures, repeated word pairs, length.

    Rounding to whole points is half to even. Pairs are counted inside the row; nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0)), F.lower)
    d = docs.select("doc_id", text.alias("text"), words.alias("w")).withColumn("n", F.size("w"))
    pairs = F.when(F.col("n") >= 4, F.zip_with(F.slice("w", 1, F.col("n") - 1), F.slice("w", 2, F.col("n")), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("p", F.sort_array(pairs)).withColumn("kinds", F.size(F.array_distinct("p")))
    # In sorted order a pair that repeats equals the one before; the first repeat of each is what counts.
    again = F.size(F.array_distinct(F.array_compact(F.transform("p", lambda x, i: F.when((i > 0) & (F.get("p", i - 1) == x), x)))))
    lower = F.lower("text")
    filler = sum(F.contains(lower, F.lit(x)).cast("int") for x in FILLER_PHRASES)
    figures = F.size(F.regexp_extract_all("text", F.lit(r"\b[0-9]+(?:[.,][0-9]+)?(?:%|st|nd|rd|th)?\b"), F.lit(0)))
    names = F.size(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lit(0)))
    d = d.withColumns({"unique_tokens": F.size(F.array_distinct("w")), "density": half_up(F.least(F.lit(1.0), (figures + names) * 10.0 / F.greatest(F.lit(1), F.col("n"))), 3), "repetition": F.bround(again * 100.0 / F.greatest(F.lit(1), F.col("kinds")), 0).cast("int"), "filler": F.least(F.lit(100), F.bround(filler * 25.0 / F.greatest(F.lit(1.0), F.col("n") / 1000.0), 0).cast("int"))})
    overall = half_up((100 - F.col("filler")) * 0.35 + F.col("density") * 35.0 + (100 - F.col("repetition")) * 0.2 + F.least(F.lit(100.0), F.col("n") / 10.0) * 0.1).cast("int")
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("filler") >= 50, "filler"), F.when(F.col("density") < 0.2, "low-density"), F.when(F.col("repetition") >= 30, "repetitive"), F.when(F.col("n") < 300, "thin-content"))), ",")
    verdict = F.when(F.col("n") < 300, "thin_content").when(overall >= 60, "good").otherwise("needs_work")
    return d.select("doc_id", F.col("n").alias("word_count"), "unique_tokens", "filler", "density", "repetition", overall.alias("overall"), flags.alias("flags"), verdict.alias("verdict"))


def inspection_category(r: dict[str, Column]) -> Column:
    """One of ten categories from an inspection's verdict, robots, fetch, coverage, google and user columns."""
    has = lambda s: F.contains(r["coverage"], F.lit(s))
    return (
        F.when(r["verdict"] == "PASS", "indexed")
        .when(F.contains(r["robots"], F.lit("BLOCKED_BY_ROBOTS_TXT")), "robots_blocked")
        .when(~r["fetch"].isin("", "SUCCESSFUL", "PAGE_FETCH_STATE_UNSPECIFIED"), "fetch_error")
        .when((r["google"] != "") & (r["user"] != "") & (r["google"] != r["user"]), "canonical_issue")
        .when(has("unknown to Google"), "unknown")
        .when(has("Discovered - currently not indexed"), "discovered_not_indexed")
        .when(has("Crawled - currently not indexed"), "crawled_not_indexed")
        .when(has("Duplicate"), "duplicate")
        .when(has("Excluded"), "excluded")
        .otherwise("not_indexed")
    )


#: What an inspection can come to.
CATEGORIES = ["indexed", "robots_blocked", "fetch_error", "canonical_issue", "unknown", "discovered_not_indexed", "crawled_not_indexed", "duplicate", "excluded", "not_indexed"]


def indexing_summary(inspections: DataFrame) -> DataFrame:
    """Inspections of each site and category, zeros included; (site, category) in."""
    every = inspections.select("site").distinct().select("site", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return every.join(inspections.groupBy("site", "category").agg(F.count("*").alias("n")), ["site", "category"], "left").fillna({"n": 0})
