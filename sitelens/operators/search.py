"""Search analytics over a fact table of search rows.

Fact table: site, date, query, page, device, country, search_type, search_appearance, clicks, impressions, position.
Every operator takes the as-of date as a parameter and works on all sites at once: it groups by ``site`` first.
Click-through rate has 4 decimals and position 1, both rounded after the rows are grouped by the dimensions asked for.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up

#: Share of clicks expected at positions 1 to 15.
BENCHMARK_CTR = [0.287, 0.157, 0.111, 0.082, 0.063, 0.050, 0.040, 0.033, 0.027, 0.023, 0.012, 0.011, 0.010, 0.009, 0.008]
SEARCH_TYPES = ["web", "discover", "googleNews", "image", "video"]
LAG_DAYS = 3


def window_of(rows: DataFrame, as_of: date, days: int, lag: int = LAG_DAYS) -> DataFrame:
    """Rows of the ``days`` days that end ``lag`` days before ``as_of``."""
    end = as_of - timedelta(days=lag)
    return rows.filter(F.col("date").between(F.lit(end - timedelta(days=days - 1)), F.lit(end)))


def measures(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Clicks, impressions, ctr and impression-weighted position of each group of ``dims``."""
    grouped = rows.groupBy(*dims).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("_weighted"))
    ctr = F.when(F.col("impressions") > 0, half_up(F.col("clicks") / F.col("impressions"), 4)).otherwise(0.0)
    position = F.when(F.col("impressions") > 0, half_up(F.col("_weighted") / F.col("impressions"), 1)).otherwise(0.0)
    return grouped.withColumns({"ctr": ctr, "position": position}).drop("_weighted")


def top(frame: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """The first ``k`` rows of each site in a total order."""
    return frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def search_analytics(rows: DataFrame, dims: list[str], as_of: date, days: int = 28, row_limit: int = 1000, search_type: str = "web") -> DataFrame:
    own = window_of(rows.filter(F.col("search_type") == search_type), as_of, days)
    return top(measures(own, ["site", *dims]), row_limit, F.desc("clicks"), *dims)


def performance_overview(rows: DataFrame, as_of: date, days: int = 28) -> DataFrame:
    """Totals of each site; its position is the impression-weighted mean of the rounded positions of its queries."""
    queries = measures(window_of(rows.filter("search_type = 'web'"), as_of, days), ["site", "query"])
    total = queries.groupBy("site").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(half_up(F.col("position") * 10).cast("long") * F.col("impressions")).alias("_tenths"))
    some = F.col("impressions") > 0
    return total.select("site", "clicks", "impressions", F.when(some, half_up(F.col("clicks") / F.col("impressions"), 4)).otherwise(0.0).alias("ctr"), F.when(some, half_up(F.col("_tenths") / 10.0 / F.col("impressions"), 1)).otherwise(0.0).alias("avg_position"))


def two_periods(rows: DataFrame, dims: list[str], as_of: date, days: int = 28, lag: int = 0) -> DataFrame:
    """Measures of each group in the last ``days`` days (``_b``) and in the ``days`` before (``_a``), in one pass; absent periods are null."""
    end_b = as_of - timedelta(days=lag)
    start_b = end_b - timedelta(days=days - 1)
    start_a = start_b - timedelta(days=days)
    period = F.when(F.col("date").between(F.lit(start_b), F.lit(end_b)), "b").when(F.col("date").between(F.lit(start_a), F.lit(start_b - timedelta(days=1))), "a")
    own = rows.filter(F.col("date").between(F.lit(start_a), F.lit(end_b))).withColumn("_p", period)
    sums = own.groupBy(*dims).agg(*[F.sum(F.when(F.col("_p") == p, F.col(c))).alias(f"{c}_{p}") for p in "ab" for c in ("clicks", "impressions")], *[F.sum(F.when(F.col("_p") == p, F.col("position") * F.col("impressions"))).alias(f"_w_{p}") for p in "ab"])
    for p in "ab":
        some = F.col(f"impressions_{p}") > 0
        sums = sums.withColumn(f"ctr_{p}", F.when(some, half_up(F.col(f"clicks_{p}") / F.col(f"impressions_{p}"), 4))).withColumn(f"position_{p}", F.when(some, half_up(F.col(f"_w_{p}") / F.col(f"impressions_{p}"), 1))).drop(f"_w_{p}")
    return sums


def compare_periods(rows: DataFrame, as_of: date, days: int = 28) -> DataFrame:
    both = two_periods(rows.filter("search_type = 'web'"), ["site"], as_of, days, LAG_DAYS)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("clicks_a", "clicks_b", "impressions_a", "impressions_b")}
    both = both.withColumns(zero)
    return both.select("site", *zero, (F.col("clicks_b") - F.col("clicks_a")).alias("clicks_delta"), (F.col("impressions_b") - F.col("impressions_a")).alias("impressions_delta"))


def click_anomalies(rows: DataFrame, as_of: date, days: int = 90, threshold: float = 2.5) -> DataFrame:
    """Days whose clicks are more than ``threshold`` population standard deviations off the site's mean."""
    daily = window_of(rows, as_of, days).groupBy("site", "date").agg(F.sum("clicks").alias("clicks"))
    w = Window.partitionBy("site")
    z = (F.col("clicks") - F.avg("clicks").over(w)) / F.stddev_pop("clicks").over(w)
    return daily.withColumn("z", z).filter(F.abs("z") > threshold).select("site", "date", "clicks", half_up(F.col("z"), 2).alias("z_score"), F.when(F.col("z") > 0, "spike").otherwise("drop").alias("type"))


def type_performance(rows: DataFrame, search_type: str, as_of: date, days: int = 28, limit: int = 50) -> DataFrame:
    """Pages of one search type by impressions."""
    return top(measures(window_of(rows.filter(F.col("search_type") == search_type), as_of, days), ["site", "page"]), limit, F.desc("impressions"), F.col("page"))


def search_type_breakdown(rows: DataFrame, as_of: date, days: int = 28, url: str | None = None) -> DataFrame:
    """Clicks and impressions of each of the five search types, zeros included."""
    own = window_of(rows if url is None else rows.filter(F.col("page") == url), as_of, days)
    sums = own.groupBy("site", "search_type").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    every = rows.select("site").distinct().select("site", F.explode(F.array(*map(F.lit, SEARCH_TYPES))).alias("search_type"))
    return every.join(sums, ["site", "search_type"], "left").select("site", "search_type", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"))


def ai_overview_rows(rows: DataFrame, as_of: date, days: int = 28, limit: int = 100) -> DataFrame:
    own = window_of(rows.filter("search_type = 'web'"), as_of, days)
    return top(measures(own, ["site", "query", "search_appearance"]), limit, F.desc("impressions"), F.col("query"), F.col("search_appearance"))


def benchmark_ctr(position: Column) -> Column:
    """Expected ctr at a position: rounded half to even, kept within 1 and 15."""
    place = F.greatest(F.lit(1), F.least(F.lit(15), F.bround(position, 0).cast("int")))
    return F.element_at(F.array(*map(F.lit, BENCHMARK_CTR)), place)


def quick_wins(rows: DataFrame, as_of: date, days: int = 28, min_impressions: int = 10) -> DataFrame:
    """Pages at positions 4 to 15 with a ctr below what their position promises."""
    pages = measures(window_of(rows.filter("search_type = 'web'"), as_of, days), ["site", "page"])
    held = pages.filter(F.col("position").between(4, 15) & (F.col("impressions") >= min_impressions)).withColumn("benchmark_ctr", benchmark_ctr(F.col("position")))
    return held.filter(F.col("ctr") < F.col("benchmark_ctr")).select("site", "page", "position", "clicks", "impressions", "ctr", "benchmark_ctr", F.bround(F.col("benchmark_ctr") * F.col("impressions")).cast("long").alias("expected_clicks"), F.bround((F.col("benchmark_ctr") - F.col("ctr")) * F.col("impressions")).cast("long").alias("opportunity_score"))


def traffic_drops(rows: DataFrame, as_of: date, days: int = 28) -> DataFrame:
    """Queries with fewer clicks than in the period before, and why."""
    both = two_periods(rows.filter("search_type = 'web'"), ["site", "query"], as_of, days).filter("clicks_b < clicks_a")
    why = F.when(F.col("position_b") > F.col("position_a") + 2, "ranking_loss").when(F.col("ctr_b") < F.col("ctr_a") * 0.7, "ctr_collapse").otherwise("demand_decline")
    return both.select("site", "query", (F.col("clicks_b") - F.col("clicks_a")).alias("clicks_delta"), (F.col("impressions_b") - F.col("impressions_a")).alias("impressions_delta"), F.col("position_b").alias("position_current"), F.col("position_a").alias("position_previous"), why.alias("diagnosis"))


def striking_distance(rows: DataFrame, as_of: date, days: int = 28, low: float = 8, high: float = 15) -> DataFrame:
    """Queries just below the first results."""
    return measures(window_of(rows.filter("search_type = 'web'"), as_of, days), ["site", "query"]).filter(F.col("position").between(low, high))


def query_cannibalization(rows: DataFrame, as_of: date, days: int = 28, min_impressions: int = 50, min_conflict: float = 0.1) -> DataFrame:
    """Queries whose clicks several pages share: 1 - the Herfindahl index of the pages' shares."""
    pages = measures(window_of(rows.filter("search_type = 'web'"), as_of, days), ["site", "query", "page"])
    total = F.sum("clicks").over(Window.partitionBy("site", "query"))
    shares = pages.withColumn("_share", F.when(total > 0, F.pow(F.col("clicks") / total, 2)))
    groups = shares.groupBy("site", "query").agg(F.count("*").alias("pages"), F.sum("clicks").alias("total_clicks"), F.sum("impressions").alias("total_impressions"), F.sum("_share").alias("_hhi"), F.max_by("page", F.struct("clicks", "page")).alias("top_page"))
    conflict = 1 - F.coalesce("_hhi", 1 / F.col("pages"))
    return groups.withColumn("_conflict", conflict).filter((F.col("pages") >= 2) & (F.col("total_impressions") >= min_impressions) & (F.col("_conflict") > min_conflict)).select("site", "query", "pages", "total_clicks", "total_impressions", half_up(F.col("_conflict"), 4).alias("conflict_score"), "top_page")


def lost_queries(rows: DataFrame, as_of: date, days: int = 28, min_clicks: int = 5, drop: float = 0.8) -> DataFrame:
    """Queries that lost ``drop`` of their clicks or more; one that is gone counts as 0."""
    both = two_periods(rows.filter("search_type = 'web'"), ["site", "query"], as_of, days).filter(F.col("clicks_a") >= min_clicks).withColumn("now", F.coalesce("clicks_b", F.lit(0)))
    share = (F.col("clicks_a") - F.col("now")) / F.col("clicks_a")
    return both.filter(share >= drop).select("site", "query", F.col("clicks_a").alias("clicks_previous"), F.col("now").alias("clicks_current"), half_up(share * 100, 1).alias("drop_pct"))


def search_alerts(rows: DataFrame, as_of: date, days: int = 28, share: float = 0.5, position: float = 10, impressions: int = 5000) -> DataFrame:
    """Rows (page and query) with most of a site's clicks, or with many impressions at a low rank."""
    pairs = measures(window_of(rows.filter("search_type = 'web'"), as_of, days), ["site", "page", "query"]).withColumn("_total", F.sum("clicks").over(Window.partitionBy("site")))
    kind = F.when((F.col("_total") > 0) & (F.col("clicks") / F.col("_total") > share), "traffic_concentration").when((F.col("position") > position) & (F.col("impressions") > impressions), "high_impression_low_rank")
    return pairs.withColumn("type", kind).filter("type is not null").select("site", "page", "query", "type", F.when(F.col("type") == "traffic_concentration", "high").otherwise("medium").alias("severity"), "clicks", "impressions", "position")


def sitemap_audit(declared: DataFrame, seen: DataFrame, partial: float = 0.2, samples: int = 20) -> DataFrame:
    """Declared URLs against those with search rows, by trimmed lower-case URL: (site, url) each."""
    key = lambda f: f.select("site", F.lower(F.regexp_replace("url", "/+$", "")).alias("url")).distinct()
    a, b = key(declared).withColumn("_d", F.lit(1)), key(seen).withColumn("_s", F.lit(1))
    joined = a.join(b, ["site", "url"], "full")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))
    sample = joined.filter(F.col("_s").isNull()).withColumn("r", rank).filter(F.col("r") <= samples).groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("url")), "|").alias("missing_sample"))
    both = joined.groupBy("site").agg(F.count("_d").alias("declared"), F.count("_s").alias("seen"), F.count_if(F.col("_d").isNotNull() & F.col("_s").isNotNull()).alias("in_both"), F.count_if(F.col("_d").isNotNull() & F.col("_s").isNull()).alias("only_declared"), F.count_if(F.col("_d").isNull()).alias("only_seen"))
    missing = F.when(F.col("declared") > 0, F.col("only_declared") / F.col("declared")).otherwise(0.0)
    verdict = F.when(F.col("declared") == 0, "empty").when(missing > partial, "partial").otherwise("healthy")
    both = both.withColumn("missing_ratio", half_up(missing, 4)).withColumn("verdict", verdict)
    return both.join(sample, "site", "left").withColumn("missing_sample", F.coalesce("missing_sample", F.lit("")))
