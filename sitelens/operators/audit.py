"""Scores and ledgers of runs, run history and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up

def site_score(judged: DataFrame, findings: DataFrame, penalties: DataFrame) -> DataFrame:
    """Mean of pages weighed by 0.35 + importance, each less the weights of its findings in hundredths, less the site's rule penalty."""
    load = findings.groupBy("site", "item_id").agg(F.sum("points").alias("load"))
    w = 0.35 + F.col("importance")
    part = F.greatest(F.lit(0.0), 1 - F.coalesce("load", F.lit(0)) / 100.0)
    own = judged.join(load, ["site", "item_id"], "left").groupBy("site").agg(F.sum(half_up(w * part, 9)).alias("num"), F.sum(half_up(w, 9)).alias("den"))
    return own.join(penalties, "site", "left").select("site", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("num") / F.col("den") * 100 - F.coalesce("penalty", F.lit(0))))).cast("int").alias("score"))


def ledger_totals(calls: DataFrame) -> DataFrame:
    """(site, tokens, cost, ms) calls: number, sums, median (rounded between two) and 95th percentile of ms by place in order, floor(0.95 n).

    Places are found in the counts of the different durations, so a site's calls are never ordered in one task.
    """
    sums = calls.groupBy("site").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum(F.col("cost").cast("decimal(18,8)")).cast("double").alias("cost"))
    counts = calls.groupBy("site", "ms").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("site").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("ms")))
    t = counts.join(sums, "site").groupBy("site", "calls", "tokens", "cost").agg(at(F.floor((F.col("calls") - 1) / 2)).alias("a"), at(F.floor(F.col("calls") / 2)).alias("b"), at(F.least(F.col("calls") - 1, F.floor(F.col("calls") * 0.95))).alias("p95"))
    return t.select("site", "calls", "tokens", half_up(F.col("cost"), 6).alias("cost"), half_up((F.col("a") + F.col("b")) / 2).cast("long").alias("median_ms"), F.col("p95").alias("p95_ms"))


# ---- run history -----------------------------------------------------------------------------------------------------


def latest_pair(runs: DataFrame) -> DataFrame:
    """(root, current, previous): the newest run of a root and the one before, null if there is none."""
    heads = runs.select("root", "run_no").distinct()
    return heads.groupBy("root").agg(F.slice(F.sort_array(F.collect_set("run_no"), asc=False), 1, 2).alias("two")).select("root", F.get("two", 0).alias("current"), F.get("two", 1).alias("previous"))


def keep_newest(runs: DataFrame, most: int = 10) -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy("root").orderBy(F.desc("run_no")))
    return runs.withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def diff_runs(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(root, path, state): how each page of either run stands against the other."""
    c = current.select("root", "path", F.lit(True).alias("c"), F.col("reachable").alias("cr"), F.col("raised").alias("cx"), F.col("change_key").alias("ck"), F.col("band_rank").alias("cb"))
    p = previous.select("root", "path", F.lit(True).alias("p"), F.col("reachable").alias("pr"), F.col("raised").alias("px"), F.col("change_key").alias("pk"), F.col("band_rank").alias("pb"))
    state = (
        F.when(F.col("c").isNull(), F.when(F.col("px"), "not_comparable").otherwise("unreachable_before"))
        .when(F.col("p").isNull(), F.when(F.col("cx"), "newly_raised").otherwise("clean"))
        .when(F.col("cx") & ~F.col("pr"), "newly_raised")
        .when(F.col("px") & ~F.col("cr"), "not_comparable")
        .when(~F.col("cr") | ~F.col("pr"), "unreachable_before")
        .when(~F.col("cx"), F.when(F.col("px"), "not_longer_raised").otherwise("clean"))
        .when(~F.col("px") | (F.col("cb") > F.col("pb")), "regressed")
        .when(~F.col("ck").eqNullSafe(F.col("pk")), "changed")
        .otherwise("still_open")
    )
    return c.join(p, ["root", "path"], "full").select("root", "path", state.alias("state"))


def delta_summary(states: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return states.groupBy("root").agg(F.count("*").alias("pages"), n("regressed", "changed", "still_open", "not_longer_raised", "clean").alias("comparable"), n("clean").alias("clean"), n("unreachable_before", "not_comparable").alias("unreachable"), n("not_longer_raised", "newly_raised", "regressed").alias("moved"))


def score_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(root, score_delta) of two runs' heads (root, score, model); null unless one model judged both."""
    p = previous.select("root", F.col("score").alias("before"), F.col("model").alias("other"))
    return current.join(p, "root", "left").select("root", F.when(F.col("model") == F.col("other"), F.col("score") - F.col("before")).alias("score_delta"))


# ---- event log, batch forms ------------------------------------------------------------------------------------------


def live_counters(events: DataFrame) -> DataFrame:
    """Counts and cost of each run; a replayed event (of the same seq) counts once."""
    n = lambda t: F.count_if(F.col("type") == t)
    return events.dropDuplicates(["run_id", "seq"]).groupBy("run_id").agg(n("page-done").alias("pages"), n("keyword-done").alias("keywords"), n("gap-done").alias("gaps"), n("error").alias("errors"), F.sum(F.col("cost").cast("decimal(18,8)")).cast("double").alias("cost"))


def latest_by_key(events: DataFrame) -> DataFrame:
    """The last event of each item of a run; a replay changes nothing."""
    return events.groupBy("run_id", "item_key").agg(F.max_by("type", "seq").alias("type"), F.max("seq").alias("seq"))


def pending_items(events: DataFrame) -> DataFrame:
    done = events.filter("type = 'page-done'").select("run_id", "item_key").distinct()
    return events.filter("type = 'page-start'").select("run_id", "item_key").distinct().join(done, ["run_id", "item_key"], "left_anti")


def slots(events: DataFrame) -> DataFrame:
    """First start and first done of each item; either may be missing."""
    first = lambda t, c: events.filter(F.col("type") == t).groupBy("run_id", "item_key").agg(F.min("seq").alias(c))
    return first("page-start", "started").join(first("page-done", "done"), ["run_id", "item_key"], "full")


def stage_of_run(events: DataFrame) -> DataFrame:
    """The last stage of each run: crawl, keywords, rivals or site; a problem is no stage."""
    stage = F.when(F.col("type").startswith("crawl"), "crawl").when(F.col("type").startswith("keyword"), "keywords").when(F.col("type").startswith("competitor"), "rivals").otherwise("site")
    return events.filter("type <> 'error'").groupBy("run_id").agg(F.max_by(stage, "seq").alias("stage"))


def recent_log(events: DataFrame, most: int = 200) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))
    return events.withColumn("r", rank).filter(F.col("r") <= most).select("run_id", "seq", "type")


def recent_problems(events: DataFrame, most: int = 12) -> DataFrame:
    """The last problem lines of each run."""
    return recent_log(events.filter("type = 'error'"), most)


def crawl_rows(live: DataFrame, final: DataFrame) -> DataFrame:
    """(site, path, words, title): rows seen live, overlaid by the final report, and rows of the report alone."""
    both = live.select("site", "path", F.col("words").alias("w"), F.col("title").alias("t")).join(final.select("site", "path", "words", "title"), ["site", "path"], "full")
    return both.select("site", "path", F.coalesce("words", "w").alias("words"), F.coalesce("title", "t").alias("title"))


def log_counters(lines: DataFrame) -> DataFrame:
    """(run_id, text) lines of a session: searches, tool calls and messages."""
    text, tool = F.col("text"), r"^— \S+ (completed|running|pending|error)$"
    return lines.groupBy("run_id").agg(F.count_if(text.rlike(r"^— \S+ (completed|error|pending)")).alias("searches"), F.count_if(text.rlike(tool)).alias("tools"), F.count_if(text.startswith("— ") & ~text.rlike(tool)).alias("messages"))


def event_windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), size)
    return events.groupBy(w.alias("w"), "type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "type", "n")


def sessions(events: DataFrame, gap_seconds: int = 6 * 3600) -> DataFrame:
    """Sessions of a run: event times further apart than the gap begin a new one. Built by running sums, not by groups in memory."""
    by = Window.partitionBy("run_id").orderBy("ts", "seq")
    fresh = F.when(F.col("ts").cast("timestamp").cast("long") - F.lag(F.col("ts").cast("timestamp").cast("long")).over(by) <= gap_seconds, 0).otherwise(1)
    marked = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(by))
    return marked.groupBy("run_id", "session").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "error").alias("errors"))
