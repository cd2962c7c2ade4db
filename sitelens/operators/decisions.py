"""Export of decisions, provenance checks and throughput: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where it has to be."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def export_decisions_csv(decided: DataFrame, states: DataFrame) -> DataFrame:
    """One guarded line of each decision, with its movement since the last run."""
    return decided.join(states, ["site", "item_id"], "left").select("site", "item_id", F.concat_ws(",", *[F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in ("change", "priority", "state")]).alias("line"))


def write_decisions_csv(lines: DataFrame, path: str) -> None:
    """Writes the lines of ``export_decisions_csv`` as text by site, in order of the item; a path that is there is replaced.

    A site's lines are in one file unless they are more than a million, so each file is a table that a spreadsheet opens.
    """
    lines.repartition("site").sortWithinPartitions("site", "item_id").select("site", "line").write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("site").text(path)


def ungranted_tool_calls(calls: DataFrame, granted: DataFrame) -> DataFrame:
    """Calls (run_id, tool) of tools that a run was not granted."""
    return calls.select("run_id", "tool").distinct().join(granted, ["run_id", "tool"], "left_anti")


def unsourced_metrics(metrics: DataFrame, calls: DataFrame) -> DataFrame:
    return metrics.join(calls.select("run_id", "tool").distinct(), ["run_id", "tool"], "left_anti")


def throughput(events: DataFrame) -> DataFrame:
    """Judgements of each run a second between its first and last event."""
    seconds = F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))
    t = events.groupBy("run_id").agg(F.count_if(F.col("type").isin("page-done", "keyword-done", "gap-done")).alias("judged"), seconds.alias("seconds"))
    return t.select("run_id", "judged", "seconds", F.when(F.col("seconds") > 0, half_up(F.col("judged") / F.col("seconds"), 6)).alias("per_second"))
