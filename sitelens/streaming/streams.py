"""Structured Streaming forms of the event operators: unbounded input, keyed state, watermarks.

Each function takes a streaming frame of events (seq, ts, run_id, type, item_key, cost) and returns a streaming frame; ``drain``
runs one over all that there is and gives the result as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sink import fresh_folder, run_to_table


#: The audit's event log as lines of JSON.
EVENT_SCHEMA = "seq long, ts timestamp, run_id string, type string, item_key string, cost double"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream, in the form of the audit's event log."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(folder)
    kind = F.create_map(*map(F.lit, ["view", "page-start", "click", "page-done", "signup", "keyword-done", "purchase", "gap-done"]))[F.col("event_type")]
    return raw.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("run"), F.col("user_id") % 20).alias("run_id"), F.coalesce(kind, F.lit("error")).alias("type"), F.concat(F.lit("i"), "user_id", F.lit("."), F.col("event_id") % 37).alias("item_key"), F.col("value").alias("cost"))


def read_event_lines(spark: SparkSession, path: str, *, stream: bool = True) -> DataFrame:
    """Events from files with one JSON object a line, as a stream or a table; ``bad`` holds a line that is none, else null.

    Fields that a line lacks are null; so are those of a line that does not parse.
    """
    lines = (spark.readStream if stream else spark.read).format("text").load(path).filter("trim(value) <> ''")
    parsed = F.from_json("value", EVENT_SCHEMA + ", bad string", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("e")).select("e.*")


def live_counters(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and cost of each run. An event that comes again counts once: while the watermark has not passed it, it is known
    by run and seq, and after that it is too late."""
    n = lambda t: F.count_if(F.col("type") == t)
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])
    return once.groupBy("run_id").agg(n("page-done").alias("pages"), n("keyword-done").alias("keywords"), n("gap-done").alias("gaps"), n("error").alias("errors"), F.sum(F.col("cost").cast("decimal(18,8)")).cast("double").alias("cost"))


def latest_by_key(events: DataFrame) -> DataFrame:
    """Events by item, for a table of keys (run_id, item_key) and order seq: the sink keeps each item's last, replays change nothing."""
    return events.select("run_id", "item_key", "type", "seq")


def _side(events: DataFrame, kind: str, late: str) -> DataFrame:
    """Events of one type, each once while the watermark has not passed it."""
    own = events.select("run_id", "item_key", "seq", "ts", "type").withWatermark("ts", late).filter(F.col("type") == kind)
    return own.dropDuplicatesWithinWatermark(["run_id", "item_key", "seq", "ts"])


def rival_slots(events: DataFrame, wait: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(run_id, item_key, started, done): starts with what finished them within ``wait``; lone starts and lone ends once the watermark passed them.

    A full outer join of two streams. The time range bounds both states: an end is kept until no start from before it can
    come, a start until no end within ``wait`` can. An event that comes again counts once, as in ``live_counters``.
    """
    side = lambda kind, *names: _side(events, kind, late).select(*[F.col(c).alias(n) for c, n in zip(("run_id", "item_key", "seq", "ts"), names, strict=True)])
    a, b = side("page-start", "r1", "i1", "started", "t1"), side("page-done", "r2", "i2", "done", "t2")
    met = a.join(b, F.expr(f"r1 = r2 AND i1 = i2 AND t2 >= t1 AND t2 <= t1 + INTERVAL {wait}"), "full_outer")
    return met.select(F.coalesce("r1", "r2").alias("run_id"), F.coalesce("i1", "i2").alias("item_key"), "started", "done")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows; events later than the watermark do not count."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "type", "n")


def session_counters(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Events and errors of each session of a run."""
    return events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("type") == "error").alias("errors")).select("run_id", F.unix_timestamp("s.start").alias("start"), "n", "errors")


def pending_items(events: DataFrame, wait: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Starts whose item is not done within ``wait``: a left outer join of two streams, bounded by watermarks. An event that comes again counts once."""
    a = _side(events, "page-start", late).select("run_id", "item_key", F.col("seq").alias("started"), F.col("ts").alias("t1"))
    b = _side(events, "page-done", late).select(F.col("run_id").alias("r"), F.col("item_key").alias("i"), F.col("seq").alias("done"), F.col("ts").alias("t2"))
    return a.join(b, F.expr(f"run_id = r and item_key = i and t2 >= t1 and t2 <= t1 + interval {wait}"), "left_outer").filter("done is null").select("run_id", "item_key", "started")


def drain(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is now and gives the result as a table: in mode ``complete`` the state after the last batch."""
    folder = fresh_folder(stream.sparkSession, "stream")
    if mode == "complete":  # every batch gives all rows, so the last one replaces the others
        return run_to_table(stream.withColumn("_all", F.lit(1)), folder, mode=mode, keys=["_all"]).read().drop("_all")
    return run_to_table(stream, folder, mode=mode, keys=keys, order=order).read()
