"""Queries that run the streaming operators over the events and give the same rows as plain SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..streaming import sink as K
from ..streaming import stateful as T
from ..streaming import streams as S
from .catalog import oracle_sql, query
from .fixtures import frame, with_adapters


def in_parts(spark, folder: str, build, **table):
    """Runs a stream over the events in three runs from one checkpoint, written as lines of JSON before each: the first half
    by time; the second half, with the end of the first again; a beat two days later that moves the watermark past all."""
    events = frame(spark, folder, "fx_events").select(F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "run_id", "type", "item_key", "cost")
    middle, last = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5).alias("m"), F.max("ts").alias("l")).first()
    at = F.unix_micros("ts")
    beat = [(None, last + timedelta(days=2), None, kind, None, None) for kind in ("page-start", "page-done")] if last else []
    parts = [events.filter(at <= middle), events.filter(at > middle - 60_000_000), spark.createDataFrame(beat, events.schema)]
    base = K.fresh_folder(spark, "events")
    with T.keyed_state(spark):
        for i, part in enumerate(parts):
            part.coalesce(4).selectExpr("to_json(struct(*), map('timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")) AS value").write.text(f"{base}/lines/part={i}")
            found = K.run_to_table(build(S.read_event_lines(spark, f"{base}/lines").drop("bad")), f"{base}/out", **table)
    return found.read().filter("run_id is not null")


_WITHIN = "d.run_id = s.run_id AND d.item_key = s.item_key AND d.ts >= s.ts AND d.ts <= s.ts + INTERVAL 2 HOUR"
_SIDES = "s AS (SELECT * FROM fx_events WHERE type = 'page-start'), d AS (SELECT * FROM fx_events WHERE type = 'page-done')"
query("stream_live_counters", oracle_sql()["live_counters"])(lambda s, f: in_parts(s, f, S.live_counters, mode="complete", keys=["run_id"]))
query("stream_latest_by_key", oracle_sql()["latest_by_key"])(lambda s, f: in_parts(s, f, S.latest_by_key, keys=["run_id", "item_key"], order=["seq"]))
query("stream_event_windows", oracle_sql()["event_windows"])(lambda s, f: S.drain(S.event_windows(S.read_events(s, f))))
query("stream_sessions", "SELECT run_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM (SELECT *, concat('run', CAST(user_id % 20 AS VARCHAR)) AS run_id FROM events) e) a) b GROUP BY run_id, session")(lambda s, f: S.drain(S.session_counters(S.read_events(s, f))))
query("stream_pending_items", with_adapters(f"WITH {_SIDES} SELECT run_id, item_key, seq AS started FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE {_WITHIN})"))(lambda s, f: in_parts(s, f, S.pending_items))
query("stream_rival_slots", with_adapters(f"WITH {_SIDES} SELECT coalesce(s.run_id, d.run_id) AS run_id, coalesce(s.item_key, d.item_key) AS item_key, s.seq AS started, d.seq AS done FROM s FULL JOIN d ON {_WITHIN}"))(lambda s, f: in_parts(s, f, S.rival_slots))
query("stream_recent_log", oracle_sql()["recent_log"])(lambda s, f: in_parts(s, f, T.recent_log, mode="update", keys=["run_id"]))
query("read_event_lines", with_adapters("SELECT run_id, type, count(*) AS n, min(seq) AS first_seq FROM fx_events GROUP BY run_id, type"))(lambda s, f: in_parts(s, f, lambda e: e.select("run_id", "type", "seq"), keys=["run_id", "seq"], order=["type"]).groupBy("run_id", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")))
