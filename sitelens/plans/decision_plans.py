"""Queries of exports, provenance and throughput, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import half_up_sql as h
from ..operators import decisions as D
from .audit_plans import over
from .judgement_plans import DECIDED_SQL, decided, judged

judged("export_decisions_csv", f"WITH {DECIDED_SQL} SELECT site, item_id, concat(change, ',', CAST(priority AS VARCHAR), ',', CASE WHEN item_id % 2 = 0 THEN '''=new' ELSE '\"old, \"\"still\"\"\"' END) AS line FROM dec")(lambda fx: D.export_decisions_csv(decided(fx), fx("items").select("site", "item_id", F.when(F.col("item_id") % 2 == 0, "=new").otherwise('old, "still"').alias("state"))))
over("throughput", "fx_events", f"SELECT run_id, judged, seconds, CASE WHEN seconds > 0 THEN {h('judged / CAST(seconds AS DOUBLE)', 6)} END AS per_second FROM (SELECT run_id, count(*) FILTER (type IN ('page-done', 'keyword-done', 'gap-done')) AS judged, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS seconds FROM fx_events GROUP BY run_id) x")(D.throughput)
over("ungranted_tool_calls", "fx_events", "SELECT DISTINCT run_id, type AS tool FROM fx_events e WHERE NOT EXISTS (SELECT 1 FROM fx_events g WHERE g.run_id = e.run_id AND g.type = e.type AND g.cost > 220)")(lambda e: D.ungranted_tool_calls(e.select("run_id", F.col("type").alias("tool")), e.filter("cost > 220").select("run_id", F.col("type").alias("tool")).distinct()))
over("unsourced_metrics", "fx_events", "SELECT seq, run_id, type AS tool FROM fx_events e WHERE seq % 10 = 0 AND NOT EXISTS (SELECT 1 FROM fx_events g WHERE g.run_id = e.run_id AND g.type = e.type AND g.cost > 220)")(lambda e: D.unsourced_metrics(e.filter("seq % 10 = 0").select("seq", "run_id", F.col("type").alias("tool")), e.filter("cost > 220").select("run_id", F.col("type").alias("tool"))))
