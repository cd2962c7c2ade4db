"""Queries of run history and of research output, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as P
from ..sources import history as H
from ..streaming.sink import fresh_folder
from .catalog import query
from .fixtures import frame, with_adapters

# ---- history ---------------------------------------------------------------------------------------------------------


@query("write_history", with_adapters("SELECT concat('https://', lower(root), '.example') AS root, r.run_no, count(*) AS pages, count(*) FILTER (raised) AS raised FROM fx_runs f JOIN (SELECT unnest(range(1, 13)) AS run_no) r ON f.run_no = 1 AND (r.run_no BETWEEN 3 AND 12 AND length(root) % 2 = 1 OR right(root, 1) >= '5' AND r.run_no <= 4 AND length(root) % 2 = 0 OR right(root, 1) < '5' AND length(root) % 2 = 0 AND r.run_no BETWEEN 2 AND 11) GROUP BY root, r.run_no"))
def _history(spark, folder):
    """Twelve appends, one of them twice: roots that all runs have, roots of the first four runs, roots of the first eleven."""
    runs = frame(spark, folder, "fx_runs").filter("run_no = 1").withColumn("root", F.col("root"))
    path = fresh_folder(spark, "history")
    for k in [*range(1, 6), 5, *range(6, 13)]:
        odd = F.length("root") % 2 == 1
        here = odd | (~odd & (F.right("root", F.lit(1)) >= "5") & F.lit(k <= 4)) | (~odd & (F.right("root", F.lit(1)) < "5") & F.lit(k <= 11))
        part = runs.filter(here).select(F.concat(F.lit("https://"), "root", F.lit(".example/start?x=1")).alias("root"), F.lit(k).cast("long").alias("run_no"), "path", "raised")
        H.write_history(part.withColumn("root", H.origin(F.col("root"))), path)
    return H.read_history(spark, path, part.schema).groupBy("root", "run_no").agg(F.count("*").alias("pages"), F.count_if("raised").alias("raised"))


# ---- research output -------------------------------------------------------------------------------------------------

_EXPECTED = [
    (0, "", "not_json"), (1, "", "not_an_object"), (2, "verdict", "unknown_key"),
    (3, "business_name", "empty"), (3, "business_summary", "wrong_type"), (3, "market", "missing"), (3, "competitors", "wrong_type"), (3, "notes.1", "wrong_type"),
    (4, "competitors.0.angle", "missing"), (4, "keyword_seeds.0.score", "unknown_key"), (4, "keyword_seeds.0.intent", "not_allowed"),
    (5, "keyword_seeds.0", "wrong_type"), (5, "metrics.0.number.value", "wrong_type"), (5, "metrics.0.number.source_tool", "empty"), (5, "metrics.1.number", "wrong_type"), (5, "notes", "wrong_type"),
]
_ROWS = ", ".join(str(x) for x in _EXPECTED)
query("research_schema_check", with_adapters(f"SELECT run_id, item_id, path, issue FROM fx_research JOIN (VALUES {_ROWS}) AS e(variant, path, issue) USING (variant)"))(lambda s, f: P.research_schema_check(frame(s, f, "fx_research")))
_CALLED = "called AS (SELECT DISTINCT run_id, type AS tool FROM fx_events WHERE cost > 220)"
_SOUND = "sound AS (SELECT run_id, item_id, output FROM fx_research WHERE variant >= 6)"
_CLAIMS = """claims AS (SELECT run_id, item_id, 'competitor' AS kind, x ->> '$.name' AS name, lower(trim(x ->> '$.evidence_tool')) AS tool FROM (SELECT run_id, item_id, unnest(json_extract(output, '$.competitors[*]')) AS x FROM sound) a
 UNION ALL SELECT run_id, item_id, 'keyword', x ->> '$.term', lower(trim(x ->> '$.evidence_tool')) FROM (SELECT run_id, item_id, unnest(json_extract(output, '$.keyword_seeds[*]')) AS x FROM sound) b)"""


@query("flagged_evidence", with_adapters(f"WITH {_CALLED}, {_SOUND}, {_CLAIMS} SELECT c.* FROM claims c WHERE NOT EXISTS (SELECT 1 FROM called k WHERE k.run_id = c.run_id AND k.tool = c.tool) UNION ALL SELECT run_id, item_id, 'metric', x ->> '$.key', x ->> '$.number.source_tool' FROM (SELECT run_id, item_id, unnest(json_extract(output, '$.metrics[*]')) AS x FROM sound) m WHERE NOT contains(regexp_replace(x ->> '$.number.raw', '[^0-9]', '', 'g'), regexp_replace(x ->> '$.number.value', '[^0-9]', '', 'g'))"))
def _flagged(spark, folder):
    calls = frame(spark, folder, "fx_events").filter("cost > 220").select("run_id", F.col("type").alias("tool"))
    outputs = frame(spark, folder, "fx_research")
    sound = outputs.join(P.research_schema_check(outputs).select("item_id").distinct(), "item_id", "left_anti")
    return P.flagged_evidence(sound, calls)
