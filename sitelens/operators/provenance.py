"""Research output of agents: whether it keeps to its schema, and which claims no tool call stands behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import raw_contains_value

#: The fields of each object. ``text`` is a string with something in it, ``text?`` may be null.
COMPETITOR = {k: "text" for k in ("name", "url", "why", "evidence_tool", "evidence_query", "angle")}
SEED = {"term": "text", "intent": "intent", "evidence_tool": "text"}
NUMBER = {"value": "number", "source_tool": "text", "raw": "text"}
METRIC = {"key": "text", "label": "text", "number": NUMBER}
RESEARCH = {"business_name": "text?", "business_summary": "text?", "market": "text?", "competitors": [COMPETITOR], "keyword_seeds": [SEED], "metrics": [METRIC], "notes": ["string"]}
INTENTS = "informational commercial transactional navigational unknown".split()

_ISSUES = "array<struct<path:string,issue:string>>"
OUTPUT = (
    "business_name string, business_summary string, market string, competitors array<struct<name:string,url:string,why:string,evidence_tool:string,evidence_query:string,angle:string>>, "
    "keyword_seeds array<struct<term:string,intent:string,evidence_tool:string>>, metrics array<struct<key:string,label:string,number:struct<value:string,source_tool:string,raw:string>>>, notes array<string>"
)


def _issue(path: Column, name: str) -> Column:
    return F.struct(path.alias("path"), F.lit(name).alias("issue"))


def _value_issues(v: Column, spec, path: Column) -> Column:
    """Issues of a value that is there, null of JSON included."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    none = F.array().cast(_ISSUES)
    wrong = F.array(_issue(path, "wrong_type"))
    if isinstance(spec, dict):
        return F.when(kind.startswith("OBJECT"), _object_issues(v, spec, F.concat(path, F.lit(".")), strict=spec is not NUMBER)).otherwise(wrong)
    if isinstance(spec, list):
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _value_issues(x, spec[0], F.concat(path, F.lit("."), i.cast("string"))))
        return F.when(kind.startswith("ARRAY"), F.coalesce(F.flatten(each), none)).otherwise(wrong)
    if spec == "number":
        return F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), none).otherwise(wrong)
    text = F.try_variant_get(v, "$", "string")
    found = F.when(kind != "STRING", wrong)
    if spec == "text?":
        found = F.when(kind == "VOID", none).when(kind != "STRING", wrong)
    if spec == "intent":
        found = found.when(~text.isin(INTENTS), F.array(_issue(path, "not_allowed")))
    elif spec != "string":
        found = found.when(text == "", F.array(_issue(path, "empty")))
    return found.otherwise(none)


def _object_issues(v: Column, fields: dict, prefix: Column, strict: bool) -> Column:
    keys = F.json_object_keys(F.to_json(v))
    parts = [F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.struct(F.concat(prefix, k).alias("path"), F.lit("unknown_key").alias("issue")))] if strict else []
    for name, spec in fields.items():
        path = F.concat(prefix, F.lit(name))
        parts.append(F.when(F.array_contains(keys, name), _value_issues(F.try_variant_get(v, f"$.{name}", "variant"), spec, path)).otherwise(F.array(_issue(path, "missing"))))
    return F.concat(*parts)


def research_schema_check(outputs: DataFrame) -> DataFrame:
    """(run_id, item_id, path, issue) of outputs (run_id, item_id, output): one row for each way that one departs from the schema.

    ``not_json`` or ``not_an_object`` for the whole (path ''), ``unknown_key``, ``missing``, ``wrong_type``, ``empty`` or
    ``not_allowed`` for a place in it; places in lists are numbered from 0. A figure alone may have keys of its own. An
    output that keeps to the schema has no row.
    """
    v = F.try_parse_json("output")
    whole = F.lit("")
    issues = F.when(F.col("v").isNull(), F.array(_issue(whole, "not_json"))).when(~F.schema_of_variant("v").startswith("OBJECT"), F.array(_issue(whole, "not_an_object"))).otherwise(_object_issues(F.col("v"), RESEARCH, whole, strict=True))
    return outputs.select("run_id", "item_id", v.alias("v")).select("run_id", "item_id", F.explode(issues).alias("i")).select("run_id", "item_id", "i.path", "i.issue")


def flagged_evidence(outputs: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, item_id, kind, name, tool) of outputs that keep to the schema and calls (run_id, tool).

    ``competitor`` and ``keyword`` cite a tool that made no call in the run (case and outer spaces apart); ``metric`` has a raw
    text without the digits of its value. Repeated claims are repeated rows.
    """
    read = outputs.select("run_id", "item_id", F.from_json("output", OUTPUT).alias("o"))
    rivals = read.select("run_id", "item_id", F.explode("o.competitors").alias("x")).select("run_id", "item_id", F.lit("competitor").alias("kind"), F.col("x.name").alias("name"), F.lower(F.trim("x.evidence_tool")).alias("tool"))
    seeds = read.select("run_id", "item_id", F.explode("o.keyword_seeds").alias("x")).select("run_id", "item_id", F.lit("keyword").alias("kind"), F.col("x.term").alias("name"), F.lower(F.trim("x.evidence_tool")).alias("tool"))
    called = calls.select("run_id", F.lower("tool").alias("tool")).distinct()
    metrics = read.select("run_id", "item_id", F.explode("o.metrics").alias("x")).filter(~raw_contains_value(F.col("x.number.raw"), F.col("x.number.value")))
    restated = metrics.select("run_id", "item_id", F.lit("metric").alias("kind"), F.col("x.key").alias("name"), F.lower(F.trim("x.number.source_tool")).alias("tool"))
    return rivals.unionByName(seeds).join(called, ["run_id", "tool"], "left_anti").select("run_id", "item_id", "kind", "name", "tool").unionByName(restated)
