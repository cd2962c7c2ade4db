"""Typed answers from replies in JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "type string, choice string, score double, noul double, confidence double, probabilities map<string,double>"


def _kind(v: Column) -> Column:
    """``string``, ``number`` or something else, as the text has it."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", "string").when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "number").otherwise("other")


def _number(v: Column, path: str, default: float) -> Column:
    """A number, also one written as text; the default where there is none."""
    found = F.try_variant_get(v, path, "string")
    return F.coalesce(found.try_cast("double"), F.lit(default))


def read_answers(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies (scope, site, item_id, reply), each an object of answers by question: (answers, rejected).

    An answer is a choice, a score or a noul by its ``type``, or without one by which of these fields it has; numbers may be
    written as text, what is missing is 0 or ''. ``rejected`` has a row for each reply that is no object of JSON (question_id
    null, reason ``reply``) and for each value that is no answer (``not an object``, ``no type``). Repeated replies stay.
    """
    key = ["scope", "site", "item_id"]
    parsed = replies.select(*key, F.from_json("reply", "map<string,variant>").alias("m"))
    bad = parsed.filter("m IS NULL").select(*key, F.lit(None).cast("string").alias("question_id"), F.lit("reply").alias("reason"))
    each = parsed.select(*key, F.explode("m").alias("question_id", "v"))
    said = F.lower(F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("")))
    has = lambda name, kind: F.coalesce(_kind(F.try_variant_get("v", f"$.{name}", "variant")) == kind, F.lit(False))
    kind = F.when((said == "choice") | has("choice", "string"), "choice").when((said == "score") | has("score", "number"), "score").when((said == "noul") | has("noul", "number"), "noul")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    typed = each.withColumns({"object": is_object, "type": F.when(is_object, kind)})
    lost = typed.filter("type IS NULL").select(*key, "question_id", F.when(F.col("object"), "no type").otherwise("not an object").alias("reason"))
    only = lambda kinds, value: F.when(F.col("type").isin(kinds), value)
    probabilities = F.coalesce(F.try_variant_get("v", "$.probabilities", "map<string,double>"), F.create_map().cast("map<string,double>"))
    answers = typed.filter("type IS NOT NULL").select(
        *key, "question_id", "type",
        only(["choice"], F.coalesce(F.try_variant_get("v", "$.choice", "string"), F.lit(""))).alias("choice"), only(["score"], _number("v", "$.score", 0.0)).alias("score"), only(["noul"], _number("v", "$.noul", 0.0)).alias("noul"),
        only(["choice", "score"], _number("v", "$.confidence", 0.0)).alias("confidence"), only(["choice", "score"], probabilities).alias("probabilities"),
    )
    return answers, bad.unionByName(lost)
