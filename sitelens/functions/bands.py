"""Bands, floors, grades and labels of typed probabilistic answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECISIVE, YES, NO, GATE_FLOOR = 0.8, 0.8, 0.2, 0.5
#: The confidence at which an answer to a question is acted on, where it is not DECISIVE.
DECISIVE_BY_QUESTION = {"action": 0.75, "page_type": 0.85, "highest_impact_change": 0.88, "content_type_gap": 0.85, "cluster": 0.84, "intent": 0.82, "primary_cta": 0.78, "answer_engine_gaps": 0.85, "ai_gap": 0.85}
#: The mass on one side of the middle at which a score is acted on.
SCORE_MASS_BY_QUESTION = {"paragraph_citability": 0.75, "internal_link_adequacy": 0.85, "scan_path": 0.85, "topic_authority": 0.85, "site_freshness": 0.85, "author_evidence": 0.82, "brand_entity": 0.85, "entity_relations": 0.85, "claim_support": 0.85, "source_attribution": 0.85, "entity_density": 0.8, "topic_reach": 0.82, "difficulty_proxy": 0.85}
#: The floor of a gate, where it is not GATE_FLOOR.
GATE_FLOOR_BY_QUESTION = {"above_fold_promise": 0.6, "competitor_distinctiveness": 0.45, "extractable_format": 0.4, "defines_key_terms": 0.45, "trust_bar": 0.5}
#: What a finding of each severity costs.
SEVERITY_WEIGHT = {"critical": 18, "serious": 9, "moderate": 4, "minor": 1}


def lookup(question: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[question], F.lit(default))


def band_choice(question: Column, confidence: Column) -> Column:
    return F.when(confidence >= lookup(question, DECISIVE_BY_QUESTION, DECISIVE), "act").when(confidence >= NO, "review").otherwise("escalate")


def band_noul(p: Column) -> Column:
    return F.when((p >= YES) | (p <= NO), "act").otherwise("review")


def gate_floor(question: Column) -> Column:
    return lookup(question, GATE_FLOOR_BY_QUESTION, GATE_FLOOR)


def normalise_score(score: Column, levels: Column) -> Column:
    return score / F.greatest(levels - 1, F.lit(1))


def side_mass(probabilities: Column, levels: int) -> Column:
    """Struct (above, below): the mass of a map of levels above the middle, and at or below it."""
    middle = (levels - 1) / 2
    total = lambda above: F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda a, e: a + F.when((e["key"].cast("double") > middle) == above, e["value"]).otherwise(0.0))
    return F.struct(total(True).alias("above"), total(False).alias("below"))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 72, "B").when(score >= 58, "C").when(score >= 42, "D").otherwise("E")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def priority_label(p: Column) -> Column:
    return F.when(p >= 0.55, "P1").when(p >= 0.3, "P2").otherwise("P3")


def band_word(band: Column, needs_human: Column) -> Column:
    """The band in words; who needs a person outranks it. Null stays null."""
    return F.when(band.isNull(), None).when((band == "escalate") | needs_human, "needs a human").when(band == "act", "decisive").otherwise("to verify")
