"""Confidence and review flags of occurrences as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions import law


def confidence(stage: Column) -> Column:
    head = F.substring_index(stage, ":", 1)
    table = F.create_map(*[F.lit(x) for pair in law.CONFIDENCE.items() for x in pair])
    return F.coalesce(F.element_at(table, stage), F.element_at(table, head), F.lit(0.0))


def reason(classification: Column, stage: Column) -> Column:
    weak = confidence(stage) < law.LOW_CONFIDENCE
    return (
        F.when(classification == "czech_unresolved", "unresolved").when(classification == "foreign_law", "foreign_law").when(weak & stage.contains("Ambiguous"), "ambiguous_alias")
        .when(weak & stage.contains("Short Structural"), "short_structural_reference").when(weak & stage.rlike("Carryover|Implicit Generic"), "weak_contextual_evidence").when(weak, "low_confidence")
    )


def flag(classification: Column, stage: Column) -> Column:
    return reason(classification, stage).isNotNull()
