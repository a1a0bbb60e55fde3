"""Review priority: explainable components, their sum and a level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENT, HIGH, MEDIUM = 0.9, 0.66, 0.33


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").when(score > 0, "low").otherwise("none")


def components(confidence: Column, disagreement: Column, missing: Column, ambiguous: Column) -> dict[str, Column]:
    """Each signal's contribution; a null confidence is no signal, not a low one."""
    low = F.when(confidence < CONFIDENT, F.least(F.lit(1.0), (F.lit(CONFIDENT) - confidence) / CONFIDENT)).otherwise(0.0)
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return {"low_confidence": F.coalesce(low, F.lit(0.0)), "disagreement": flag(disagreement), "missing_layer": flag(missing), "ambiguous": flag(ambiguous)}


def score(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for part in parts.values():
        total = total + part
    return F.least(F.lit(1.0), total)
