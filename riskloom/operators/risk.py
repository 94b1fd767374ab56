"""Risk factors, scenarios and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numbers import adjusted_risk, clamp, confidence_level, raw_risk, risk_level


def score_factors(factors: DataFrame) -> DataFrame:
    """factors with raw_score, adjusted_score (rounded) and risk_level (of the unrounded score).

    Scores outside 1..5 are clamped; missing ones count 1, a missing confidence 3.
    """
    s = {c: clamp(F.col(c), 1, 5, 3 if c == "confidence" else 1) for c in ("severity", "likelihood", "exposure", "mitigation", "confidence")}
    out = factors.withColumns(s)
    raw = raw_risk(F.col("severity"), F.col("likelihood"), F.col("exposure"))
    adjusted = adjusted_risk(raw, F.col("mitigation"))
    return out.withColumns({"raw_score": F.round(raw, 2), "adjusted_score": F.round(adjusted, 2), "risk_level": risk_level(adjusted)})


def score_model(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, risk_score, risk_level: three fifths of the largest adjusted score, two of the mean of the top three."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("adjusted_score")))
    top = scored.withColumn("__r", rank).filter("__r <= 3").groupBy(*by).agg((F.lit(0.6) * F.max("adjusted_score") + F.lit(0.4) * F.avg("adjusted_score")).alias("overall"))
    return top.select(*by, F.round("overall", 2).alias("risk_score"), risk_level(F.col("overall")).alias("risk_level"))


def scenario_impact(exposure: Column, shock: Column, pass_through: Column) -> Column:
    return exposure * shock * pass_through


def confidence_score(evidence: Column, factors: Column, variables: Column, tables: Column, missing: Column, mean_confidence: Column) -> tuple[Column, Column]:
    """Score in 0..100 and its level; mean_confidence is null without factors."""
    part = lambda c, weight, most: F.least(F.lit(float(most)), c * F.lit(float(weight)))
    score = F.lit(20.0) + part(evidence, 5, 25) + part(factors, 4, 20) + part(variables, 5, 20) + part(tables, 4, 20) - part(missing, 4, 35)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score + F.coalesce(mean_confidence, F.lit(0.0))))
    return F.round(score, 2), confidence_level(score)
