"""Number parsing, scores and levels as Column functions.

Three parsers exist on purpose: risk analytics accepts whole parses only, forecasts take the
first number in a text, graph scores default to zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_float(c: Column) -> Column:
    """A whole parse after commas and one trailing percent sign go; else null. NaN numbers are null."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), ",", ""), "%$", "")
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def numeric(c: Column) -> Column:
    """A column that is a number already, with NaN as null: no text round trip."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def forecast_float(c: Column) -> Column:
    """The first finite number in a text."""
    text = F.regexp_replace(F.trim(c.cast("string")), ",", "")
    value = F.nullif(F.regexp_extract(text, r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def graph_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def clamp(c: Column, low: float, high: float, default: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(c.cast("double"), F.lit(float(default)))))


def _bands(c: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    out = F.lit(rest)
    for cut, name in reversed(cuts):
        out = F.when(c >= cut, F.lit(name)).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    return _bands(score, [(71, "severe"), (41, "high"), (21, "moderate")], "low")


def confidence_level(score: Column) -> Column:
    return _bands(score, [(75, "high"), (45, "moderate")], "low")


def concentration_level(top1: Column, hhi: Column) -> Column:
    out = F.lit("low")
    for share, index, name in ((40, 1500, "moderate"), (60, 2500, "high"), (80, 5000, "severe")):
        out = F.when((top1 >= share) | (hhi >= index), F.lit(name)).otherwise(out)
    return out


def raw_risk(severity: Column, likelihood: Column, exposure: Column) -> Column:
    return severity * likelihood * exposure / F.lit(125.0) * F.lit(100.0)


def adjusted_risk(raw: Column, mitigation: Column) -> Column:
    """Mitigation takes off up to four fifths."""
    return raw * (F.lit(1.0) - (mitigation - F.lit(1.0)) / F.lit(5.0))
