"""What a reader sees of an investigation: overall risk, gaps, evidence cards, coverage and tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.answers import clean_answer, short_text
from riskloom.functions.records import filled, first_text
from riskloom.functions.text import normalize, objective_score

# Words that speak of a high, critical or low risk, statuses of an assessment that never ran, labels of metrics.
STRONG = ["exposure high", "high exposure", "supply shortages", "shortages", "price volatility", "major disruption", "critical upstream"]
CRITICAL = ["critical", "severe", "major disruption"]
HIGH = ["exposure high", "high exposure", "high risk", "supply shortages", "shortages", "price volatility", "critical upstream"]
LOW = ["low risk", "limited risk", "limited exposure"]
NOT_RUN = ["disabled", "unavailable", "failed", "not_run"]


def _says(text: Column, words: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def overall_risk(explicit: Column, summary: Column, answer: Column, factor_mean: Column, status: Column) -> Column:
    """The risk given, raised to High where the text speaks of more; else by the text, the mean of the factors, the status."""
    text = normalize(F.concat_ws(" ", summary, clean_answer(answer)))
    given = F.initcap(F.trim(F.coalesce(explicit, F.lit(""))))
    raised = F.when(given.isin("Low", "Medium", "Moderate") & _says(text, STRONG), F.lit("High")).otherwise(given)
    by_text = F.when(_says(text, CRITICAL), F.lit("Critical")).when(_says(text, HIGH), F.lit("High")).when(_says(text, LOW), F.lit("Low"))
    by_mean = F.when(factor_mean >= 70, F.lit("High")).when(factor_mean >= 40, F.lit("Moderate")).when(factor_mean.isNotNull(), F.lit("Low"))
    by_status = F.when(F.lower(F.coalesce(status, F.lit(""))).isin(NOT_RUN), F.lit("Not Run")).otherwise(F.lit("Moderate"))
    return F.when(given != "", raised).otherwise(F.coalesce(by_text, by_mean, by_status))


def factor_bar(adjusted: Column, raw: Column, severity: Column) -> tuple[Column, Column]:
    """A factor's bar of 0..100 and its tone: the first of its scores other than zero; up to 5 they count as fifths."""
    value = F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in (adjusted, raw, severity)), F.lit(0.0))
    value = F.when(value <= 5, value * 20).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(value, 1))), F.when(value >= 70, F.lit("high")).otherwise(F.lit("medium"))


def gaps(missing: DataFrame, by: str, order: str, item: str, forecast_missing: Column, unread: Column, most: int = 8) -> DataFrame:
    """by, total, items: distinct missing items in order, then what forecasts and unread documents lack; the first `most` are shown.

    forecast_missing and unread are booleans of the rows of missing, the same in all rows of a group.
    """
    text = F.trim(F.coalesce(F.col(item), F.lit("")))
    rows = missing.select(by, F.col(order).alias("o"), text.alias("t"), forecast_missing.alias("f"), unread.alias("u"))
    once = rows.groupBy(by, "t").agg(F.min("o").alias("o"), F.max("f").alias("f"), F.max("u").alias("u"))
    known = once.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("o", "t")))).alias("x"), F.max("f").alias("f"), F.max("u").alias("u"))
    one = lambda c, t: F.when(c, F.array(F.lit(t))).otherwise(F.array().cast("array<string>"))
    items = F.concat(F.transform("x", lambda v: v["t"]), one(F.col("f"), "Usable time-series evidence for forecasting"), one(F.col("u"), "Automatic text extraction for one or more uploaded documents"))
    items = F.when(F.size(items) > 0, items).otherwise(F.array(F.lit("More direct evidence on downstream industry exposure")))
    return known.select(by, F.size(items).alias("total"), F.slice(items, 1, most).alias("items"))


def evidence_cards(ids: DataFrame, evidence: DataFrame, most: int = 360) -> DataFrame:
    """id, title, source, date, text: the cards of those ids that are known. evidence: evidence_id, page, source_title, source_date, text."""
    page = F.col("page").cast("string")
    return ids.select(F.col("evidence_id")).distinct().join(evidence, "evidence_id").select(
        F.col("evidence_id").alias("id"), F.when(F.coalesce(page, F.lit("")) != "", F.concat(F.lit("Page "), page)).otherwise(F.lit("Evidence excerpt")).alias("title"),
        F.coalesce(filled(first_text(F.col("source_title"))), F.lit("Attached source")).alias("source"), F.coalesce(filled(first_text(F.col("source_date"))), F.lit("Evidence block")).alias("date"), short_text(F.col("text"), most).alias("text"),
    )


def coverage(text: Column, objectives: dict[str, list[str]], threshold: float = 0.20) -> tuple[Column, Column]:
    """Ids of the objectives that a text covers, and of those that it leaves open."""
    score = {i: objective_score(text, F.array(*(F.lit(t) for t in terms))) for i, terms in objectives.items()}
    pick = lambda test: F.filter(F.array(*(F.when(test(s), F.lit(i)) for i, s in score.items())), lambda x: x.isNotNull())
    return pick(lambda s: s >= threshold), pick(lambda s: s < threshold)


def hint_matches(source: Column, hint: Column) -> Column:
    """Whether a source's text has the hint, or enough of its words (three, or all of fewer; one at least)."""
    hay, needle = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    parts = F.filter(F.split(F.translate(needle, "'-", "  "), r"\s+"), lambda w: w != "")
    found = F.size(F.filter(parts, lambda w: F.contains(hay, w)))
    return (needle == "") | F.contains(hay, needle) | (F.size(parts) == 0) | (found >= F.least(F.lit(3), F.size(parts)))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, type, n: the graph's schema as its entity and relation types with how many there are."""
    by = lambda df, c, kind: df.groupBy(F.col(c).alias("type")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return by(nodes, "entity_type", "entity").unionByName(by(edges, "relation", "relation"))


def latex_rows(means: DataFrame, metric: str, system: str, value: str, systems: list[str]) -> DataFrame:
    """metric, line: a table row with one cell per system, -- where there is no value."""
    cells = means.groupBy(metric).pivot(system, systems).agg(F.first(value))
    shown = [F.coalesce(F.col(f"`{s}`").cast("string"), F.lit("--")) for s in systems]
    return cells.select(metric, F.concat(F.concat_ws(" & ", F.col(metric), *shown), F.lit(" \\\\")).alias("line"))
