"""Evaluation tables: the score sheet, judgements and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["grounding", "reasoning", "completeness", "uncertainty", "usefulness", "traceability", "efficiency"]


def score_sheet(questions: DataFrame, systems: list[str], outputs: DataFrame | None = None) -> DataFrame:
    """One row per question and system, with run figures where there are some. systems is a short constant list."""
    sheet = questions.withColumn("system", F.explode(F.array(*(F.lit(s) for s in systems))))
    return sheet.join(outputs, ["question_id", "system"], "left") if outputs is not None else sheet


def judged(sheet: DataFrame, judgements: DataFrame, overwrite: bool = False) -> DataFrame:
    """sheet with blanks (or all scores) filled from judgements; scores outside 1..5 don't count."""
    ok = lambda m: F.when(F.col(f"j.{m}").between(1, 5), F.col(f"j.{m}"))
    rows = sheet.alias("s").join(judgements.alias("j"), ["question_id", "system"], "left")
    own = [c for c in sheet.columns if c not in METRICS]
    filled = [F.coalesce(ok(m), F.col(f"s.{m}")) if overwrite else F.coalesce(F.col(f"s.{m}"), ok(m)) for m in METRICS]
    return rows.select(*(F.col(c) if c in ("question_id", "system") else F.col(f"s.{c}") for c in own), *(f.alias(m) for f, m in zip(filled, METRICS, strict=True)))


def means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """system, task_type ('all' for the system's total) and the mean of each readable column to three places."""
    number = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("double")
    out = rows.groupingSets([[F.col("system")], [F.col("task_type"), F.col("system")]], "task_type", "system")
    out = out.agg(F.grouping("task_type").alias("g"), *(F.round(F.avg(number(c)), 3).alias(c) for c in columns))
    return out.select("system", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("task_type")).alias("task_type"), *columns)
