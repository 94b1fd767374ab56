"""Time-series analytics over (date, value) rows, for one series or many at once.

A series is the rows with equal `by` columns. Windows run over months of a series, and what
one month must know of those before it comes from one row per month: no task sorts a whole
series. Rows of one date keep their input order, given by `order` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.dates import to_day
from riskloom.operators.tables import value_of

MONTH = "__month"


def observations(df: DataFrame, date: str, value: str, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """by, day, value, and seq (a struct that orders the rows of a series) of rows with a date."""
    day = to_day(F.col(date), df.schema[date].dataType)
    seq = F.struct(F.col(date).alias("at"), *(F.col(c) for c in order or []))
    return df.select(*(by or []), day.alias("day"), value_of(df, value).alias("value"), seq.alias("seq")).filter("day IS NOT NULL")


def time_series_summary(df: DataFrame, date: str, by: list[str] | None = None) -> DataFrame:
    day = to_day(F.col(date), df.schema[date].dataType)
    return df.select(*(by or []), day.alias("day")).filter("day IS NOT NULL").groupBy(*(by or [])).agg(F.count("*").alias("observation_count"), F.min("day").alias("start_date"), F.max("day").alias("end_date"))


def percent_change(obs: DataFrame, start: str | None = None, end: str | None = None, by: list[str] | None = None) -> DataFrame:
    """start_date, end_date, start_value, end_value, absolute_change, percent_change.

    Without a date the first (last) row counts even if its value is null; with one, the first
    non-null value at or after it (the last at or before it).
    """
    row = F.struct("seq", "day", "value")
    first = F.min(F.when(F.col("value").isNotNull() & (F.col("day") >= F.lit(start).cast("date")), row) if start else row)
    last = F.max(F.when(F.col("value").isNotNull() & (F.col("day") <= F.lit(end).cast("date")), row) if end else row)
    ends = obs.groupBy(*(by or [])).agg(first.alias("a"), last.alias("b"))
    change = F.col("b.value") - F.col("a.value")
    return ends.select(
        *(by or []),
        F.col("a.day").alias("start_date"),
        F.col("b.day").alias("end_date"),
        F.col("a.value").alias("start_value"),
        F.col("b.value").alias("end_value"),
        change.alias("absolute_change"),
        F.when(F.col("a.value") != 0, F.lit(100.0) * change / F.col("a.value")).alias("percent_change"),
    )


def window_mean(low: str, high: str) -> Column:
    """Aggregate: the mean of values on days from low to high."""
    return F.avg(F.when(F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date")), F.col("value")))


def window_change(obs: DataFrame, baseline: tuple[str, str], shock: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    out = obs.groupBy(*(by or [])).agg(window_mean(*baseline).alias("baseline_mean"), window_mean(*shock).alias("shock_mean"))
    change = F.col("shock_mean") - F.col("baseline_mean")
    return out.withColumns({"absolute_change": change, "percent_change": F.when(F.col("baseline_mean") != 0, F.lit(100.0) * change / F.col("baseline_mean"))})


def _with_carry(obs: DataFrame, carry: Column, by: list[str]) -> DataFrame:
    """obs with the month, and `carry` aggregated over each earlier month kept as a list of one row per month."""
    rows = obs.withColumn(MONTH, F.trunc("day", "month"))
    months = rows.groupBy(*by, MONTH).agg(carry.alias("__own"))
    return rows, months


def period_changes(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, day, seq, value, change_pct against the previous non-null value; null where there is none or it is 0."""
    by = by or []
    rows, months = _with_carry(obs.filter("value IS NOT NULL"), F.max_by("value", "seq"), by)
    before = Window.partitionBy(*by).orderBy(MONTH)  # one row per month
    months = months.select(*by, MONTH, F.lag("__own").over(before).alias("__before"))
    rows = rows.join(months, [*by, MONTH])
    previous = F.coalesce(F.lag("value").over(Window.partitionBy(*by, MONTH).orderBy("seq")), F.col("__before"))
    change = F.when(previous != 0, F.lit(100.0) * (F.col("value") - previous) / previous)
    return rows.select(*by, "day", "seq", "value", change.alias("change_pct"))


def volatility(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """observations, period_pct_change_std, period_pct_change_mean; null under two changes."""
    changes = period_changes(obs, by).groupBy(*(by or [])).agg(F.count("change_pct").alias("observations"), F.stddev_samp("change_pct").alias("s"), F.avg("change_pct").alias("m"))
    enough = F.col("observations") >= 2
    return changes.select(*(by or []), "observations", F.when(enough, F.col("s")).alias("period_pct_change_std"), F.when(enough, F.col("m")).alias("period_pct_change_mean"))


def max_drawdown(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """max_drawdown_pct (0 if there is none), peak_date (of the final peak), trough_date (of the first worst)."""
    by = by or []
    rows, months = _with_carry(obs.filter("value IS NOT NULL"), F.max("value"), by)
    before = Window.partitionBy(*by).orderBy(MONTH).rowsBetween(Window.unboundedPreceding, -1)  # one row per month
    months = months.select(*by, MONTH, F.max("__own").over(before).alias("__before"))
    upto = Window.partitionBy(*by, MONTH).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(months, [*by, MONTH]).withColumn("peak", F.greatest(F.max("value").over(upto), F.col("__before")))
    drop = F.when(F.col("peak") != 0, F.lit(100.0) * (F.col("value") - F.col("peak")) / F.col("peak"))
    rows = rows.withColumn("drop", F.when(drop < 0, drop))
    out = rows.groupBy(*by).agg(
        F.coalesce(F.min("drop"), F.lit(0.0)).alias("max_drawdown_pct"),
        F.max(F.struct("value", F.struct((-F.unix_date("day")).alias("d")).alias("first"))).alias("__top"),
        F.min(F.when(F.col("drop").isNotNull(), F.struct("drop", "seq", "day"))).alias("__worst"),
    )
    peak = F.date_from_unix_date(-F.col("__top.first.d"))
    return out.select(*by, "max_drawdown_pct", peak.alias("peak_date"), F.col("__worst.day").alias("trough_date"))
