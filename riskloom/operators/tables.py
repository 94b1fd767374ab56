"""Deterministic table analytics. Every function takes a DataFrame and returns one.

Grouping columns are compared as strings, a missing one as 'None'; rows whose value can't be
read as a number don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.dates import to_day
from riskloom.functions.numbers import concentration_level, numeric, risk_float


def value_of(df: DataFrame, column: str) -> Column:
    """The column as a number: numbers as they are, texts parsed."""
    return numeric(F.col(column)) if isinstance(df.schema[column].dataType, T.NumericType) else risk_float(F.col(column))


def table_summary(df: DataFrame, share: float = 0.6) -> DataFrame:
    """column, position, row_count, missing, is_numeric, is_date; one pass over the rows.

    A column is numeric (a date) if at least `share` of its non-empty values, and one, parse so.
    """
    cells = []
    for name in df.columns:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        text = c.cast("string")
        empty = c.isNull() | (text == "")
        number = value_of(df, name) if isinstance(kind, (T.NumericType, T.StringType)) else F.lit(None).cast("double")
        cells.append(F.struct(
            F.count("*").alias("row_count"),
            F.count_if(empty).alias("missing"),
            F.count(number).alias("numbers"),
            F.count(to_day(c, kind)).alias("dates"),
        ).alias(name))
    one = df.agg(*cells)
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"), F.col(f"`{n}`").alias("s")) for i, n in enumerate(df.columns))))
    out = one.select(rows.alias("r")).select("r.column", "r.position", "r.s.*")
    need = F.greatest(F.lit(1), F.floor(F.lit(share) * (F.col("row_count") - F.col("missing"))))
    return out.select("column", "position", "row_count", "missing", (F.col("numbers") >= need).alias("is_numeric"), (F.col("dates") >= need).alias("is_date"))


#: Values that the exact median sorts in one task at most, unless so many are equal; the sketch's accuracy and margin.
SORTED, ACCURACY, MARGIN = 100_000, 10_000, 0.001


def exact_median(df: DataFrame, value: Column) -> float | None:
    """The median without one task holding all values: a bracket, narrowed by sketches until few values are inside.

    A sketch misplaces a rank by 1/ACCURACY of the rows at most, which is less than MARGIN, so the
    median never leaves the bracket.
    """
    rows = df.select(value.alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    if not n:
        return None
    first, last = (n - 1) // 2, n // 2
    kept, below, inside = rows, 0, n
    while inside > SORTED:
        at = [max(0.0, (first - below) / inside - MARGIN), min(1.0, (last - below) / inside + MARGIN)]
        low, high = kept.agg(F.percentile_approx("v", at, ACCURACY)).first()[0]
        lower, within = kept.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if within == inside:  # equal values, which are folded below
            break
        kept, below, inside = rows.filter(F.col("v").between(low, high)), below + lower, within
    # equal values are folded first, so the sort holds distinct values of the bracket only
    counts = kept.groupBy("v").agg(F.count("*").alias("n"))
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(order) + below)
    pair = upto.agg(F.min(F.when(F.col("upto") > first, F.col("v"))), F.min(F.when(F.col("upto") > last, F.col("v")))).first()
    return (pair[0] + pair[1]) / 2


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: column, count, missing, minimum, maximum, mean, median, std (0 for one value)."""
    v = value_of(df, column)
    median = exact_median(df, v)
    std = F.when(F.count(v) == 1, F.lit(0.0)).when(F.count(v) > 1, F.stddev_samp(v))
    return df.agg(
        F.lit(column).alias("column"),
        F.count(v).alias("count"),
        (F.count("*") - F.count(v)).alias("missing"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        std.alias("std"),
    )


def group_sum(df: DataFrame, by: str, value: str) -> DataFrame:
    """by (as text), value: sums of readable values. Unordered; order by value and by for a report."""
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias(by), value_of(df, value).alias(value))
    return rows.filter(F.col(value).isNotNull()).groupBy(by).agg(F.sum(value).alias(value))


def group_share(df: DataFrame, by: str, value: str) -> DataFrame:
    """group_sum with share_pct of the total; null shares if the total is zero."""
    groups = group_sum(df, by, value)
    total = groups.agg(F.sum(value).alias("__total"))  # one row
    share = F.when(F.col("__total") != 0, F.lit(100.0) * F.col(value) / F.col("__total"))
    return groups.join(F.broadcast(total)).select(by, value, share.alias("share_pct"))


def top_n(df: DataFrame, value: str, n: int = 5, by: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """The n rows (or groups) with the largest values, unreadable ones last; ties by the named columns."""
    rows = group_sum(df, by, value) if by else df
    return rows.orderBy(value_of(rows, value).desc_nulls_last(), *(ties or ([by] if by else []))).limit(n)


def concentration_metrics(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """One row: total, top1_share_pct, top3_share_pct, hhi, concentration_level, rows_used.

    Negative values don't count. One aggregation: the sum of squares gives the HHI, and a
    three-row top-k the shares, so no window over all groups is needed.
    """
    rows = group_sum(df, by, value) if by else df
    v = value_of(rows, value)
    kept = rows.select(v.alias("v")).filter("v >= 0")
    sums = kept.agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.count("*").alias("n"))
    tops = kept.orderBy(F.desc("v")).limit(3).agg(F.max("v").alias("top1"), F.sum("v").alias("top3"))
    ok = (F.col("n") > 0) & (F.col("total") > 0)
    pct = lambda c: F.when(ok, F.lit(100.0) * c / F.col("total")).otherwise(F.lit(0.0))
    hhi = F.when(ok, F.lit(10_000.0) * F.col("squares") / (F.col("total") * F.col("total"))).otherwise(F.lit(0.0))
    out = sums.join(F.broadcast(tops)).select(
        F.lit(value).alias("value_column"),
        F.lit(by).cast("string").alias("group_column"),
        F.when(ok, F.col("total")).otherwise(F.lit(0.0)).alias("total"),
        pct(F.col("top1")).alias("top1_share_pct"),
        pct(F.col("top3")).alias("top3_share_pct"),
        hhi.alias("hhi"),
        F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("rows_used"),
    )
    return out.withColumn("concentration_level", concentration_level(F.col("top1_share_pct"), F.col("hhi")))
