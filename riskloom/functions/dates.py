"""Dates and periods as Column functions.

Free-form dates are read by a finite list of patterns; anything else is no date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERNS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM"]
ALIASES = {"annual": "year", "yearly": "year", "y": "year", "monthly": "month", "m": "month", "quarterly": "quarter", "q": "quarter", "daily": "day", "d": "day"}
SHAPES = [("year", r"^\d{4}$"), ("month", r"^\d{4}-\d{1,2}$"), ("quarter", r"^\d{4}[- ]?[qQ][1-4]$"), ("day", r"^\d{4}-\d{1,2}-\d{1,2}$")]


def to_day(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("date")
    text = F.trim(c)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("date") for p in PATTERNS))


def frequency(shapes: dict[str, Column]) -> Column:
    """The first shape that all of a group's periods have; shapes: name -> aggregated bool_and."""
    out = F.lit("period")
    for name in reversed([n for n, _ in SHAPES]):
        out = F.when(shapes[name], F.lit(name)).otherwise(out)
    return out


def all_shapes(period: Column) -> dict[str, Column]:
    return {name: F.bool_and(F.trim(period).rlike(shape)) for name, shape in SHAPES}


def period_key(period: Column, freq: Column, fallback: Column) -> Column:
    """Three ints that order periods of one frequency; what doesn't fit it goes last, in input order."""
    text = F.trim(period)
    part = lambda shape, k: F.regexp_extract(text, shape, k).try_cast("int")
    zero, last = F.lit(0), F.lit(1_000_000_000)
    key = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    month, quarter, day = r"^(\d{4})-(\d{1,2})$", r"^(\d{4})[- ]?[qQ]([1-4])$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    return (
        F.when((freq == "year") & text.rlike(r"\d{4}"), key(part(r"(\d{4})", 1), zero, zero))
        .when((freq == "month") & text.rlike(month), key(part(month, 1), part(month, 2), zero))
        .when((freq == "quarter") & text.rlike(quarter), key(part(quarter, 1), part(quarter, 2), zero))
        .when((freq == "day") & text.rlike(day), key(part(day, 1), part(day, 2), part(day, 3)))
        .otherwise(key(last, fallback.cast("int"), zero))
    )


def next_label(period: Column, step: Column, freq: Column) -> Column:
    """The label `step` periods on; t+step where the frequency has no calendar."""
    text = F.trim(period)
    part = lambda shape, k: F.regexp_extract(text, shape, k).try_cast("int")
    month, quarter = r"^(\d{4})-(\d{1,2})$", r"^(\d{4})[- ]?[qQ]([1-4])$"
    months = part(month, 1) * 12 + part(month, 2) - 1 + step
    quarters = part(quarter, 1) * 4 + part(quarter, 2) - 1 + step
    return (
        F.when((freq == "year") & text.rlike(r"\d{4}"), (part(r"(\d{4})", 1) + step).cast("string"))
        .when((freq == "month") & text.rlike(month), F.format_string("%04d-%02d", F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int")))
        .when((freq == "quarter") & text.rlike(quarter), F.format_string("%04d-Q%d", F.floor(quarters / 4).cast("int"), (quarters % 4 + 1).cast("int")))
        .otherwise(F.concat(F.lit("t+"), step.cast("string")))
    )
