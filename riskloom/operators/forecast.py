"""Forecasts of many short series at once.

A series is one row that holds its values in period order as an array (the number of periods
bounds it, not the number of source rows, which are aggregated per period first). Methods are
Column functions of such an array, so a backtest applies the same function to its prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.dates import ALIASES, all_shapes, frequency, next_label, period_key
from riskloom.functions.numbers import forecast_float

BASIC = ["naive", "moving_average", "linear_trend", "exponential_smoothing"]
METHODS = [*BASIC, "seasonal_naive"]


def season_length(freq: Column) -> Column:
    return F.when(freq == "month", F.lit(12)).when(freq == "quarter", F.lit(4))


def clamp_value(v: Column, nonnegative: bool = True) -> Column:
    return F.greatest(F.lit(0.0), v) if nonnegative else v


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def linear_fit(values: Column) -> tuple[Column, Column]:
    """Intercept and slope over the places 0, 1, ...; slope 0 for a single value."""
    n = F.size(values)
    middle = (n - 1) / F.lit(2.0)
    products = F.aggregate(F.transform(values, lambda v, i: (i - middle) * v), F.lit(0.0), lambda s, v: s + v)
    slope = F.when(n > 1, products * 12.0 / (n.cast("double") * (n.cast("double") * n - 1))).otherwise(F.lit(0.0))
    return mean(values) - slope * middle, slope


def smooth_level(values: Column, alpha: float = 0.4) -> Column:
    alpha = min(1.0, max(0.0, alpha))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda level, v: F.lit(alpha) * v + F.lit(1 - alpha) * level)


def predict(method: str, values: Column, step: Column, season: Column, nonnegative: bool = True, window: int = 3, alpha: float = 0.4) -> Column:
    """The forecast `step` periods on (from 1); null where the method has none."""
    n = F.size(values)
    if method == "naive":
        out = F.element_at(values, -1)
    elif method == "moving_average":
        width = F.greatest(F.lit(1), F.least(F.lit(window), n))
        out = mean(F.slice(values, n - width + 1, width))
    elif method == "linear_trend":
        intercept, slope = linear_fit(values)
        out = intercept + slope * (n + step - 1)
    elif method == "exponential_smoothing":
        out = smooth_level(values, alpha)
    elif method == "seasonal_naive":
        place = n - season + (step - 1) % season + 1
        out = F.when(season.isNotNull() & (n >= season), F.element_at(values, F.coalesce(F.when(n >= season, place), F.lit(1)).cast("int")))
    else:
        raise ValueError(f"unknown forecast method: {method}")
    return clamp_value(out, nonnegative)


def backtest_mae(method: str, values: Column, season: Column, **options) -> Column:
    """Mean absolute error of one-step forecasts from growing prefixes; null for short series."""
    n = F.size(values)
    first = F.coalesce(season, F.lit(1)) if method == "seasonal_naive" else F.lit(3)
    enough = (n >= 4) & ((season.isNotNull() & (n >= season + 2)) if method == "seasonal_naive" else F.lit(True))
    last = F.greatest(n - 1, first)
    errors = F.transform(F.sequence(first, last), lambda i: F.abs(predict(method, F.slice(values, 1, i), F.lit(1), season, **options) - F.get(values, i)))
    return F.when(enough, mean(errors))


def ensemble_backtest_mae(values: Column, season: Column, seasonal: Column, **options) -> Column:
    """The same for the mean of all methods at hand; the seasonal one joins once a prefix spans a season."""
    n = F.size(values)

    def error(i):
        prefix = F.slice(values, 1, i)
        one = F.lit(1)
        basic = [predict(m, prefix, one, season, **options) for m in BASIC]
        extra = F.when(seasonal, predict("seasonal_naive", prefix, one, season, **options))
        total = sum(basic[1:], basic[0]) + F.coalesce(extra, F.lit(0.0))
        return F.abs(total / (F.lit(len(BASIC)) + F.when(extra.isNotNull(), 1).otherwise(0)) - F.get(values, i))

    return F.when(n >= 4, mean(F.transform(F.sequence(F.lit(3), F.greatest(n - 1, F.lit(3))), error)))


def pct_change_volatility(values: Column) -> Column:
    """Sample deviation of changes relative to the absolute previous value, zeros skipped; null under two."""
    pairs = F.arrays_zip(F.slice(values, 1, F.size(values) - 1).alias("p"), F.slice(values, 2, F.size(values) - 1).alias("c"))
    changes = F.transform(F.filter(pairs, lambda x: x["p"] != 0), lambda x: (x["c"] - x["p"]) / F.abs(x["p"]))
    spread = F.aggregate(F.transform(changes, lambda x: F.pow(x - mean(changes), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(values) > 1) & (F.size(changes) >= 2), F.sqrt(spread / (F.size(changes) - 1)))


def fallback_error_scale(values: Column) -> Column:
    n = F.size(values)
    steps = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda p, c: F.abs(c - p))
    return F.greatest(F.lit(0.1) * F.abs(F.element_at(values, -1)), F.when(n > 1, mean(steps)), F.lit(1.0))


def interval_bounds(value: Column, step: Column, scale: Column, z: float = 1.64, nonnegative: bool = True) -> tuple[Column, Column]:
    margin = F.lit(z) * scale * F.sqrt(F.greatest(F.lit(1), step).cast("double"))
    return clamp_value(value - margin, nonnegative), value + margin


def normalize_series(df: DataFrame, period: str, value: str, order: str, by: list[str] | None = None, explicit: str | None = None) -> DataFrame:
    """by, period, value, frequency, key: readable rows, one per period (the last in sort order)."""
    by = by or []
    rows = df.select(*by, F.trim(F.col(period).cast("string")).alias("period"), forecast_float(F.col(value)).alias("value"), F.col(order).alias("ord"))
    rows = rows.filter("value IS NOT NULL AND period IS NOT NULL")
    if explicit:
        rows = rows.withColumn("frequency", F.lit(ALIASES.get(explicit.lower().strip(), explicit.lower().strip())))
    else:
        shapes = rows.groupBy(*by).agg(frequency(all_shapes(F.col("period"))).alias("frequency"))
        rows = rows.join(shapes, by) if by else rows.join(F.broadcast(shapes))  # without by: one row
    key = F.struct(period_key(F.col("period"), F.col("frequency"), F.col("ord")).alias("key"), F.col("ord"))
    last = rows.groupBy(*by, "frequency", "period").agg(F.max_by("value", key).alias("value"), F.max(key).alias("key"))
    return last.select(*by, "period", "value", "frequency", "key")


def series_arrays(normal: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, frequency, values, periods, n: one row per series."""
    by = by or []
    rows = normal.groupBy(*by, "frequency").agg(F.array_sort(F.collect_list(F.struct("key", "period", "value"))).alias("rows"))
    return rows.select(*by, "frequency", F.col("rows.value").alias("values"), F.col("rows.period").alias("periods"), F.size("rows").alias("n"))


def forecast_series(series: DataFrame, horizon: int = 3, method: str = "ensemble", by: list[str] | None = None, nonnegative: bool = True, window: int = 3, alpha: float = 0.4) -> DataFrame:
    """by, status, frequency, n, step, period, value, lower, upper, error_scale, trend, volatility, and one column per method.

    Under three values the status is unavailable and there is a single row without forecast.
    """
    by = by or []
    options = {"nonnegative": nonnegative, "window": window, "alpha": alpha}
    values, season = F.col("values"), season_length(F.col("frequency"))
    seasonal = season.isNotNull() & (F.col("n") >= 2 * season)
    tests = {m: backtest_mae(m, values, season, **options) for m in METHODS}
    tests["seasonal_naive"] = F.when(seasonal, tests["seasonal_naive"])
    tests["ensemble"] = ensemble_backtest_mae(values, season, seasonal, **options)
    chosen = F.when(seasonal, tests[method]).otherwise(tests["ensemble"]) if method == "seasonal_naive" else tests[method]
    ready = F.col("n") >= 3
    rows = series.withColumn("scale", F.when(ready, F.coalesce(F.nullif(chosen, F.lit(0.0)), fallback_error_scale(values))))
    rows = rows.withColumn("step", F.explode(F.when(ready, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(None).cast("int")))))
    step = F.col("step")
    for m in METHODS:
        p = predict(m, values, step, season, **options)
        rows = rows.withColumn(m, F.when(step.isNotNull() & (seasonal if m == "seasonal_naive" else F.lit(True)), p))
    total = sum((F.col(m) for m in BASIC[1:]), F.col(BASIC[0])) + F.coalesce("seasonal_naive", F.lit(0.0))
    rows = rows.withColumn("ensemble", total / (F.lit(len(BASIC)) + F.when(F.col("seasonal_naive").isNotNull(), 1).otherwise(0)))
    value = F.coalesce(F.col(method), F.col("ensemble"))
    lower, upper = interval_bounds(value, step, F.col("scale"), nonnegative=nonnegative)
    return rows.select(
        *by,
        F.when(ready, F.lit("computed")).otherwise(F.lit("unavailable")).alias("status"),
        "frequency",
        "n",
        "step",
        F.when(step.isNotNull(), next_label(F.element_at("periods", -1), step, F.col("frequency"))).alias("period"),
        value.alias("value"),
        lower.alias("lower"),
        upper.alias("upper"),
        F.col("scale").alias("error_scale"),
        F.when(ready, linear_fit(values)[1]).alias("trend"),
        F.when(ready, pct_change_volatility(values)).alias("volatility"),
        *METHODS,
        "ensemble",
    )


def period_totals(df: DataFrame, date: str, value: str, by: list[str] | None = None, fmt: str = "yyyy-MM") -> DataFrame:
    """by, period, value, ord: sums per calendar period, which shrinks any table to its periods."""
    rows = df.groupBy(*(by or []), F.date_format(date, fmt).alias("period")).agg(F.sum(value).alias("value"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*(by or [])).orderBy("period")))
