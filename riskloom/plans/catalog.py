"""Named queries over the star schema, each with equivalent SQL where SQL can say it.

Every entry reads whole tables. `QUERIES` maps a name to (function, SQL or None).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import numbers, text, web
from riskloom.operators import blocks, evals, forecast, graph, ledger, memory, reasoning, risk, tables, timeseries, vectors, verdicts
from riskloom.sources import registry
from riskloom.streaming import ledger as stream

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def pick(seed: str, values: list[str]):
    """One of the values, by the remainder of an expression."""
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(F.expr(seed) % len(values) == i, F.lit(v)).otherwise(out)
    return out


def pick_sql(seed: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN ({seed}) % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


# ---------------------------------------------------------------- tables


@query("""
    SELECT 'o_orderkey' AS "column", 0 AS position, count(*) AS row_count, count(*) - count(o_orderkey) AS missing, true AS is_numeric, false AS is_date FROM orders
    UNION ALL SELECT 'o_custkey', 1, count(*), count(*) - count(o_custkey), true, false FROM orders
    UNION ALL SELECT 'o_orderstatus', 2, count(*), count(*) - count(nullif(o_orderstatus, '')),
        count(try_cast(o_orderstatus AS DOUBLE)) >= greatest(1, floor(0.6 * count(nullif(o_orderstatus, '')))), false FROM orders
    UNION ALL SELECT 'o_totalprice', 3, count(*), count(*) - count(o_totalprice), true, false FROM orders
    UNION ALL SELECT 'o_orderdate', 4, count(*), count(*) - count(o_orderdate), false, true FROM orders
    UNION ALL SELECT 'o_orderpriority', 5, count(*), count(*) - count(nullif(o_orderpriority, '')),
        count(try_cast(o_orderpriority AS DOUBLE)) >= greatest(1, floor(0.6 * count(nullif(o_orderpriority, '')))), false FROM orders""")
def table_summary_orders(spark, sf_dir):
    return tables.table_summary(read(spark, sf_dir, "orders"))


@query("""
    SELECT 'c_acctbal' AS "column", count(c_acctbal) AS count, count(*) - count(c_acctbal) AS missing, min(c_acctbal) AS minimum, max(c_acctbal) AS maximum,
           round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(stddev_samp(c_acctbal), 4) AS std FROM customer""")
def column_stats_acctbal(spark, sf_dir):
    return rounded(tables.column_stats(read(spark, sf_dir, "customer"), "c_acctbal"), 4, "mean", "median", "std")


@query("""
    SELECT c_mktsegment, round(sum(o_totalprice), 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def group_sum_segment(spark, sf_dir):
    per_customer = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("o_totalprice"))
    rows = per_customer.join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(tables.group_sum(rows, "c_mktsegment", "o_totalprice"), 2, "o_totalprice")


def nation_revenue(spark, sf_dir):
    """n_name, revenue per supplier; lineitem is summed per supplier before it meets another table."""
    item = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    rows = item.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "revenue")


NATION_SQL = """
    g AS (SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""


@query(f"WITH {NATION_SQL} SELECT n_name, round(revenue, 2) AS revenue, round(100 * revenue / sum(revenue) OVER (), 6) AS share_pct FROM g")
def group_share_nation(spark, sf_dir):
    out = tables.group_share(nation_revenue(spark, sf_dir), "n_name", "revenue")
    return rounded(rounded(out, 2, "revenue"), 6, "share_pct")


@query(f"""
    WITH {NATION_SQL}, s AS (SELECT 100 * revenue / sum(revenue) OVER () AS share, revenue, row_number() OVER (ORDER BY revenue DESC) AS r FROM g WHERE revenue >= 0),
    m AS (SELECT sum(revenue) AS total, max(share) AS top1, sum(share) FILTER (r <= 3) AS top3, sum(share * share) AS hhi, count(*) AS n FROM s)
    SELECT 'revenue' AS value_column, 'n_name' AS group_column, round(total, 2) AS total, round(top1, 6) AS top1_share_pct, round(top3, 6) AS top3_share_pct, round(hhi, 4) AS hhi, n AS rows_used,
           CASE WHEN top1 >= 80 OR hhi >= 5000 THEN 'severe' WHEN top1 >= 60 OR hhi >= 2500 THEN 'high' WHEN top1 >= 40 OR hhi >= 1500 THEN 'moderate' ELSE 'low' END AS concentration_level FROM m""")
def concentration_supplier_nation(spark, sf_dir):
    out = tables.concentration_metrics(nation_revenue(spark, sf_dir), "revenue", "n_name")
    return rounded(rounded(rounded(out, 2, "total"), 6, "top1_share_pct", "top3_share_pct"), 4, "hhi")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_n_parts(spark, sf_dir):
    return tables.top_n(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", 10, ties=["p_partkey"])


@query("""
    SELECT p_brand, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, p_brand LIMIT 5""")
def top_n_groups(spark, sf_dir):
    per_part = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("l_extendedprice"))
    rows = per_part.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(tables.top_n(rows, "l_extendedprice", 5, "p_brand"), 2, "l_extendedprice")


# ---------------------------------------------------------------- time series


def daily(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("total"))


def monthly(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"))


DAILY_SQL = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1)"
MONTHLY_SQL = "m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1)"


@query("SELECT o_orderstatus, count(*) AS observation_count, CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date FROM orders GROUP BY 1")
def ts_summary_orders(spark, sf_dir):
    return timeseries.time_series_summary(read(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus"])


@query(f"""
    WITH {DAILY_SQL}, e AS (SELECT min(day) FILTER (day >= DATE '1996-02-15') AS a, max(day) FILTER (day <= DATE '1999-11-20') AS b FROM d)
    SELECT a AS start_date, b AS end_date, round(x.value, 2) AS start_value, round(y.value, 2) AS end_value, round(y.value - x.value, 2) AS absolute_change,
           round(100 * (y.value - x.value) / x.value, 6) AS percent_change FROM e JOIN d x ON x.day = a JOIN d y ON y.day = b""")
def pct_change_asof(spark, sf_dir):
    out = timeseries.percent_change(timeseries.observations(daily(spark, sf_dir), "o_orderdate", "total"), "1996-02-15", "1999-11-20")
    return rounded(rounded(out, 2, "start_value", "end_value", "absolute_change"), 6, "percent_change")


@query(f"""
    WITH {DAILY_SQL}, w AS (SELECT avg(value) FILTER (day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS a, avg(value) FILTER (day BETWEEN DATE '1998-01-01' AND DATE '1998-06-30') AS b FROM d)
    SELECT round(a, 2) AS baseline_mean, round(b, 2) AS shock_mean, round(b - a, 2) AS absolute_change, round(100 * (b - a) / a, 6) AS percent_change FROM w""")
def window_change_shock(spark, sf_dir):
    out = timeseries.window_change(timeseries.observations(daily(spark, sf_dir), "o_orderdate", "total"), ("1996-01-01", "1996-12-31"), ("1998-01-01", "1998-06-30"))
    return rounded(rounded(out, 2, "baseline_mean", "shock_mean", "absolute_change"), 6, "percent_change")


def event_days(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))


EVENT_SQL = """
    e AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY ALL),
    c AS (SELECT event_type, day, value, lag(value) OVER (PARTITION BY event_type ORDER BY day) AS p FROM e),
    x AS (SELECT event_type, day, CASE WHEN p <> 0 THEN 100 * (value - p) / p END AS change_pct FROM c)"""


@query(f"WITH {EVENT_SQL} SELECT event_type, day, round(change_pct, 4) AS change_pct FROM x")
def period_changes(spark, sf_dir):
    out = timeseries.period_changes(timeseries.observations(event_days(spark, sf_dir), "day", "total", ["event_type"]), ["event_type"])
    return rounded(out.select("event_type", "day", "change_pct"), 4, "change_pct")


@query(f"""
    WITH {EVENT_SQL} SELECT event_type, count(change_pct) AS observations, CASE WHEN count(change_pct) >= 2 THEN round(stddev_samp(change_pct), 4) END AS period_pct_change_std,
           CASE WHEN count(change_pct) >= 2 THEN round(avg(change_pct), 4) END AS period_pct_change_mean FROM x GROUP BY 1""")
def volatility(spark, sf_dir):
    out = timeseries.volatility(timeseries.observations(event_days(spark, sf_dir), "day", "total", ["event_type"]), ["event_type"])
    return rounded(out, 4, "period_pct_change_std", "period_pct_change_mean")


@query(f"""
    WITH {MONTHLY_SQL}, p AS (SELECT day, value, max(value) OVER (ORDER BY day) AS peak FROM m), r AS (SELECT *, 100 * (value - peak) / peak AS drop FROM p)
    SELECT round(least(0, min(drop)), 6) AS max_drawdown_pct, (SELECT min(day) FROM p WHERE value = (SELECT max(value) FROM p)) AS peak_date,
           (SELECT min(day) FROM r WHERE drop = (SELECT min(drop) FROM r) AND drop < 0) AS trough_date FROM r""")
def drawdown_monthly(spark, sf_dir):
    return rounded(timeseries.max_drawdown(timeseries.observations(monthly(spark, sf_dir), "month", "total")), 6, "max_drawdown_pct")


# ---------------------------------------------------------------- forecasts


def monthly_series(spark, sf_dir, by=None):
    rows = read(spark, sf_dir, "orders")
    if by == ["c_mktsegment"]:
        rows = rows.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    totals = forecast.period_totals(rows, "o_orderdate", "o_totalprice", by)
    return forecast.series_arrays(forecast.normalize_series(totals, "period", "value", "ord", by), by)


SERIES_SQL = """
    t AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1),
    a AS (SELECT list(value ORDER BY period) AS v, max(period) AS last, count(*) AS n FROM t),
    h AS (SELECT unnest([1, 2, 3]) AS step),
    lab AS (SELECT step, strftime(strptime(last || '-01', '%Y-%m-%d') + to_months(CAST(step AS INTEGER)), '%Y-%m') AS period FROM a, h),
    pre AS (SELECT i, v, v[1:i] AS w, n FROM a, (SELECT unnest(range(3, 500)) AS i) WHERE i < n)"""
EMA_SQL = "list_reduce({0}, lambda s, x: 0.4 * x + 0.6 * s)"


def one_forecast(spark, sf_dir, method, by=None):
    out = forecast.forecast_series(monthly_series(spark, sf_dir, by), 3, method, by)
    return rounded(out.select(*(by or []), "step", "period", "value"), 2, "value")


@query(f"WITH {SERIES_SQL} SELECT CAST(step AS INTEGER) AS step, period, round(greatest(0, v[n]), 2) AS value FROM a, lab")
def forecast_naive(spark, sf_dir):
    return one_forecast(spark, sf_dir, "naive")


@query(f"WITH {SERIES_SQL} SELECT CAST(step AS INTEGER) AS step, period, round(greatest(0, list_avg(v[n-2:n])), 2) AS value FROM a, lab")
def forecast_ma(spark, sf_dir):
    return one_forecast(spark, sf_dir, "moving_average")


@query(f"""
    WITH {SERIES_SQL}, f AS (SELECT regr_slope(value, x) AS s, regr_intercept(value, x) AS c, count(*) AS k FROM (SELECT value, row_number() OVER (ORDER BY period) - 1 AS x FROM t))
    SELECT CAST(step AS INTEGER) AS step, period, round(greatest(0, c + s * (k + step - 1)), 2) AS value FROM f, lab""")
def forecast_trend(spark, sf_dir):
    return one_forecast(spark, sf_dir, "linear_trend")


@query(f"WITH {SERIES_SQL} SELECT CAST(step AS INTEGER) AS step, period, round(greatest(0, {EMA_SQL.format('v')}), 2) AS value FROM a, lab")
def forecast_ema(spark, sf_dir):
    return one_forecast(spark, sf_dir, "exponential_smoothing")


@query(f"WITH {SERIES_SQL} SELECT CAST(step AS INTEGER) AS step, period, round(greatest(0, v[n - 12 + step]), 2) AS value FROM a, lab")
def forecast_seasonal(spark, sf_dir):
    return one_forecast(spark, sf_dir, "seasonal_naive")


@query(f"""
    WITH {SERIES_SQL}, lin AS (SELECT i, any_value(v[i + 1]) AS y, regr_slope(val, x) AS s, regr_intercept(val, x) AS c
        FROM (SELECT i, v, unnest(w) AS val, unnest(range(0, i)) AS x FROM pre) GROUP BY i)
    SELECT 'naive' AS method, round(avg(abs(v[i] - v[i + 1])), 2) AS mae FROM pre
    UNION ALL SELECT 'moving_average', round(avg(abs(list_avg(v[i - 2:i]) - v[i + 1])), 2) FROM pre
    UNION ALL SELECT 'linear_trend', round(avg(abs(greatest(0, c + s * i) - y)), 2) FROM lin
    UNION ALL SELECT 'exponential_smoothing', round(avg(abs({EMA_SQL.format('w')} - v[i + 1])), 2) FROM pre
    UNION ALL SELECT 'seasonal_naive', round(avg(abs(v[i - 11] - v[i + 1])), 2) FROM pre WHERE i >= 12""")
def backtest_methods(spark, sf_dir):
    rows = monthly_series(spark, sf_dir)
    season = forecast.season_length(F.col("frequency"))
    cells = F.array(*(F.struct(F.lit(m).alias("method"), F.round(forecast.backtest_mae(m, F.col("values"), season), 2).alias("mae")) for m in forecast.METHODS))
    return rows.select(F.explode(cells).alias("c")).select("c.*")


@query(f"""
    WITH {SERIES_SQL}, b AS (SELECT avg(abs(v[i] - v[i + 1])) AS mae FROM pre),
    s AS (SELECT v[n] AS value, CASE WHEN mae IS NULL OR mae = 0 THEN greatest(0.1 * abs(v[n]), 1.0) ELSE mae END AS scale FROM a, b)
    SELECT CAST(step AS INTEGER) AS step, period, round(value, 2) AS value, round(greatest(0, value - 1.64 * scale * sqrt(step)), 2) AS lower, round(value + 1.64 * scale * sqrt(step), 2) AS upper FROM s, lab""")
def forecast_interval(spark, sf_dir):
    out = forecast.forecast_series(monthly_series(spark, sf_dir), 3, "naive")
    return rounded(out.select("step", "period", "value", "lower", "upper"), 2, "value", "lower", "upper")


@query("""
    WITH t AS (SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    x AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY period) - 1 AS i FROM t),
    a AS (SELECT c_mktsegment, list(value ORDER BY period) AS v, max(period) AS last, count(*) AS n, regr_slope(value, i) AS s, regr_intercept(value, i) AS c FROM x GROUP BY 1),
    h AS (SELECT unnest([1, 2, 3]) AS step)
    SELECT c_mktsegment, CAST(step AS INTEGER) AS step, strftime(strptime(last || '-01', '%Y-%m-%d') + to_months(CAST(step AS INTEGER)), '%Y-%m') AS period,
           round((greatest(0, v[n]) + greatest(0, list_avg(v[n-2:n])) + greatest(0, c + s * (n + step - 1)) + greatest(0, list_reduce(v, lambda p, q: 0.4 * q + 0.6 * p)) + greatest(0, v[n - 12 + step])) / 5, 2) AS value
    FROM a, h""")
def forecast_ensemble_many(spark, sf_dir):
    return one_forecast(spark, sf_dir, "ensemble", ["c_mktsegment"])


@query("""
    WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderkey AS ord, o_totalprice AS value FROM orders)
    SELECT period, arg_max(value, ord) AS value, 'month' AS frequency FROM r GROUP BY 1""")
def normalize_series_dups(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord"))
    return forecast.normalize_series(rows, "period", "value", "ord").select("period", "value", "frequency")


# ---------------------------------------------------------------- blocks


@query("""
    SELECT * FROM (VALUES ('event_id', 0, 'numeric', 'id'), ('ts', 1, 'categorical_or_text', NULL), ('user_id', 2, 'numeric', 'id'),
        ('event_type', 3, 'categorical_or_text', 'type'), ('value', 4, 'numeric', NULL), ('props', 5, 'categorical_or_text', NULL)) t("column", position, semantic_type, unit),
        (SELECT count(*) AS non_null_count FROM events)""")
def infer_schema_events(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("__order", F.col("event_id"))
    return blocks.infer_schema(df, "__order")


@query("""
    WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d LIMIT 20), g AS (SELECT d - lag(d) OVER (ORDER BY d) AS gap FROM d),
    s AS (SELECT list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l, (SELECT count(*) FROM d) AS n FROM g)
    SELECT CASE WHEN n < 3 THEN NULL WHEN l[len(l) // 2 + 1] <= 1 THEN 'daily' WHEN l[len(l) // 2 + 1] BETWEEN 6 AND 8 THEN 'weekly' WHEN l[len(l) // 2 + 1] BETWEEN 27 AND 32 THEN 'monthly' END AS frequency,
           CAST(n AS INTEGER) AS dates_used FROM s""")
def infer_frequency_orders(spark, sf_dir):
    return blocks.infer_frequency(read(spark, sf_dir, "orders"), "o_orderdate")


PARAGRAPH_SQL = r"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
    o AS (SELECT doc_id, k, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM l),
    p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS paragraph_id, CAST(start_char AS INTEGER) AS start_char,
                 CAST(start_char + length(line) AS INTEGER) AS end_char, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM o WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) >= 3)"""


@query(f"WITH {PARAGRAPH_SQL} SELECT doc_id, paragraph_id, start_char, end_char, md5(text) AS text_md5 FROM p")
def paragraph_spans(spark, sf_dir):
    out = blocks.paragraph_spans(read(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumn("text_md5", F.md5("text")).drop("text")


@query(f"""
    WITH {PARAGRAPH_SQL} SELECT doc_id, CAST(paragraph_id // 4 AS INTEGER) AS chunk, min(paragraph_id) AS start_paragraph, max(paragraph_id) AS end_paragraph,
           min(start_char) AS start_char, max(end_char) AS end_char FROM p GROUP BY ALL""")
def chunk_ranges(spark, sf_dir):
    return blocks.chunk_ranges(blocks.paragraph_spans(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(r"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS x FROM documents),
    r AS (SELECT doc_id, x, 0::BIGINT AS a, 0::BIGINT AS b FROM t UNION ALL
          SELECT doc_id, x, b, CASE WHEN e < length(x) AND strpos(reverse(w), chr(10) || chr(10)) > 0 AND b + length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 > b + 500 THEN b + length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 ELSE e END
          FROM (SELECT *, least(length(x), b + 2500) AS e, substr(x, b + 1, least(length(x), b + 2500) - b) AS w FROM r WHERE b < length(x)) q),
    k AS (SELECT doc_id, a, b, regexp_replace(substr(x, a + 1, b - a), '^\s+|\s+$', '', 'g') AS text FROM r WHERE b > 0)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk, a::INTEGER AS start_char, b::INTEGER AS end_char, text FROM k WHERE text <> ''""")
def chunk_text_blocks(spark, sf_dir):
    return blocks.chunk_text(read(spark, sf_dir, "documents"), "doc_id", "text")


# ---------------------------------------------------------------- texts


NORM_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[''’]s\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT item_id, {NORM_SQL.format('text')} AS normalized FROM benchmark")
def text_norm(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", text.normalize(F.col("text")).alias("normalized"))


@query(f"""
    WITH w AS (SELECT item_id, string_split({NORM_SQL.format('text')}, ' ') AS t FROM benchmark),
    k AS (SELECT item_id, unnest(t) AS term, unnest(range(0, len(t))) AS i FROM w)
    SELECT item_id, term, min(i) AS at FROM k WHERE length(term) >= 3 AND term NOT IN ({", ".join(f"'{s}'" for s in text.FOCUS_STOP_WORDS)}) GROUP BY ALL""")
def focus_terms(spark, sf_dir):
    words = F.split(text.normalize(F.col("text")), " ")
    rows = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.explode(text.focus_terms(F.col("text"))).alias("term"))
    return rows.select("item_id", "term", (F.array_position("w", F.col("term")) - 1).alias("at"))


@query(f"""
    WITH q AS (SELECT 'the thing that onthe source' AS question), n AS (SELECT doc_id, {NORM_SQL.format('text')} AS t FROM documents),
    k AS (SELECT {NORM_SQL.format('question')} AS q FROM q)
    SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN t = q THEN 1 WHEN contains(t, q) OR contains(q, t) THEN 0.9
        ELSE round(len(list_filter(string_split(q, ' '), lambda w: length(w) >= 3 AND contains(t, w))) / len(list_filter(string_split(q, ' '), lambda w: length(w) >= 3)), 6) END::DOUBLE AS score FROM n, k""")
def lexical_rank(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(text.lexical_score(F.lit("the thing that onthe source"), F.col("text")), 6).alias("score"))


# ---------------------------------------------------------------- sources


URL_SQL = r"""
    u AS (SELECT page_id, url, lower(regexp_extract(url, '^(?i)(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^(?i)https?://([^/?#]+)', 1)) AS host,
                 regexp_extract(url, '^(?i)https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
    c AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid') AND NOT starts_with(lower(x), 'utm_'))) AS kept,
                 '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') AS clean FROM u),
    k AS (SELECT page_id, url, host, scheme || '://' || regexp_replace(host, CASE WHEN scheme = 'http' THEN ':80$' ELSE ':443$' END, '') || clean || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM c)"""


@query(f"WITH {URL_SQL} SELECT page_id, canonical AS canonical_url, host AS domain FROM k")
def canonical_urls(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", web.canonicalize_url(url).alias("canonical_url"), web.domain(url).alias("domain"))


@query(f"WITH {URL_SQL} SELECT host AS domain, count(*) AS pages, count(DISTINCT canonical) AS canonical_pages FROM k GROUP BY 1")
def url_domains(spark, sf_dir):
    url = F.col("url")
    rows = read(spark, sf_dir, "pages").select(web.domain(url).alias("domain"), web.canonicalize_url(url).alias("canonical"))
    return rows.groupBy("domain", "canonical").agg(F.count("*").alias("n")).groupBy("domain").agg(F.sum("n").alias("pages"), F.count("*").alias("canonical_pages"))


def registered(spark, sf_dir):
    return registry.find_duplicates(registry.register(read(spark, sf_dir, "pages"), "url", "html", "page_id"))


DUPLICATE_SQL = f"""{URL_SQL},
    r AS (SELECT k.page_id, canonical, sha256(html) AS h FROM k JOIN pages USING (page_id)),
    f AS (SELECT page_id AS seq, canonical, min(page_id) OVER (PARTITION BY h) AS hf, min(page_id) OVER (PARTITION BY canonical) AS nf FROM r),
    dup AS (SELECT seq, canonical, CASE WHEN hf < seq THEN hf WHEN nf < seq THEN nf END AS duplicate_of FROM f)"""


@query(f"WITH {DUPLICATE_SQL} SELECT seq, canonical AS canonical_source, duplicate_of FROM dup")
def dedupe_sources(spark, sf_dir):
    return registered(spark, sf_dir).select("seq", "canonical_source", "duplicate_of")


def statuses(rows: DataFrame) -> DataFrame:
    """Acquisition and run statuses made from the row number, as a registry would hold them."""
    acquired = F.when(F.col("seq") % 11 == 0, "blocked").when(F.col("seq") % 13 == 0, "not_found").otherwise("acquired")
    last = F.when(F.col("seq") % 3 == 0, "success").when(F.col("seq") % 5 == 0, "failed")
    return rows.withColumns({"acquisition_status": acquired, "last_status": last})


STATUS_SQL = "CASE WHEN seq % 11 = 0 THEN 'blocked' WHEN seq % 13 = 0 THEN 'not_found' ELSE 'acquired' END"


@query(f"""
    WITH {DUPLICATE_SQL}, s AS (SELECT *, {STATUS_SQL} AS acquired, CASE WHEN seq % 3 = 0 THEN 'success' WHEN seq % 5 = 0 THEN 'failed' END AS last FROM dup)
    SELECT seq, CASE WHEN duplicate_of IS NOT NULL THEN 'skip_duplicate' WHEN acquired <> 'acquired' THEN 'blocked' WHEN last IS NULL THEN 'process'
        WHEN last = 'success' THEN 'skip_cached' WHEN last = 'failed' THEN 'retry_failed' END AS action FROM s""")
def source_plan(spark, sf_dir):
    return registry.plan(statuses(registered(spark, sf_dir)), retry_failed=True).select("seq", "action")


@query(f"""
    WITH {DUPLICATE_SQL}, s AS (SELECT split_part(split_part(canonical, '://', 2), '/', 1) AS domain, {STATUS_SQL} AS st, duplicate_of IS NOT NULL AS d FROM dup)
    SELECT 'domain' AS dimension, split_part(domain, '?', 1) AS value, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT 'acquisition_status', st, count(*) FROM s GROUP BY 1, 2
    UNION ALL SELECT 'is_duplicate', CAST(d AS VARCHAR), count(*) FROM s GROUP BY 1, 2""")
def registry_summary(spark, sf_dir):
    rows = statuses(registered(spark, sf_dir)).withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
    return registry.summary(rows, ["domain", "acquisition_status", "is_duplicate"])


@query(f"WITH {DUPLICATE_SQL} SELECT seq, canonical AS canonical_source, {STATUS_SQL} AS acquisition_status FROM dup WHERE duplicate_of IS NULL AND {STATUS_SQL} = 'acquired'")
def manifest_export(spark, sf_dir):
    return registry.manifest(statuses(registered(spark, sf_dir))).select("seq", "canonical_source", "acquisition_status")


@query("""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'OG ' || page_id ELSE nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') END AS title,
        CASE WHEN page_id % 2 = 0 THEN 'A' || page_id END AS author, CASE WHEN page_id % 5 = 0 THEN 'Site' ELSE 'late' END AS publisher, CASE WHEN page_id % 2 = 0 THEN '2024-01-02' END AS published_at, url AS canonical_url FROM pages""")
def html_metadata(spark, sf_dir):
    """Meta tags of several names, quotings and orders put before each page's own."""
    k = F.col("page_id")
    even = F.when(k % 2 == 0, F.concat(F.lit("<META content='A"), k, F.lit("' name='Author'><meta itemprop=\"date\" content=\"2024-01-02\">"))).otherwise(F.lit('<meta name="author" content="">'))
    title = F.when(k % 3 == 0, F.concat(F.lit('<meta property="og:title" content=" OG '), k, F.lit('"><meta name="title" content="no">'))).otherwise(F.lit(""))
    site = F.when(k % 5 == 0, F.lit('<meta name="publisher" content="late"><meta property="og:site_name" content="Site">')).otherwise(F.lit('<meta name="publisher" content="early"><meta name="publisher" content="late">'))
    found = web.html_metadata(F.concat(even, title, site, F.lit('<meta property="og:url" content="'), F.col("url"), F.lit('">'), F.col("html")))
    return read(spark, sf_dir, "pages").select(k, *(c.alias(n) for n, c in found.items()))


def _contains_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query(f"""
    WITH t AS (SELECT *, {pick_sql('page_id', ['text/html', 'image/png', 'application/pdf'])} AS mime FROM pages)
    SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'blocked' WHEN page_id % 19 = 0 THEN 'not_found' WHEN page_id % 23 = 0 THEN 'fetch_failed' WHEN page_id % 29 = 0 THEN 'paywalled' WHEN mime = 'image/png' AND NOT regexp_matches(lower(url), '\\.(html|htm|pdf|txt|json|csv)$') THEN 'unsupported'
        WHEN mime <> 'text/html' AND NOT contains(lower(substr(html, 1, 100)), '<html') THEN 'acquired' WHEN {_contains_any('html', web.PAYWALL)} THEN 'paywalled' WHEN {_contains_any('html', web.BLOCKED)} THEN 'blocked' ELSE 'acquired' END AS status FROM t""")
def fetch_class(spark, sf_dir):
    k = F.col("page_id")
    code = F.when(k % 17 == 0, 403).when(k % 19 == 0, 404).when(k % 23 == 0, F.when(k % 2 == 0, 500)).when(k % 29 == 0, 402).otherwise(200)
    return read(spark, sf_dir, "pages").select("page_id", web.fetch_class(code, pick("page_id", ["text/html", "image/png", "application/pdf"]), F.col("url"), F.col("html")).alias("status"))


@query(f"""
    WITH {URL_SQL}, d AS (SELECT page_id, host, regexp_replace(host, '^www\\.', '') AS h FROM k)
    SELECT page_id, CAST(CASE WHEN h IN ({", ".join(f"'{x}'" for x in web.URL_HIGH)}) THEN 0.92 WHEN regexp_matches(h, '\\.(edu|gov|int|org)$') THEN 0.75 ELSE 0.5 END AS DOUBLE) AS url_score,
           CAST(CASE page_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS registry_score FROM d""")
def credibility(spark, sf_dir):
    url = F.col("url")
    domain = pick("page_id", [web.REGISTRY_HIGH[0], f"data.{web.REGISTRY_MEDIUM[-1]}", "not" + web.REGISTRY_HIGH[0], "example.net"])
    publisher = F.when(F.col("page_id") % 4 == 2, "Press").otherwise(" ")
    return read(spark, sf_dir, "pages").select("page_id", web.url_credibility(url).alias("url_score"), web.registry_credibility(domain, publisher).alias("registry_score"))


@query("""
    WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents) SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id FROM h GROUP BY 1 HAVING count(*) > 1""")
def content_hash_dups(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


# ---------------------------------------------------------------- risk


def supplier_factors(spark, sf_dir):
    """A risk factor per supplier whose scores follow from its key and balance."""
    k = F.col("s_suppkey")
    score = lambda n: (k * n % 5 + 1).cast("double")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("factor"), F.col("s_nationkey").alias("model"),
        score(3).alias("severity"), (score(7) + 1).alias("likelihood"), F.when(k % 9 != 0, score(2)).alias("exposure"), score(11).alias("mitigation"), F.when(k % 4 != 0, score(1)).alias("confidence"),
    )


FACTOR_SQL = """
    f AS (SELECT s_suppkey AS factor, s_nationkey AS model, s_suppkey * 3 % 5 + 1.0 AS severity, least(5, s_suppkey * 7 % 5 + 2.0) AS likelihood,
                 CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey * 2 % 5 + 1.0 ELSE 1 END AS exposure, s_suppkey * 11 % 5 + 1.0 AS mitigation,
                 CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 + 1.0 ELSE 3 END AS confidence FROM supplier),
    r AS (SELECT *, CAST(severity * likelihood * exposure AS DOUBLE) / 125 * 100 AS raw FROM f),
    s AS (SELECT *, raw * (1 - (CAST(mitigation AS DOUBLE) - 1) / 5) AS adj FROM r)"""
LEVEL_SQL = "CASE WHEN {0} >= 71 THEN 'severe' WHEN {0} >= 41 THEN 'high' WHEN {0} >= 21 THEN 'moderate' ELSE 'low' END"


@query(f"WITH {FACTOR_SQL} SELECT factor, round(raw, 2) AS raw_score, round(adj, 2) AS adjusted_score, {LEVEL_SQL.format('adj')} AS risk_level FROM s")
def risk_factor_scores(spark, sf_dir):
    return risk.score_factors(supplier_factors(spark, sf_dir)).select("factor", "raw_score", "adjusted_score", "risk_level")


@query(f"""
    WITH {FACTOR_SQL}, t AS (SELECT model, round(adj, 2) AS a, row_number() OVER (PARTITION BY model ORDER BY round(adj, 2) DESC) AS k FROM s),
    o AS (SELECT model, 0.6 * max(a) + 0.4 * avg(a) AS o FROM t WHERE k <= 3 GROUP BY 1) SELECT model, round(o, 2) AS risk_score, {LEVEL_SQL.format('o')} AS risk_level FROM o""")
def risk_model(spark, sf_dir):
    return risk.score_model(risk.score_factors(supplier_factors(spark, sf_dir)), ["model"])


@query("""
    SELECT s_suppkey AS scenario, round(CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal * ((s_suppkey % 10) / 10.0)::DOUBLE * 0.5 END, 6) + 0.0 AS impacted_value FROM supplier""")
def scenario_impacts(spark, sf_dir):
    shock = (F.col("s_suppkey") % 10) / F.lit(10.0)
    value = risk.scenario_impact(F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal")), shock, F.lit(0.5))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scenario"), (F.round(value, 6) + F.lit(0.0)).alias("impacted_value"))


@query("""
    WITH f AS (SELECT s_nationkey AS model, count(*) AS n, avg(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 + 1.0 ELSE 3 END)::DOUBLE AS c FROM supplier GROUP BY 1),
    s AS (SELECT model, greatest(0, least(100, 20 + least(25, model * 5.0) + least(20, n * 4.0) + least(20, (model % 3) * 5.0) + least(20, 2 * 4.0) - least(35, (model % 7) * 4.0) + c)) AS s FROM f)
    SELECT model, round(s::DOUBLE, 2) AS confidence_score, CASE WHEN s >= 75 THEN 'high' WHEN s >= 45 THEN 'moderate' ELSE 'low' END AS confidence_level FROM s""")
def confidence(spark, sf_dir):
    rows = supplier_factors(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.avg(numbers.clamp(F.col("confidence"), 1, 5, 3)).alias("c"))
    score, level = risk.confidence_score(F.col("model"), F.col("n"), F.col("model") % 3, F.lit(2), F.col("model") % 7, F.col("c"))
    return rows.select("model", score.alias("confidence_score"), level.alias("confidence_level"))


# ---------------------------------------------------------------- graph


def ids_at(kind: str, keys: list[str]) -> list[int]:
    """The ids of those keys that are of a kind."""
    found = (re.fullmatch(rf"{kind}::(-?[0-9]+)", k or "") for k in keys)
    return [i for i in (int(m[1]) for m in found if m) if -(2**63) <= i < 2**63]


def kg_nodes(spark, sf_dir):
    """key, name, entity_type, description of regions, nations, suppliers and parts."""
    return nodes_near(spark, sf_dir)()


def nodes_near(spark, sf_dir) -> Callable[..., DataFrame]:
    """A function of keys: the nodes that have one of them, filtered by the sources' own ids; all without keys."""
    sources = [("region", "region", "r_regionkey", "r_name"), ("nation", "country", "n_nationkey", "n_name"), ("supplier", "company", "s_suppkey", "s_name"), ("part", "product", "p_partkey", "p_name")]
    tables = {table: read(spark, sf_dir, table) for table, *_ in sources}

    def near(keys: list[str] | None = None) -> DataFrame:
        def of(table, kind, ref, name):
            rows = tables[table] if keys is None else tables[table].filter(F.col(ref).isin(ids_at(kind, keys)))
            return rows.select(F.concat(F.lit(f"{kind}::"), F.col(ref)).alias("key"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), F.concat_ws(" ", F.lit(kind), F.col(name)).alias("description"))

        first, *rest = (of(*x) for x in sources)
        return reduce(DataFrame.unionByName, rest, first)

    return near


def kg_claims(spark, sf_dir):
    """claim_key, subject_key, relation, object_key, subject_type, object_type, grounding_score."""
    return claims_near(spark, sf_dir)()


def claims_near(spark, sf_dir) -> Callable[..., DataFrame]:
    """A function of keys: the claims that have one of them as an end, filtered by the sources' own ids; all without keys."""
    def rows(df, subject_type, subject, relation, object_type, obj, score):
        s, o = F.concat(F.lit(f"{subject_type}::"), F.col(subject)), F.concat(F.lit(f"{object_type}::"), F.col(obj))
        return df.select(graph.claim_key(s, F.lit(relation), o).alias("claim_key"), s.alias("subject_key"), F.lit(relation).alias("relation"), o.alias("object_key"), F.lit(subject_type).alias("subject_type"), F.lit(object_type).alias("object_type"), score.cast("double").alias("grounding_score"))

    supplier, nation, lineitem = (read(spark, sf_dir, t) for t in ("supplier", "nation", "lineitem"))

    def near(keys: list[str] | None = None) -> DataFrame:
        def at(df, subject_type, subject, object_type, obj):
            return df if keys is None else df.filter(F.col(subject).isin(ids_at(subject_type, keys)) | F.col(obj).isin(ids_at(object_type, keys)))

        supplies = at(lineitem, "company", "l_suppkey", "product", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
        return (
            rows(at(supplier, "company", "s_suppkey", "country", "s_nationkey"), "company", "s_suppkey", "located_in", "country", "s_nationkey", F.lit(0.9))
            .unionByName(rows(at(nation, "country", "n_nationkey", "region", "n_regionkey"), "country", "n_nationkey", "located_in", "region", "n_regionkey", F.lit(0.8)))
            .unionByName(rows(supplies, "company", "l_suppkey", "produces", "product", "l_partkey", F.round(F.col("q") / 100, 2)))
        )

    return near


CLAIM_SQL = """
    cl AS (SELECT 'company::' || s_suppkey AS s, 'located_in' AS r, 'country::' || s_nationkey AS o, 'company' AS st, 'country' AS ot, 0.9::DOUBLE AS g FROM supplier
        UNION ALL SELECT 'country::' || n_nationkey, 'located_in', 'region::' || n_regionkey, 'country', 'region', 0.8 FROM nation
        UNION ALL SELECT 'company::' || l_suppkey, 'produces', 'product::' || l_partkey, 'company', 'product', round(max(l_quantity) / 100, 2) FROM lineitem GROUP BY l_suppkey, l_partkey),
    c AS (SELECT s || '|' || r || '|' || o AS claim_key, * FROM cl),
    ev AS (SELECT claim_key, CAST(('0x' || substr(md5(claim_key), 1, 6)) AS BIGINT) % (SELECT count(*) FROM documents) AS evidence_id FROM c WHERE CAST(('0x' || substr(md5(claim_key), 7, 2)) AS BIGINT) < 128)"""


def kg_links(spark, sf_dir, claims: DataFrame) -> DataFrame:
    """claim_key, evidence_id: half of the claims have a document as evidence, both chosen by their hash."""
    h = lambda at, n: F.conv(F.substring(F.md5("claim_key"), at, n), 16, 10).cast("long")
    total = F.broadcast(read(spark, sf_dir, "documents").agg(F.count("*").alias("total")))  # one row
    return claims.filter(h(7, 2) < 128).join(total).select("claim_key", (h(1, 6) % F.col("total")).alias("evidence_id"))


@query(f"WITH {CLAIM_SQL} SELECT s AS subject_key, r AS relation, o AS object_key, claim_key, g AS grounding_score FROM c")
def kg_rel_projection(spark, sf_dir):
    return graph.projection(kg_claims(spark, sf_dir))


@query(f"""
    WITH {CLAIM_SQL} SELECT s AS subject_key, o AS object_key, claim_key, ev.evidence_id, length(text) AS evidence_chars FROM c JOIN ev USING (claim_key) JOIN documents ON doc_id = evidence_id WHERE s LIKE 'company::%'""")
def claim_evidence_join(spark, sf_dir):
    claims = kg_claims(spark, sf_dir)
    evidence = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.length("text").alias("evidence_chars"))
    anchors = read(spark, sf_dir, "supplier").select(F.concat(F.lit("company::"), "s_suppkey").alias("subject_key"))
    rows = graph.claim_evidence(graph.projection(claims), claims.withColumn("claim_text", F.col("claim_key")), kg_links(spark, sf_dir, claims), evidence, anchors)
    return rows.select("subject_key", "object_key", "claim_key", "evidence_id", "evidence_chars")


FRONTIER = ["country::1", "country::2", "company::5"]
FRONTIER_SQL = "('" + "', '".join(FRONTIER) + "')"


@query(f"""
    WITH {CLAIM_SQL}, e AS (SELECT s AS from_key, o AS to_key, 'forward' AS direction, claim_key FROM c UNION ALL SELECT o, s, 'backward', claim_key FROM c)
    SELECT from_key, to_key, direction, claim_key, evidence_id FROM e LEFT JOIN ev USING (claim_key) WHERE from_key IN {FRONTIER_SQL}""")
def frontier_one_hop(spark, sf_dir):
    claims = kg_claims(spark, sf_dir)
    keys = spark.createDataFrame([(k,) for k in FRONTIER], "key string")
    return graph.one_hop(keys, graph.projection(claims), kg_links(spark, sf_dir, claims)).select("from_key", "to_key", "direction", "claim_key", "evidence_id")


@query(f"""
    WITH {CLAIM_SQL}, k AS (SELECT unnest(['{"', '".join(FRONTIER)}']) AS key), ends AS (SELECT s AS key, claim_key FROM c UNION ALL SELECT o, claim_key FROM c)
    SELECT DISTINCT key, evidence_id FROM k LEFT JOIN ends USING (key) LEFT JOIN ev USING (claim_key) WHERE key <> 'country::2' UNION ALL SELECT 'country::2', unnest([900001, 900002])""")
def frontier_evidence(spark, sf_dir):
    claims = kg_claims(spark, sf_dir)
    keys = spark.createDataFrame([(k,) for k in FRONTIER], "key string")
    own = spark.createDataFrame([("country::2", 900001), ("country::2", 900002), ("country::9", 900003)], "node_key string, evidence_id long")
    return graph.frontier_evidence(keys, own, claims, kg_links(spark, sf_dir, claims))


@query(f"""
    WITH RECURSIVE {CLAIM_SQL}, st AS (SELECT DISTINCT s, o FROM c WHERE r = 'located_in'),
    p AS (SELECT s AS start_key, o AS end_key, 1 AS hops, [s, o] AS n FROM st
          UNION ALL SELECT start_key, st.o, hops + 1, list_append(n, st.o) FROM p JOIN st ON st.s = end_key WHERE hops < 3 AND NOT list_contains(n, st.o))
    SELECT start_key, end_key, hops, array_to_string(n, ' > ') AS nodes FROM p""")
def paths_depth_1_3(spark, sf_dir):
    edges = graph.projection(kg_claims(spark, sf_dir)).filter("relation = 'located_in'")
    return graph.paths(edges, edges.select(F.col("subject_key").alias("key")), 3)


@query(f"WITH {CLAIM_SQL} SELECT st AS subject_type, r AS relation, ot AS object_type, count(*) AS n FROM c WHERE (st, r, ot) NOT IN ({', '.join(f"('{a}', '{r}', '{b}')" for r, (x, y) in graph.SIGNATURES.items() for a in x for b in y)}) GROUP BY ALL")
def signature_violations(spark, sf_dir):
    bad = ~graph.signature_is_valid(F.col("subject_type"), F.col("relation"), F.col("object_type"))
    return kg_claims(spark, sf_dir).filter(bad).groupBy("subject_type", "relation", "object_type").agg(F.count("*").alias("n"))


@query(f"""
    WITH {CLAIM_SQL}, d AS (SELECT key, count(*) AS degree FROM (SELECT s AS key FROM c UNION ALL SELECT o FROM c) GROUP BY 1),
    n AS (SELECT 'region::' || r_regionkey AS key, 'region ' || r_name AS t FROM region UNION ALL SELECT 'country::' || n_nationkey, 'country ' || n_name FROM nation
          UNION ALL SELECT 'company::' || s_suppkey, 'company ' || s_name FROM supplier UNION ALL SELECT 'product::' || p_partkey, 'product ' || p_name FROM part)
    SELECT key, CAST(contains(lower(t), 'product') AS INTEGER) + CAST(contains(lower(t), 'blue') AS INTEGER) + CAST(contains(lower(t), 'bolt') AS INTEGER) AS hits, coalesce(degree, 0) AS degree
    FROM n LEFT JOIN d USING (key)""")
def node_degree_rank(spark, sf_dir):
    return graph.ranked_nodes(kg_nodes(spark, sf_dir), graph.projection(kg_claims(spark, sf_dir)), "which product is the blue bolt")


@query(f"WITH {CLAIM_SQL} SELECT claim_key, round(g + 0.15 * (CAST(contains(s || ' ' || r || ' ' || o, 'company') AS INTEGER) + CAST(contains(s || ' ' || r || ' ' || o, 'region') AS INTEGER)), 6) AS relevance FROM c")
def edge_rank(spark, sf_dir):
    rows = graph.edge_relevance(graph.projection(kg_claims(spark, sf_dir)), "what company is in this region")
    return rows.select("claim_key", F.round("relevance", 6).alias("relevance"))


@query("""
    WITH v AS (SELECT 'company::' || s_suppkey AS key, s_name AS name, 'unknown' AS t, '' AS d, 0 AS seq, CAST(s_nationkey AS VARCHAR) AS p FROM supplier
               UNION ALL SELECT 'company::' || s_suppkey, upper(s_name), 'company', 'balance ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR), 1, 'x' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT key, arg_min(name, seq) AS name, coalesce(arg_min(t, seq) FILTER (t <> 'unknown'), 'unknown') AS entity_type, arg_min(d, seq) FILTER (trim(d) <> '') AS description, arg_max(p, seq) AS properties, CASE WHEN count(*) > 1 THEN 'Company,Entity' ELSE 'Entity' END AS labels, count(*) AS versions
    FROM v GROUP BY key""")
def node_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier")
    key = F.concat(F.lit("company::"), F.col("s_suppkey"))
    one = rows.select(key.alias("key"), F.col("s_name").alias("name"), F.lit("unknown").alias("entity_type"), F.lit("").alias("description"), F.lit(0).alias("seq"), F.col("s_nationkey").cast("string").alias("properties"), F.array(F.lit("Entity")).alias("labels"))
    two = rows.filter("s_suppkey % 2 = 0").select(key.alias("key"), F.upper("s_name").alias("name"), F.lit("company").alias("entity_type"), F.concat(F.lit("balance "), F.floor("s_acctbal").cast("string")).alias("description"), F.lit(1).alias("seq"), F.concat(F.lit("x"), F.col("s_suppkey")).alias("properties"), F.array(F.lit("Company")).alias("labels"))
    return graph.upsert_nodes(one.unionByName(two)).withColumn("labels", F.array_join("labels", ","))


@query("""
    WITH v AS (SELECT 'company::' || l_suppkey || '|' || l_returnflag AS edge_key, l_quantity / 100 AS g, CASE WHEN l_linenumber > 1 THEN 'line ' || l_linenumber ELSE '' END AS d, l_orderkey * 10 + l_linenumber AS seq, l_partkey % 7 AS e FROM lineitem)
    SELECT edge_key, max(g) AS grounding_score, arg_min(d, seq) FILTER (d <> '') AS description, string_agg(DISTINCT CAST(e AS VARCHAR), ',' ORDER BY CAST(e AS VARCHAR)) AS evidence_ids, count(*) AS versions FROM v GROUP BY 1""")
def edge_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("company::"), F.col("l_suppkey"), F.lit("|"), F.col("l_returnflag")).alias("edge_key"), (F.col("l_quantity") / 100).alias("grounding_score"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("line "), F.col("l_linenumber"))).otherwise("").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 7).alias("evidence_id"),
    )
    return graph.upsert_edges(rows).select("edge_key", "grounding_score", "description", F.array_join("evidence_ids", ",").alias("evidence_ids"), "versions")


# ---------------------------------------------------------------- vectors


KNN_SQL = """
    q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id AS id, label, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 9) AS sim FROM q, embeddings WHERE vec_id <> query_id)"""


def knn(spark, sf_dir, k, vectors_filter=None):
    rows = read(spark, sf_dir, "embeddings")
    return vectors.nearest(rows.filter("vec_id % 100 = 0"), rows.filter(vectors_filter) if vectors_filter else rows, k, "vec_id", "embedding")


@query(f"WITH {KNN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS score FROM r WHERE rank <= 8")
def knn_topk(spark, sf_dir):
    return rounded(knn(spark, sf_dir, 8), 6, "score")


@query(f"WITH {KNN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS score FROM r WHERE rank <= 40 AND label IN (1, 2, 3)")
def knn_scoped(spark, sf_dir):
    """The k best first, the scope after that: fewer than k rows may be left."""
    scope = read(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 2, 3)).select(F.col("vec_id").alias("id"))
    return rounded(knn(spark, sf_dir, 40).join(scope, "id"), 6, "score").select("query_id", "id", "rank", "score")


@query(f"""
    WITH {KNN_SQL}, a AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS k FROM s), b AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS k FROM s WHERE label = 0)
    SELECT query_id, id, round(max(sim), 6) AS score, string_agg(lane, '+' ORDER BY lane) AS lanes FROM (SELECT *, 'all' AS lane FROM a WHERE k <= 8 UNION ALL SELECT *, 'tables' FROM b WHERE k <= 5) GROUP BY ALL""")
def knn_lane_union(spark, sf_dir):
    lanes = knn(spark, sf_dir, 8).withColumn("lane", F.lit("all")).unionByName(knn(spark, sf_dir, 5, "label = 0").withColumn("lane", F.lit("tables")))
    return lanes.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_list("lane")), "+").alias("lanes"))


@query(f"""
    WITH {KNN_SQL}, r AS (SELECT query_id, arg_max(id, struct_pack(s := sim, i := -id)) AS id, max(sim) AS sim FROM s GROUP BY 1)
    SELECT query_id, CASE WHEN sim >= 0.85 THEN id ELSE query_id END AS resolved_id, CASE WHEN sim >= 0.85 THEN 'merge' ELSE 'new' END AS decision FROM r""")
def entity_resolution(spark, sf_dir):
    """Merge into the nearest candidate above the provider's threshold, else a new key."""
    best = knn(spark, sf_dir, 1)
    merge = F.col("score") >= 0.85
    return best.select("query_id", F.when(merge, F.col("id")).otherwise(F.col("query_id")).alias("resolved_id"), F.when(merge, "merge").otherwise("new").alias("decision"))


# ---------------------------------------------------------------- verdicts


FIELDS = {
    "decision": ("doc_id + quality", ["accept", "coarsen", "reject"]),
    "support": ("doc_id", list(verdicts.SUPPORT)),
    "specificity": ("doc_id * 3 + toxic", list(verdicts.PENALTIES["specificity"])),
    "entity_grounding": ("doc_id * 7", list(verdicts.PENALTIES["entity_grounding"])),
    "temporal_grounding": ("doc_id * 11", list(verdicts.PENALTIES["temporal_grounding"])),
    "relation_grounding": ("doc_id * 13 + quality", list(verdicts.PENALTIES["relation_grounding"])),
}


def raw_verdicts(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumns({f: pick(*how) for f, how in FIELDS.items()})
    return rows.withColumns({"candidate": F.expr("doc_id % 50"), "evidence_id": F.col("doc_id")})


def _table_sql(field: str, table: dict, default: float) -> str:
    return "CASE " + field + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


VERDICT_SQL = f"""
    v0 AS (SELECT doc_id, doc_id % 50 AS candidate, {", ".join(f"{pick_sql(*how)} AS {f}" for f, how in FIELDS.items())} FROM labels),
    v1 AS (SELECT * REPLACE (CASE WHEN decision = 'coarsen' AND doc_id % 2 = 1 THEN 'reject' ELSE decision END AS decision) FROM v0),
    v AS (SELECT *, round(greatest(0, least(1, CAST({_table_sql('support', verdicts.SUPPORT, 0.35)} - {" - ".join(_table_sql(f, t, 0.08) for f, t in verdicts.PENALTIES.items())}
          - {_table_sql('decision', verdicts.DECISIONS, 0)} AS DOUBLE))), 3) AS score FROM v1)"""


def normal_verdicts(spark, sf_dir):
    return verdicts.normalize(raw_verdicts(spark, sf_dir), F.col("doc_id") % 2 == 0)


@query(f"WITH {VERDICT_SQL} SELECT doc_id, decision, score AS grounding_score FROM v")
def verdict_scores(spark, sf_dir):
    return normal_verdicts(spark, sf_dir).select("doc_id", "decision", "grounding_score")


RANK_SQL = f"struct_pack(d := {_table_sql('decision', verdicts.DECISION_RANK, 0)}, s := {_table_sql('support', verdicts.SUPPORT_RANK, 0)}, g := score, o := -doc_id)"


@query(f"""
    WITH {VERDICT_SQL} SELECT candidate, arg_max(decision, {RANK_SQL}) AS decision, arg_max(support, {RANK_SQL}) AS support, arg_max(score, {RANK_SQL}) AS grounding_score, count(*) AS verdicts,
        CASE WHEN count(*) FILTER (decision <> 'reject') > 0 THEN string_agg(doc_id, ',' ORDER BY doc_id) FILTER (decision <> 'reject') ELSE string_agg(doc_id, ',' ORDER BY doc_id) END AS evidence_ids FROM v GROUP BY 1""")
def verdict_argmax(spark, sf_dir):
    out = verdicts.aggregate(normal_verdicts(spark, sf_dir), "candidate", "doc_id")
    return out.select("candidate", "decision", "support", "grounding_score", "verdicts", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query(f"WITH {VERDICT_SQL} SELECT candidate, count(*) AS kept FROM v WHERE decision IN ('accept', 'coarsen') GROUP BY 1")
def verdict_filtered(spark, sf_dir):
    return normal_verdicts(spark, sf_dir).filter(F.col("decision").isin("accept", "coarsen")).groupBy("candidate").agg(F.count("*").alias("kept"))


@query("""
    WITH c AS (SELECT doc_id AS candidate, unnest([doc_id * 2, doc_id * 3 + 1]) AS evidence_id FROM labels), j AS (SELECT DISTINCT candidate, doc_id FROM c LEFT JOIN documents ON doc_id = evidence_id)
    SELECT candidate, count(doc_id) AS evidence, CASE WHEN count(doc_id) > 0 THEN 'pointer' ELSE 'fallback' END AS route FROM j GROUP BY 1""")
def candidate_pointer_split(spark, sf_dir):
    """Candidates with evidence pointers into the store, and those left for the fallback."""
    pointers = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("candidate"), F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 3 + 1)).alias("evidence_id"))
    store = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.lit(1).alias("there"))
    rows = pointers.distinct().join(store, "evidence_id", "left").groupBy("candidate").agg(F.count("there").alias("evidence"))
    return rows.withColumn("route", F.when(F.col("evidence") > 0, "pointer").otherwise("fallback"))


# ---------------------------------------------------------------- reasoning


PLAN = reasoning.Plan(
    question="how does the blue bolt depend on a region",
    start={"s1": ["blue bolt"]}, bridge={"b1": ["supplier"]}, terminal={"t1": ["region"]},
)


def subgraph(spark, sf_dir):
    """All nodes and claims; starts and beam bound what a question takes of them."""
    nodes, edges = searched(spark, sf_dir)
    return nodes(), edges()


def searched(spark, sf_dir):
    """The nodes and claims of `subgraph`, both as functions of keys."""
    nodes, claims = nodes_near(spark, sf_dir), claims_near(spark, sf_dir)
    return (
        lambda keys=None: nodes(keys).select("key", F.col("name").alias("label"), F.col("entity_type").alias("node_type"), "description"),
        lambda keys=None: claims(keys).select(F.col("claim_key").alias("key"), "subject_key", "object_key", "relation", F.lit("").alias("description"), F.lit(True).alias("supported")),
    )


@query("""
    WITH n AS (SELECT 'region::' || r_regionkey AS key, r_name AS name, 'region' AS kind FROM region UNION ALL SELECT 'country::' || n_nationkey, n_name, 'country' FROM nation UNION ALL SELECT 'company::' || s_suppkey, s_name, 'company' FROM supplier UNION ALL SELECT 'product::' || p_partkey, p_name, 'product' FROM part),
    t AS (SELECT key, trim(regexp_replace(lower(concat_ws(' ', name, kind, kind, name)), '[^a-z0-9]+', ' ', 'g')) AS t FROM n),
    s AS (SELECT key, CASE WHEN contains(t, 'blue bolt') THEN 0.9 ELSE (contains(t, 'blue')::INTEGER + contains(t, 'bolt')::INTEGER) / 2.0 END AS a, CASE WHEN contains(t, 'region') THEN 0.9 ELSE 0 END AS b FROM t)
    SELECT key, greatest(a, b)::DOUBLE AS similarity, CASE WHEN a >= b THEN 'blue bolt' ELSE 'region' END AS matched_concept FROM s WHERE greatest(a, b) >= 0.2 ORDER BY 2 DESC, key LIMIT 8""")
def start_match(spark, sf_dir):
    return reasoning.match_starts(subgraph(spark, sf_dir)[0], ["blue bolt", "region"], PLAN)


@query()
def beam_paths(spark, sf_dir):
    nodes, edges = searched(spark, sf_dir)
    starts = reasoning.match_starts(nodes(), ["blue bolt"], PLAN).select("key")
    out = reasoning.beam_paths(nodes, edges, starts, PLAN)
    return out.select("path_key", "hops", F.round("score", 4).alias("score"), F.concat_ws(",", "covered").alias("covered"))


@query()
def path_select(spark, sf_dir):
    nodes, edges = searched(spark, sf_dir)
    starts = reasoning.match_starts(nodes(), ["blue bolt"], PLAN).select("key")
    kept = reasoning.select_paths(reasoning.beam_paths(nodes, edges, starts, PLAN), PLAN)
    gaps = reasoning.assess_gaps(kept, PLAN)
    rows = [(i, " > ".join(p["nodes"]), p["score"], ",".join(p["covered"]), gaps["status"]) for i, p in enumerate(kept, 1)]
    return spark.createDataFrame(rows, "rank int, path string, score double, covered string, status string")


@query(r"""
    WITH t AS (SELECT conv_id, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations),
    q AS (SELECT *, CASE WHEN length(x) <= 300 THEN x ELSE rtrim(substr(x, 1, 297)) || '...' END AS s, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY r) AS u FROM t WHERE r <= 5)
    SELECT conv_id, count(*) AS turns, CAST(count(*) FILTER (role = 'user') AS INTEGER) AS n_questions, CAST(count(*) FILTER (role = 'assistant') AS INTEGER) AS n_answers,
        CASE WHEN count(*) FILTER (role = 'user') > 0 THEN 'Prior questions: ' || string_agg(s, '; ' ORDER BY r DESC) FILTER (role = 'user' AND u <= 3) ELSE 'No prior investigation history supplied.' END AS summary FROM q GROUP BY 1""")
def memory_last5(spark, sf_dir):
    return memory.last_turns(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


# ---------------------------------------------------------------- scopes, budgets and keys


@query("SELECT s_suppkey, s_suppkey % 4 < 3 AS inside FROM supplier")
def scoped_nodes(spark, sf_dir):
    """In scope by the list, by the latest value or by the single one."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k, F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("x"))).alias("run_ids"), F.when(k % 4 == 1, "x").alias("latest_run_id"), F.when(k % 4 == 2, "x").otherwise("y").alias("run_id"))
    return rows.select(k, graph.in_scope("run_id", "x").alias("inside"))


@query("""
    WITH t AS (SELECT conv_id, turn, left(coalesce(text, ''), 200) AS x FROM conversations), u AS (SELECT *, sum(length(x)) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t)
    SELECT conv_id, turn, length(x) AS n_chars, length(x) >= 200 AS truncated FROM u WHERE used <= 500 OR k = 1""")
def blocks_within_budget(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return blocks.within_budget(rows, "conv_id", "turn", "text", 200, 500).select("conv_id", "turn", F.char_length("text").alias("n_chars"), "truncated")


@query("SELECT count(DISTINCT event_type || '|' || (event_id % 3) || '|' || props) AS keys, count(*) AS events FROM events")
def cache_keys(spark, sf_dir):
    """Equal requests have equal keys, and others have others."""
    key = ledger.cache_key(F.col("event_type"), F.lit("chat"), (F.col("event_id") % 3).cast("string"), F.col("props"))
    return read(spark, sf_dir, "events").agg(F.count_distinct(key).alias("keys"), F.count("*").alias("events"))


@query(r"SELECT p_partkey, 'product::' || trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def node_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", graph.node_key(F.lit(" Product"), F.concat_ws(" ", "p_name", "p_brand")).alias("key"))


@query(f"WITH {CLAIM_SQL}, d AS (SELECT key, count(*) AS degree FROM (SELECT s AS key FROM c UNION ALL SELECT o FROM c) GROUP BY 1) SELECT key FROM d ORDER BY degree DESC, key DESC LIMIT 8")
def fallback_starts(spark, sf_dir):
    """The nodes with most edges, where no start matches: a top-k."""
    edges = graph.projection(kg_claims(spark, sf_dir))
    return reasoning.fallback_starts(edges, 8)


# ---------------------------------------------------------------- ledger and evaluation


def ledger_events(spark, sf_dir):
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("stage"), F.concat(F.lit("model_"), (k % 3).cast("string")).alias("model"), F.when(k % 4 == 0, "embed").otherwise("chat").alias("operation"),
        F.when(k % 5 == 0, "hit").when(k % 7 == 0, "bypass").otherwise("miss").alias("cache_status"), (k % 1000).alias("input_tokens"), F.floor("value").cast("long").alias("output_tokens"), F.when(k % 50 == 0, "timeout").alias("error"),
    )
    pricing = spark.createDataFrame([("model_0", 2.5, 10.0), ("model_1", 0.15, 0.6)], "model string, input_per_1m double, output_per_1m double")
    return ledger.cost_usd(rows, pricing)


LEDGER_SQL = """
    l0 AS (SELECT event_id, event_type AS stage, 'model_' || (event_id % 3) AS model, CASE WHEN event_id % 4 = 0 THEN 'embed' ELSE 'chat' END AS operation,
              CASE WHEN event_id % 5 = 0 THEN 'hit' WHEN event_id % 7 = 0 THEN 'bypass' ELSE 'miss' END AS cache_status, event_id % 1000 AS i, CAST(floor(value) AS BIGINT) AS o, CASE WHEN event_id % 50 = 0 THEN 'timeout' END AS error FROM events),
    l AS (SELECT *, CASE event_id % 3 WHEN 0 THEN round(i / 1e6 * 2.5 + o / 1e6 * 10, 10) WHEN 1 THEN round(i / 1e6 * 0.15 + o / 1e6 * 0.6, 10) END AS cost FROM l0)"""
ROLLUP_SQL = "count(*) AS events, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(cost), 6) AS cost, round(sum(cost) FILTER (cache_status <> 'hit'), 6) AS missed_cost, count(error) AS errors FROM l"


@query(f"WITH {LEDGER_SQL} SELECT 'total' AS dimension, 'all' AS value, {ROLLUP_SQL} " + " ".join(f"UNION ALL SELECT '{d}', {d}, {ROLLUP_SQL} GROUP BY {d}" for d in ledger.KNOWN))
def ledger_rollup(spark, sf_dir):
    return ledger.rollup(ledger_events(spark, sf_dir))


@query(f"WITH {LEDGER_SQL} SELECT event_id, model, cost AS estimated_cost_usd FROM l")
def ledger_cost(spark, sf_dir):
    return ledger_events(spark, sf_dir).select("event_id", "model", "estimated_cost_usd")


STAGES = ["acquire", "extract", "fuse"]


@query("""
    WITH r AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'acquire' WHEN 1 THEN 'extract' WHEN 2 THEN 'fuse' ELSE 'other' END AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events),
    g AS (SELECT * FROM (SELECT unnest(['acquire', 'extract', 'fuse']) AS stage), (SELECT unnest(['success', 'failed', 'skipped', 'missing']) AS status))
    SELECT stage, status, CASE WHEN status = 'missing' THEN (SELECT count(DISTINCT user_id) FROM r) - (SELECT count(DISTINCT user_id) FROM r WHERE r.stage = g.stage)
        ELSE (SELECT count(DISTINCT user_id) FROM r WHERE r.stage = g.stage AND r.status = g.status) END AS n FROM g""")
def stage_matrix(spark, sf_dir):
    k = F.col("event_id") % 4
    rows = read(spark, sf_dir, "events").select("user_id", F.when(k == 0, "acquire").when(k == 1, "extract").when(k == 2, "fuse").otherwise("other").alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return ledger.stage_matrix(rows, STAGES, ["success", "failed", "skipped"], "user_id", "stage", "status")


SYSTEMS = ["gpt_memo", "simple_rag", "graph"]
TASKS = ["lookup", "multi_hop", "forecast"]


def eval_rows(spark, sf_dir):
    """Questions by systems; scores from ids, some blank and filled by judgements, some blank for good."""
    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), pick("item_id", TASKS).alias("task_type"))
    sheet = evals.score_sheet(questions, SYSTEMS).withColumn("n", F.array_position(F.array(*(F.lit(s) for s in SYSTEMS)), F.col("system")))
    sheet = sheet.withColumns({m: F.when((F.col("question_id") + i) % 4 != 0, ((F.col("question_id") + F.col("n") * (i + 1)) % 5 + 1).cast("int")) for i, m in enumerate(evals.METRICS)})
    judgements = sheet.filter("question_id % 2 = 0").select("question_id", "system", *(F.lit(4 + i % 3).alias(m) for i, m in enumerate(evals.METRICS)))
    return evals.judged(sheet.drop("n"), judgements)


EVAL_SQL = f"""
    q AS (SELECT item_id AS question_id, {pick_sql('item_id', TASKS)} AS task_type FROM benchmark), y AS (SELECT unnest(['{"', '".join(SYSTEMS)}']) AS system, unnest([1, 2, 3]) AS n),
    ev AS (SELECT question_id, task_type, system, {", ".join(f"CAST(CASE WHEN (question_id + {i}) % 4 <> 0 THEN (question_id + n * {i + 1}) % 5 + 1 WHEN question_id % 2 = 0 AND {4 + i % 3} <= 5 THEN {4 + i % 3} END AS INTEGER) AS {m}" for i, m in enumerate(evals.METRICS))} FROM q, y)"""


@query(f"WITH {EVAL_SQL} SELECT * FROM ev")
def eval_matrix(spark, sf_dir):
    return eval_rows(spark, sf_dir).select("question_id", "task_type", "system", *evals.METRICS)


@query(f"WITH {EVAL_SQL} SELECT system, CASE WHEN grouping(task_type) = 1 THEN 'all' ELSE task_type END AS task_type, {', '.join(f'round(avg({m}), 3) AS {m}' for m in evals.METRICS)} FROM ev GROUP BY GROUPING SETS ((system), (task_type, system))")
def eval_aggregate(spark, sf_dir):
    return evals.means(eval_rows(spark, sf_dir), evals.METRICS)


# ---------------------------------------------------------------- streams


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_ledger(spark, sf_dir):
    """The batch form of the windowed stream; tests/test_streaming.py runs the same function on a stream."""
    return rounded(stream.windowed(read(spark, sf_dir, "events"), "ts", ["event_type"], "value"), 4, "total")


@query("""
    WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return stream.sessions(read(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
