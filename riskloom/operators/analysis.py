"""A risk model in one call: parsed from JSON, its table requests executed, scored, and told as a memo.

Blocks are DataFrames by block id. A request names one operation and its columns; what it finds
comes back as rows, and what is wrong with it as a row too, so that one bad request never stops
the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numbers import clamp, risk_float
from riskloom.operators import risk, tables, timeseries

MODEL = """risk_factors array<struct<name:string,mechanism:string,severity:string,likelihood:string,exposure:string,mitigation:string,confidence:string,evidence_ids:array<string>,required_variables:array<string>>>,
    quantitative_variables array<struct<name:string,value:string,unit:string,entity:string,period:string,evidence_ids:array<string>>>,
    table_analysis_requests array<struct<block_id:string,operation:string,columns:array<string>,group_by:string,value_column:string,n:string,baseline_start:string,baseline_end:string,shock_start:string,shock_end:string,date_column:string>>,
    scenarios array<struct<name:string,exposure_value:string,shock_pct:string,pass_through_pct:string>>,
    missing_variables array<string>"""


def named(c: str, fallback: str):
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(fallback)).alias("name")


def parse_model(models: DataFrame, model: str, text: str) -> dict[str, DataFrame]:
    """factors, variables, requests, scenarios and missing, each with the model's id; from a column of JSON texts.

    Values that are no numbers make a factor's score its least and leave a variable out. What factors require is missing too.
    """
    read = models.select(F.col(model).alias("model"), F.from_json(text, MODEL).alias("m"))
    part = lambda name: read.select("model", F.posexplode(f"m.{name}").alias("place", "x")).filter("x IS NOT NULL").select("model", "place", "x.*")
    score = lambda c, default=1: clamp(F.col(c).try_cast("double"), 1, 5, default).alias(c)
    raw = part("risk_factors")
    factors = raw.select("model", "place", named("name", "unnamed factor"), F.coalesce("mechanism", F.lit("")).alias("mechanism"), *(score(c) for c in ("severity", "likelihood", "exposure", "mitigation")), score("confidence", 3), "evidence_ids")
    variables = part("quantitative_variables").select("model", "place", named("name", "unnamed variable"), risk_float(F.col("value")).alias("value"), "unit", "entity", "period").filter("value IS NOT NULL")
    number = lambda c: risk_float(F.col(c)).alias(c)
    scenarios = part("scenarios").select("model", "place", named("name", "unnamed scenario"), number("exposure_value"), number("shock_pct"), number("pass_through_pct"))
    told = read.select("model", F.lit(0).alias("source"), F.posexplode("m.missing_variables").alias("place", "variable"))
    needed = raw.select("model", F.lit(1).alias("source"), "place", F.explode("required_variables").alias("variable"))
    missing = told.unionByName(needed).withColumn("variable", F.trim("variable")).filter("variable <> ''")
    missing = missing.groupBy("model", "variable").agg(F.min(F.struct("source", "place")).alias("place"))
    return {"factors": factors, "variables": variables, "requests": part("table_analysis_requests"), "scenarios": scenarios, "missing": missing}




def _dates(df: DataFrame, r: dict) -> str:
    """The date column asked for, else the first that is one by type or name."""
    return r.get("date_column") or next((c for c, kind in df.dtypes if kind in ("date", "timestamp", "timestamp_ntz") or "date" in c.lower()), "")


def _series(df: DataFrame, r: dict) -> DataFrame:
    return timeseries.observations(df, _dates(df, r), r["value_column"])


OPERATIONS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "table_summary": lambda df, r: tables.table_summary(df),
    "column_stats": lambda df, r: tables.column_stats(df, r.get("value_column") or (r.get("columns") or [""])[0]),
    "group_sum": lambda df, r: tables.group_sum(df, r["group_by"], r["value_column"]),
    "group_share": lambda df, r: tables.group_share(df, r["group_by"], r["value_column"]),
    "top_n": lambda df, r: tables.top_n(df, r["value_column"], int(r.get("n") or 5), r.get("group_by")),
    "concentration": lambda df, r: tables.concentration_metrics(df, r["value_column"], r.get("group_by")),
    "time_series_summary": lambda df, r: timeseries.time_series_summary(df, _dates(df, r)),
    "percent_change": lambda df, r: timeseries.percent_change(_series(df, r), r.get("baseline_start"), r.get("shock_end") or r.get("baseline_end")),
    "window_change": lambda df, r: timeseries.window_change(_series(df, r), (r["baseline_start"], r["baseline_end"]), (r["shock_start"], r["shock_end"])),
    "volatility": lambda df, r: timeseries.volatility(_series(df, r)),
    "max_drawdown": lambda df, r: timeseries.max_drawdown(_series(df, r)),
}

RESULT = "request int, operation string, block_id string, ok boolean, error string, result string"


def execute(spark: SparkSession, requests: list[dict], blocks: dict[str, DataFrame]) -> DataFrame:
    """request, operation, block_id, ok, error, result: one row per row that a request gives (as JSON), or one with its error.

    Requests are few and their operations are planned one by one; their results stay distributed.
    """
    out = []
    for k, r in enumerate(requests):
        name, block = r.get("operation") or "", r.get("block_id") or ""
        try:
            if block not in blocks:
                raise LookupError("Block not found.")
            if name not in OPERATIONS:
                raise LookupError(f"Unsupported operation: {name}")
            found = OPERATIONS[name](blocks[block], r)
            row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in found.columns)))
            out.append(found.select(F.lit(k).alias("request"), F.lit(name).alias("operation"), F.lit(block).alias("block_id"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), row.alias("result")))
        except (LookupError, TypeError, ValueError, PySparkException) as e:
            out.append(spark.createDataFrame([(k, name, block, False, str(e).split("\n")[0][:300], None)], RESULT))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RESULT)


def assess(parts: dict[str, DataFrame], results: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per model: risk_score, risk_level, confidence_score, confidence_level and the counts behind them.

    parts as from parse_model; results: model, request, ok; evidence: model. Models without factors score 0.
    """
    scored = risk.score_factors(parts["factors"])
    counted = lambda df, name: df.groupBy("model").agg(F.count("*").alias(name))
    every = reduce(DataFrame.union, (parts[k].select("model") for k in ("factors", "variables", "scenarios", "missing"))).distinct()
    rows = every.join(risk.score_model(scored, ["model"]), "model", "left")
    rows = rows.join(scored.groupBy("model").agg(F.count("*").alias("factors"), F.avg("confidence").alias("mean_confidence")), "model", "left")
    done = results.filter("ok").select("model", "request").distinct()
    for name, df in (("variables", parts["variables"]), ("missing", parts["missing"]), ("tables", done), ("evidence", evidence)):
        rows = rows.join(counted(df, name), "model", "left")
    counts = ["factors", "variables", "missing", "tables", "evidence"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    score, level = risk.confidence_score(*(F.col(c) for c in ("evidence", "factors", "variables", "tables", "missing", "mean_confidence")))
    return rows.select("model", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("risk_level", F.lit("low")).alias("risk_level"), score.alias("confidence_score"), level.alias("confidence_level"), *counts)


def _listed(df: DataFrame, heading: str, line, order, most: int | None = None) -> DataFrame:
    """model, lines: a heading and one line per row. A model's parts are as many as one JSON text held."""
    rows = df.select("model", F.struct(order.alias("o"), line.alias("t")).alias("x")).groupBy("model").agg(F.array_sort(F.collect_list("x")).alias("x"))
    lines = F.transform(F.slice("x", 1, most) if most else F.col("x"), lambda v: F.concat(F.lit("- "), v["t"]))
    return rows.select("model", F.concat(F.array(F.lit(""), F.lit(heading)), lines).alias(heading))


def memo(assessed: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """model, memo: the assessment as text, one section per kind of finding that the model has."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    scored = risk.score_factors(parts["factors"])
    impact = risk.scenario_impact(F.col("exposure_value"), F.col("shock_pct"), F.col("pass_through_pct")).cast("string")
    optional = lambda before, c, after: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise(F.lit(""))
    sections = [
        _listed(scored, "Risk factors", F.concat(F.col("name"), F.lit(": "), F.col("risk_level"), F.lit(" ("), text("adjusted_score"), F.lit("/100). "), F.col("mechanism")), F.col("place")),
        _listed(parts["variables"], "Quantitative variables", F.concat(F.col("name"), F.lit(": "), text("value"), optional(" ", "unit", ""), optional(" for ", "entity", ""), optional(" (", "period", ")")), F.col("place")),
        _listed(parts["scenarios"], "Scenarios", F.concat(F.col("name"), F.lit(": impacted value "), F.coalesce(impact, F.lit("unknown"))), F.col("place")),
        _listed(parts["missing"], "Missing variables", F.col("variable"), F.col("place"), 8),
    ]
    rows = assessed
    for s in sections:
        rows = rows.join(s, "model", "left")
    first = F.concat(F.lit("Risk is "), F.upper("risk_level"), F.lit(" ("), F.format_number("risk_score", 1), F.lit(" of 100), held with "), F.col("confidence_level"), F.lit(" confidence ("), F.format_number("confidence_score", 1), F.lit(" of 100)."))
    names = [s.columns[1] for s in sections]
    lines = F.concat(F.array(F.lit("Bottom line"), first), *(F.coalesce(F.col(f"`{n}`"), F.array().cast("array<string>")) for n in names))
    return rows.select("model", F.array_join(lines, "\n").alias("memo"))
