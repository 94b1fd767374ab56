"""The cost ledger: costs, cache keys and rollups of call events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN = ["stage", "model", "operation", "cache_status"]


def cost_usd(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """events with estimated_cost_usd; null where the model has no price. pricing: model, input_per_1m, output_per_1m."""
    priced = events.join(F.broadcast(pricing), "model", "left")  # a price list: one row per model
    parts = [F.col(f"{k}_tokens") / F.lit(1e6) * F.col(f"{k}_per_1m") for k in ("input", "output")]
    known = parts[0].isNotNull() | parts[1].isNotNull()
    cost = F.round(F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)), 10)
    return priced.withColumn("estimated_cost_usd", F.when(known, cost)).drop("input_per_1m", "output_per_1m")


def cache_key(stage: Column, operation: Column, model: Column, payload: Column) -> Column:
    return F.sha2(F.to_json(F.struct(stage.alias("stage"), operation.alias("operation"), model.alias("model"), payload.alias("payload"))), 256)


def rollup(events: DataFrame) -> DataFrame:
    """dimension, value, events, input_tokens, output_tokens, cost, missed_cost, errors: per stage, model, operation, cache status and in total.

    One pass by grouping sets. Costs of cache hits are part of cost and not of missed_cost.
    """
    rows = events.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in KNOWN), "input_tokens", "output_tokens", "estimated_cost_usd", "error")
    sets = [[F.col(c)] for c in KNOWN] + [[]]
    out = rows.groupingSets(sets, *KNOWN).agg(
        F.grouping_id(*KNOWN).alias("g"),
        F.count("*").alias("events"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.round(F.sum("estimated_cost_usd"), 6).alias("cost"),
        F.round(F.sum(F.when(F.col("cache_status") != "hit", F.col("estimated_cost_usd"))), 6).alias("missed_cost"),
        F.count("error").alias("errors"),
    )
    dimension = F.when(F.col("g") == 15, F.lit("total"))
    for i, c in enumerate(KNOWN):
        dimension = dimension.when(F.col("g") == 15 - (8 >> i), F.lit(c))
    return out.select(dimension.alias("dimension"), F.coalesce(*KNOWN, F.lit("all")).alias("value"), "events", "input_tokens", "output_tokens", "cost", "missed_cost", "errors")


def stage_matrix(results: DataFrame, stages: list[str], statuses: list[str], id_col: str, stage: str, status: str) -> DataFrame:
    """stage, status, n for every known pair and 'missing': sources without a status for the stage. Zeros included."""
    spark = results.sparkSession
    grid = spark.createDataFrame([(a, b) for a in stages for b in [*statuses, "missing"]], "stage string, status string")  # constant
    seen = results.groupBy(F.col(stage).alias("stage"), F.col(status).alias("status")).agg(F.countDistinct(id_col).alias("n"))
    total = results.agg(F.countDistinct(id_col).alias("total"))
    have = results.groupBy(F.col(stage).alias("stage")).agg(F.countDistinct(id_col).alias("have"))
    out = grid.join(seen, ["stage", "status"], "left").join(have, "stage", "left").join(F.broadcast(total))
    missing = F.col("total") - F.coalesce("have", F.lit(0))
    return out.select("stage", "status", F.when(F.col("status") == "missing", missing).otherwise(F.coalesce("n", F.lit(0))).alias("n"))
