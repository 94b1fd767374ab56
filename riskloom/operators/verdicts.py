"""Verdicts on candidates: grounding scores, normalisation and aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base scores, penalties and ranks.
SUPPORT = {"direct": 0.96, "strong_indirect": 0.86, "weak_indirect": 0.66, "ambiguous": 0.45, "absent": 0.16, "contradicted": 0.02}
PENALTIES = {
    "specificity": {"exact": 0.0, "slightly_broader": 0.05, "much_broader": 0.16, "over_specific": 0.25},
    "entity_grounding": {"explicit": 0.0, "inferred": 0.08, "mismatched": 0.32, "absent": 0.35},
    "temporal_grounding": {"explicit": 0.0, "inferred": 0.08, "missing": 0.10, "wrong": 0.42, "not_applicable": 0.0},
    "relation_grounding": {"explicit": 0.0, "inferred": 0.10, "causal_overreach": 0.28, "absent": 0.35, "not_applicable": 0.0},
}
DECISIONS = {"reject": 0.05, "coarsen": 0.03}
SUPPORT_RANK = {"direct": 6, "strong_indirect": 5, "weak_indirect": 4, "ambiguous": 3, "absent": 2, "contradicted": 1}
DECISION_RANK = {"accept": 3, "coarsen": 2, "reject": 1}
DEFAULTS = {"support": "ambiguous", "specificity": "exact", "entity_grounding": "inferred", "temporal_grounding": "not_applicable", "relation_grounding": "not_applicable"}


def look_up(table: dict, c: Column, default) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def clean(c: Column, allowed, default: str) -> Column:
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(default))


def grounding_score(status: dict[str, Column], decision: Column) -> Column:
    """Base by support less the penalties, within 0..1, to three places."""
    score = look_up(SUPPORT, status["support"], 0.35)
    for field, table in PENALTIES.items():
        score = score - look_up(table, status[field], 0.08)
    score = score - look_up(DECISIONS, decision, 0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def normalize(verdicts: DataFrame, corrected: Column) -> DataFrame:
    """Known values only; a coarsened candidate without correction is rejected; scores are always derived.

    Columns decision and the five status fields are replaced, grounding_score is added.
    """
    decision = clean(F.col("decision"), DECISION_RANK, "reject")
    decision = F.when((decision == "coarsen") & ~F.coalesce(corrected, F.lit(False)), F.lit("reject")).otherwise(decision)
    tables = {"support": SUPPORT, **PENALTIES}
    out = verdicts.withColumns({"decision": decision, **{f: clean(F.col(f), tables[f], d) for f, d in DEFAULTS.items()}})
    return out.withColumn("grounding_score", grounding_score({f: F.col(f) for f in DEFAULTS}, F.col("decision")))


def aggregate(verdicts: DataFrame, candidate: str, order: str) -> DataFrame:
    """One verdict per candidate: the best by decision, support and score, among supporting ones if there are any.

    evidence_ids: distinct ids of that pool in order; expects columns decision, support, grounding_score, evidence_id.
    """
    rank = F.struct(look_up(DECISION_RANK, F.col("decision"), 0).alias("d"), look_up(SUPPORT_RANK, F.col("support"), 0).alias("s"), F.col("grounding_score"), (-F.col(order)).alias("o"))
    supporting = F.col("decision").isin("accept", "coarsen")
    grouped = verdicts.groupBy(candidate).agg(F.max(F.struct(rank.alias("r"), "decision", "support", "grounding_score")).alias("best"), F.count_if(supporting).alias("good"), F.count("*").alias("verdicts"))
    # an id counts where it stands first, so lists hold distinct ids only
    first = verdicts.filter("evidence_id IS NOT NULL").groupBy(candidate, F.col("evidence_id").cast("string").alias("e")).agg(F.min(order).alias("every"), F.min(F.when(supporting, F.col(order))).alias("good"))
    listed = lambda at: F.transform(F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(at, "e")))), lambda r: r["e"])
    ids = first.groupBy(candidate).agg(listed("good").alias("good_ids"), listed("every").alias("every_ids"))
    pool = F.coalesce(F.when(F.col("good") > 0, F.col("good_ids")).otherwise(F.col("every_ids")), F.array().cast("array<string>"))
    out = grouped.join(ids, grouped[candidate].eqNullSafe(ids[candidate]), "left").select(grouped[candidate], "best", pool.alias("evidence_ids"), "verdicts")
    return out.select(candidate, F.col("best.decision").alias("decision"), F.col("best.support").alias("support"), F.col("best.grounding_score").alias("grounding_score"), "evidence_ids", "verdicts")


def fallback(reason: Column, support: str = "ambiguous") -> dict[str, Column]:
    """The verdict on a candidate that could not be judged: rejected, with the score that follows from its status."""
    status = {f: F.lit(support if f == "support" else d) for f, d in DEFAULTS.items()}
    return {"decision": F.lit("reject"), **status, "grounding_score": grounding_score(status, F.lit("reject")), "reason": reason}
