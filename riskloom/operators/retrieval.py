"""Retrieval in rounds: a frontier grows hop by hop until nothing new turns up or a budget is spent.

Rounds are few and bounded; what they find stays in DataFrames, and the driver sees counts alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph import one_hop


@dataclass(frozen=True)
class Budget:
    """Rounds and rows of a round, and how many nodes, edges and evidence end the retrieval (the documented defaults)."""

    rounds: int = 5
    rows: int = 50
    nodes: int = 80
    edges: int = 120
    evidence: int = 35
    patience: int = 1


LARGE = Budget(8, 150, 300, 600, 150)


@dataclass
class Retrieved:
    nodes: DataFrame
    edges: DataFrame
    links: DataFrame
    status: str
    reason: str
    rounds: list[dict]


def stop(found: dict[str, int], idle: int, budget: Budget) -> tuple[str, str] | None:
    """Why a retrieval ends after a round, or nothing."""
    for kind in ("nodes", "edges", "evidence"):
        most = getattr(budget, kind)
        if found[kind] > most:
            return "budget_exceeded", f"{kind}: {found[kind]} > {most}"
    if idle >= budget.patience:
        return ("partial", "saturated") if any(found.values()) else ("insufficient", "nothing found")
    return None


def retrieve(anchors: DataFrame, edges: DataFrame, links: DataFrame, budget: Budget | None = None, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> Retrieved:
    """What stands around the anchors (key). edges: claim_key, subject_key, object_key; links: claim_key, evidence_id.

    A round takes the edges of the frontier, the first `rows` by claim key, and the nodes that are new are the
    next frontier. `save` keeps a round's result (a checkpoint or a written table).
    """
    budget = budget or Budget()
    nodes = frontier = save(anchors.select("key").distinct())
    taken = edges.select("claim_key").limit(0)
    idle, log, ended = 0, [], None
    counts = {"nodes": nodes.count(), "edges": 0, "evidence": 0}
    for k in range(budget.rounds):
        hop = one_hop(frontier, edges, links).join(taken, "claim_key", "left_anti")
        fresh = hop.select("claim_key").distinct().orderBy("claim_key").limit(budget.rows)
        rows = hop.join(fresh, "claim_key", "left_semi")
        taken = save(taken.unionByName(fresh))
        ends = rows.select(F.explode(F.array("from_key", "to_key")).alias("key")).distinct()
        frontier = save(ends.join(nodes, "key", "left_anti"))
        nodes = save(nodes.unionByName(frontier))
        kept = links.join(taken, "claim_key", "left_semi")
        now = {"nodes": nodes.count(), "edges": taken.count(), "evidence": kept.select("evidence_id").distinct().count()}
        idle = idle + 1 if now == counts else 0
        log.append({"round": k, **{f"{c}_added": now[c] - counts[c] for c in now}})
        counts = now
        ended = stop(counts, idle, budget)
        if ended:
            break
    status, reason = ended or ("partial", "rounds spent")
    return Retrieved(nodes, edges.join(taken, "claim_key", "left_semi"), links.join(taken, "claim_key", "left_semi"), status, reason, log)


def merged_requests(stored: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """query, reason, priority: stored requests before new ones (each with a place), each query once whatever its case, the first `most`."""
    every = stored.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1))).withColumn("query", F.trim("query")).filter("query <> ''")
    rest = F.struct("side", "place", "query", F.trim(F.coalesce("reason", F.lit(""))).alias("reason"), F.coalesce(F.nullif(F.trim("priority"), F.lit("")), F.lit("medium")).alias("priority"))
    once = every.groupBy(F.lower("query").alias("k")).agg(F.min(rest).alias("r"))
    return once.select("r.*").orderBy("side", "place").limit(most).select("query", "reason", "priority")
