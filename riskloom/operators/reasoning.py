"""Scored multi-hop search over a local subgraph: start nodes, hop scores, beam and path choice.

Each depth is one pass over the edges, one score and one top-k; the beam itself is a handful of
rows. Edges are filtered by the ends of the beam before they are turned and meet any node, so an
edge table that is computed (claims summed from their sources) is computed for those ends only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import lexical_score, objective_score
from riskloom.operators.graph import degrees

#: Up to so many ends of paths are handed to edges and nodes as literals; more are joined.
LITERALS = 1_000

#: Up to so many steps of a hop are gathered and sent to the nodes; more are asked again and joined by shuffles.
STEPS = 20_000

#: Nodes or edges, or a function that gives those at some keys at least (all of them for None).
Table = DataFrame | Callable[[list[str] | None], DataFrame]


def at(table: Table, keys: list[str] | None) -> DataFrame:
    return table if isinstance(table, DataFrame) else table(keys)


@dataclass(frozen=True)
class Plan:
    """A question's plan. Objectives: id -> terms, by kind."""

    question: str
    start: dict[str, list[str]] = field(default_factory=dict)
    bridge: dict[str, list[str]] = field(default_factory=dict)
    terminal: dict[str, list[str]] = field(default_factory=dict)
    direction: str = "bidirectional"
    multi_hop: bool = True
    memory: str = ""
    depth: int = 4
    width: int = 5
    top: int = 3
    starts: int = 8
    threshold: float = 0.20
    least_hops: int = 2


def _terms(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def match_starts(nodes: DataFrame, concepts: list[str], plan: Plan, pinned: list[str] | None = None) -> DataFrame:
    """key, similarity, matched_concept: the best nodes by their best concept; pinned ones count 0.95 at least.

    Texts are scored once however many nodes share them; the nodes are scored themselves where more than STEPS texts match.
    """
    text = F.concat_ws(" ", "label", "node_type", "description")
    scores = [F.struct(lexical_score(F.lit(c), F.col("text")).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(concepts)]
    best = F.array_max(F.array(*scores)) if scores else F.lit(None).cast("struct<s:double,i:int,c:string>")
    found = nodes.select(text.alias("text")).distinct().select("text", best.alias("best")).orderBy(F.desc("best.s")).limit(STEPS + 1)
    sent = found.filter(F.col("best.s") > 0).toArrow()  # a filter before the limit would move below distinct() and score all nodes
    rows = nodes.select("key", text.alias("text"))
    if sent.num_rows <= STEPS:
        rows = rows.join(F.broadcast(nodes.sparkSession.createDataFrame(sent, found.schema)), "text", "left")
    else:
        rows = rows.select("key", best.alias("best"))
    similarity = F.coalesce(F.col("best.s"), F.lit(0.0))
    if pinned:
        similarity = F.when(F.col("key").isin(pinned), F.greatest(similarity, F.lit(0.95))).otherwise(similarity)
    rows = rows.select("key", similarity.alias("similarity"), F.when(F.col("best.s") > 0, F.col("best.c")).otherwise(F.lit("")).alias("matched_concept"))
    rows = rows.filter(F.col("similarity") >= plan.threshold).orderBy(F.desc("similarity"), "key").limit(plan.starts)
    return rows.withColumn("similarity", F.round("similarity", 4))


def hop_columns(plan: Plan, first: bool) -> dict[str, Column]:
    """covered, take and score of a hop, of the columns that `hop_scores` expects. Each objective is scored once here, in all hops but the first alike."""
    start = F.concat_ws(" ", "from_label", "from_description")
    to = F.concat_ws(" ", "to_label", "to_description")
    edge = F.concat_ws(" ", "relation", "edge_description")
    terminal, bridge = F.concat_ws(" ", to, edge), F.concat_ws(" ", start, edge, to)
    low, high = max(0.34, plan.threshold + 0.14), max(0.48, plan.threshold + 0.28)
    kinds = ([(start, plan.start, low)] if first else []) + [(bridge, plan.bridge, low), (terminal, plan.terminal, high)]
    scores = [{i: objective_score(text, _terms(w)) for i, w in objectives.items()} for text, objectives, _ in kinds]
    ids = [F.when(s >= bar, F.lit(i)) for found, (_, _, bar) in zip(scores, kinds, strict=True) for i, s in found.items()]
    covered = F.array_distinct(F.filter(F.array(*ids), lambda x: x.isNotNull())) if ids else F.array().cast("array<string>")
    *start_score, bridge_score, terminal_score = (F.greatest(F.lit(0.0), F.lit(0.0), *found.values()) for found in scores)
    question = F.greatest(lexical_score(F.lit(plan.question), F.concat_ws(" ", start, edge, to)), terminal_score, bridge_score, *(start_score or [F.lit(0.0)]))
    memory = lexical_score(F.lit(plan.memory), bridge) if plan.memory else F.lit(0.0)
    bonus = F.when(F.col("supported"), F.lit(0.15)).otherwise(F.lit(0.0))
    raw = F.lit(0.42) * question + F.lit(0.14) * memory + F.lit(0.16) * terminal_score + F.lit(0.12) * bridge_score + bonus
    raw = F.least(F.lit(1.0), raw + F.least(F.lit(0.20), F.lit(0.07) * F.size("covered")) + F.lit(0.06))
    take = F.col("raw") >= plan.threshold
    if first:
        take = take | (F.col("raw") >= 0.14) | F.col("supported")
    return {"covered": covered, "raw": raw, "take": take, "score": F.round("raw", 4)}


def hop_scores(hops: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """hops with covered, take and score. Expects from_label, from_description, relation, edge_description, to_label, to_description, supported."""
    out = hops.withColumn("covered", columns["covered"]).withColumn("raw", columns["raw"])
    return out.withColumns({"take": columns["take"], "score": columns["score"]}).drop("raw")


def steps_from(edges: Table, ends: list[str], direction: str) -> DataFrame:
    """from_key, to_key and the edge's columns, each edge once either way or in the direction; from the ends alone if they are few."""
    few = len(ends) <= LITERALS
    edges = at(edges, ends if few else None)
    if few:
        out, back = F.col("subject_key").isin(ends), F.col("object_key").isin(ends)
        edges = edges.filter({"forward": out, "backward": back}.get(direction, out | back))
    ways = [F.struct(F.col(a).alias("from_key"), F.col(b).alias("to_key")) for way, a, b in (("forward", "subject_key", "object_key"), ("backward", "object_key", "subject_key")) if direction in (way, "bidirectional")]
    return edges.select(F.col("key").alias("edge_key"), "relation", F.col("description").alias("edge_description"), "supported", F.explode(F.array(*ways)).alias("step")).select("*", "step.*").drop("step")


def side(nodes: DataFrame, name: str) -> DataFrame:
    """The nodes as one side of a step."""
    return nodes.select(F.col("key").alias(f"{name}_key"), F.col("label").alias(f"{name}_label"), F.col("description").alias(f"{name}_description"))


def beam_paths(nodes: Table, edges: Table, starts: DataFrame, plan: Plan) -> DataFrame:
    """path_key, nodes, covered, hops, score: all paths that a beam held at any depth.

    nodes: key, label, node_type, description; edges: key, subject_key, object_key, relation,
    description, supported; either may be a function of keys. Ties go to the smaller path. A path's
    score is the mean of its hops'. A hop reads edges and nodes once, unless it has more than STEPS steps.
    """
    spark = starts.sparkSession
    ends = [r.key for r in starts.select("key").limit(LITERALS + 1).collect()]
    if len(ends) <= LITERALS:  # computed once
        starts = spark.createDataFrame([(k,) for k in ends], "key string")
    beam = starts.select(F.array("key").alias("nodes"), F.array().cast("array<string>").alias("covered"), F.lit(0).alias("supported_hops"), F.lit(0.0).alias("score"))
    done = []
    for hop in range(plan.depth):
        if hop < 2:
            columns = hop_columns(plan, hop == 0)
        now = beam.withColumn("from_key", F.element_at("nodes", -1)).withColumnsRenamed({"score": "so_far", "covered": "before"})
        few = len(ends) <= LITERALS
        steps, near = steps_from(edges, ends, plan.direction), side(at(nodes, ends if few else None), "from")
        if few:
            now, near = F.broadcast(now), F.broadcast(near.filter(F.col("from_key").isin(ends)))  # one row for each end
            found = steps.limit(STEPS + 1).toArrow()
            if found.num_rows <= STEPS:
                steps = F.broadcast(spark.createDataFrame(found, steps.schema))
        rows = side(at(nodes, None), "to").join(steps, "to_key").join(now, "from_key").filter(~F.array_contains("nodes", F.col("to_key")))
        rows = hop_scores(rows.join(near, "from_key"), columns).select(
            F.concat("nodes", F.array("to_key")).alias("nodes"),
            F.array_union("before", "covered").alias("covered"),
            (F.col("supported_hops") + F.col("supported").cast("int")).alias("supported_hops"),
            ((F.col("so_far") * hop + F.col("score")) / (hop + 1)).alias("score"),
            "take",
        )
        # what is not taken comes last; a filter before would score each step twice
        beam = rows.orderBy(F.desc("take"), F.round("score", 9).desc(), F.concat_ws(">", "nodes")).limit(plan.width)
        held = [r.asDict() for r in beam.collect() if r["take"]]  # at most `width` rows
        beam = spark.createDataFrame([(r["nodes"], r["covered"], r["supported_hops"], r["score"]) for r in held], "nodes array<string>, covered array<string>, supported_hops int, score double")
        if not held:
            break
        ends = list({r["nodes"][-1] for r in held})
        done.append(beam.withColumn("hops", F.lit(hop + 1)))
    if not done:
        return beam.withColumns({"hops": F.lit(0), "path_key": F.concat_ws(" > ", "nodes")})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("path_key", F.concat_ws(" > ", "nodes"))


def select_paths(paths: DataFrame, plan: Plan) -> list[dict]:
    """The best paths without those that are part of a better one. Works on at most width * depth rows."""
    every = len(plan.start) + len(plan.bridge) + len(plan.terminal)
    best: dict[str, dict] = {}
    for row in paths.collect():
        covered = set(row["covered"])
        hops = row["hops"]
        score = 0.34 * row["score"] + 0.26 * len(covered) / max(1, every) + 0.20 * len(covered & set(plan.terminal)) / max(1, len(plan.terminal))
        score += 0.14 * (row["supported_hops"] / hops if hops else 0.0)
        if plan.multi_hop:
            score += 0.10 if hops >= plan.least_hops else -0.12
        found = {"nodes": list(row["nodes"]), "score": round(max(0.0, min(1.0, score)), 4), "covered": sorted(covered), "hops": hops}
        if row["path_key"] not in best or found["score"] > best[row["path_key"]]["score"]:
            best[row["path_key"]] = found
    kept: list[dict] = []
    for p in sorted(best.values(), key=lambda p: (-p["score"], p["nodes"])):
        n = p["nodes"]
        if not any(n == k["nodes"][i : i + len(n)] for k in kept if len(k["nodes"]) > len(n) for i in range(len(k["nodes"]) - len(n) + 1)):
            kept.append(p)
        if len(kept) == plan.top:
            break
    return kept


def fallback_starts(edges: DataFrame, n: int) -> DataFrame:
    """The nodes with the most edges, for questions that match none."""
    return degrees(edges).orderBy(F.desc("degree"), F.desc("key")).limit(n).select("key")


def assess_gaps(selected: list[dict], plan: Plan) -> dict:
    """What the chosen paths leave open: status, gap type, uncovered objectives."""
    covered = {c for p in selected for c in p["covered"]}
    every = [*plan.start, *plan.bridge, *plan.terminal]
    uncovered = [i for i in every if i not in covered]
    if not selected:
        status, gap = "insufficient", "no_path"
    elif any(i in plan.terminal for i in uncovered):
        status, gap = "partial", "terminal_not_reached"
    elif plan.multi_hop and max(p["hops"] for p in selected) < plan.least_hops:
        status, gap = "partial", "too_short"
    else:
        status, gap = ("partial", "bridge_missing") if uncovered else ("sufficient", None)
    return {"status": status, "gap_type": gap, "covered": sorted(covered), "uncovered": uncovered}
