"""The knowledge graph as tables: nodes, claims (the truth), edges (their projection) and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import focus_terms, hits, normalize

# Which subject and object types a relation may have.
SIGNATURES = {
    "located_in": (["company", "project", "facility"], ["country", "region"]),
    "owns": (["company"], ["company", "project", "facility"]),
    "operates": (["company"], ["facility"]),
    "develops": (["company"], ["project", "facility"]),
    "produces": (["company", "facility", "project"], ["commodity", "product"]),
    "processes": (["company", "facility"], ["commodity", "product"]),
    "refines": (["company", "facility"], ["commodity", "product"]),
    "supplies": (["company", "facility"], ["company", "facility"]),
    "sells_to": (["company"], ["company"]),
    "depends_on": (["company", "facility", "project"], ["company", "facility", "country", "commodity", "product"]),
    "uses_input": (["company", "facility"], ["commodity", "product"]),
    "exports_to": (["country", "company"], ["country", "company"]),
    "imports_from": (["country", "company"], ["country", "company"]),
    "ships_via": (["company", "facility"], ["facility", "region", "country"]),
    "regulates": (["policy", "regulation"], ["company", "commodity", "project", "country", "facility"]),
    "restricts": (["policy", "regulation", "event"], ["commodity", "country", "company", "project", "facility"]),
    "affects": (["event", "policy", "regulation"], ["company", "facility", "country", "commodity", "project", "product"]),
    "disrupts": (["event"], ["company", "facility", "project", "commodity", "product"]),
    "involves_commodity": (["event", "policy", "regulation"], ["commodity", "product"]),
    "occurs_at": (["event"], ["facility", "project"]),
    "occurs_in": (["event"], ["country", "region"]),
    "has_upstream_exposure_to": (["company"], ["company", "facility", "country", "commodity", "product"]),
    "has_downstream_exposure_to": (["company"], ["company", "facility", "country", "commodity", "product"]),
}


def node_key(kind: Column, name: Column) -> Column:
    return F.concat_ws("::", normalize(kind), normalize(name))


def claim_key(subject: Column, relation: Column, obj: Column, *temporal: Column) -> Column:
    """One key per triple and temporal fields: the same triple at other dates is another claim."""
    return F.concat_ws("|", subject, relation, obj, *(F.coalesce(t.cast("string"), F.lit("")) for t in temporal))


def signature_is_valid(subject_type: Column, relation: Column, object_type: Column) -> Column:
    out = F.lit(False)
    for name, (subjects, objects) in SIGNATURES.items():
        out = out | ((relation == name) & subject_type.isin(subjects) & object_type.isin(objects))
    return out


def projection(claims: DataFrame) -> DataFrame:
    """Direct edges, one per claim with both ends."""
    return claims.filter("subject_key IS NOT NULL AND object_key IS NOT NULL").select("subject_key", "relation", "object_key", "claim_key", "grounding_score")


def in_scope(column: str, value: str, alias: str = "") -> Column:
    """Member of the list column, or equal to the latest or the single value."""
    c = lambda name: F.col(f"{alias}{name}")
    return F.coalesce(F.array_contains(c(f"{column}s"), value), F.lit(False)) | F.coalesce(c(f"latest_{column}") == value, F.lit(False)) | F.coalesce(c(column) == value, F.lit(False))


def claim_evidence(edges: DataFrame, claims: DataFrame, links: DataFrame, evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges of the anchors with their claims and evidence; anchors: subject_key."""
    rows = edges.join(anchors.select("subject_key").distinct(), "subject_key", "left_semi")
    rows = rows.join(claims.select("claim_key", "claim_text"), "claim_key").join(links, "claim_key")
    return rows.join(evidence, "evidence_id")


def both_ways(edges: DataFrame) -> DataFrame:
    """from_key, to_key, direction and the edge's columns, each edge once either way."""
    rest = [c for c in edges.columns if c not in ("subject_key", "object_key")]
    forward = edges.select(F.col("subject_key").alias("from_key"), F.col("object_key").alias("to_key"), F.lit("forward").alias("direction"), *rest)
    backward = edges.select(F.col("object_key").alias("from_key"), F.col("subject_key").alias("to_key"), F.lit("backward").alias("direction"), *rest)
    return forward.unionByName(backward)


def one_hop(frontier: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Undirected one-hop expansion of frontier (key), with evidence where a claim has some."""
    rows = both_ways(edges).join(frontier.select(F.col("key").alias("from_key")).distinct(), "from_key", "left_semi")
    return rows.join(links, "claim_key", "left")


def frontier_evidence(frontier: DataFrame, direct: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """key, evidence_id: evidence of the node itself, else of its claims."""
    keys = frontier.select("key").distinct()
    own = keys.join(direct.select(F.col("node_key").alias("key"), F.col("evidence_id").alias("ev1")), "key", "left")
    ends = claims.select(F.col("subject_key").alias("key"), "claim_key").unionByName(claims.select(F.col("object_key").alias("key"), "claim_key"))
    rows = own.join(ends, "key", "left").join(links.withColumnRenamed("evidence_id", "ev2"), "claim_key", "left")
    return rows.select("key", F.coalesce("ev1", "ev2").alias("evidence_id")).distinct()


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start_key, end_key, hops, nodes: simple directed paths of 1..depth edges. Depth is small and fixed."""
    if not 1 <= depth <= 6:
        raise ValueError("depth must be from 1 to 6")
    step = edges.select(F.col("subject_key").alias("s"), F.col("object_key").alias("o")).distinct()
    now = starts.select(F.col("key").alias("start_key"), F.col("key").alias("end_key"), F.array("key").alias("nodes")).distinct()
    out = None
    for hops in range(1, depth + 1):
        now = now.join(step, F.col("end_key") == F.col("s")).filter(~F.array_contains("nodes", F.col("o")))
        now = now.select("start_key", F.col("o").alias("end_key"), F.concat("nodes", F.array("o")).alias("nodes"))
        found = now.withColumn("hops", F.lit(hops))
        out = found if out is None else out.unionByName(found)
    return out.select("start_key", "end_key", "hops", F.concat_ws(" > ", "nodes").alias("nodes"))


def upsert_nodes(versions: DataFrame) -> DataFrame:
    """One row per key over all versions, which are ordered by seq.

    The first name and the first non-empty description stay, an unknown type is replaced by the
    first known one, properties are those of the last version, labels are united.
    """
    first = lambda c, when: F.min_by(c, F.when(when, F.col("seq")))
    return versions.groupBy("key").agg(
        first("name", F.col("name").isNotNull()).alias("name"),
        F.coalesce(first("entity_type", F.col("entity_type") != "unknown"), F.lit("unknown")).alias("entity_type"),
        first("description", F.trim("description") != "").alias("description"),
        F.max_by("properties", "seq").alias("properties"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"),
        F.count("*").alias("versions"),
    )


def upsert_edges(versions: DataFrame) -> DataFrame:
    """One row per edge: the largest grounding score, the first description, all evidence."""
    return versions.groupBy("edge_key").agg(
        F.max("grounding_score").alias("grounding_score"),
        F.min_by("description", F.when(F.trim("description") != "", F.col("seq"))).alias("description"),
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
        F.count("*").alias("versions"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """key, degree: how many edge ends a node has."""
    ends = edges.select(F.explode(F.array("subject_key", "object_key")).alias("key"))
    return ends.groupBy("key").agg(F.count("*").alias("degree"))


def ranked_nodes(nodes: DataFrame, edges: DataFrame, question: str) -> DataFrame:
    """key, hits, degree, ordered by focus hits and degree; ties by key."""
    terms = focus_terms(F.lit(question))
    text = normalize(F.concat_ws(" ", "name", "entity_type", F.coalesce("description", F.lit(""))))
    rows = nodes.select("key", hits(terms, text).alias("hits")).join(degrees(edges), "key", "left")
    return rows.select("key", "hits", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("hits"), F.desc("degree"), "key")


def edge_relevance(edges: DataFrame, question: str) -> DataFrame:
    """edges with relevance: grounding and 0.15 for each focus term in their text."""
    terms = focus_terms(F.lit(question))
    text = normalize(F.concat_ws(" ", "subject_key", "relation", "object_key"))
    return edges.withColumn("relevance", F.col("grounding_score") + F.lit(0.15) * hits(terms, text))
