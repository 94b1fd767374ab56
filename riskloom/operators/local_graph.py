"""A question's subgraph: graph rows ingested into nodes, edges and evidence, merged, ranked and exported.

Rows are JSON texts as a graph store returns them: an object whose values are nodes, relationships,
paths, or lists of those. Everything stays a DataFrame; what is shown of a graph is cut by stated budgets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import graph_float
from riskloom.functions.records import filled, first_nonempty, raw
from riskloom.functions.text import compact, normalize
from riskloom.operators.graph import edge_relevance, ranked_nodes

ENTITY, CLAIM, EVIDENCE = "Entity", "Claim", "Evidence"
#: The relationship type that stands for a claim between two entities.
EDGE_TYPE = "KG_REL"


def _list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def has_label(obj: Column, label: str) -> Column:
    return F.array_contains(_list(raw(obj, "labels")), label)


def looks_like_triple(obj: Column) -> Column:
    shape = lambda k: F.startswith(raw(obj, k), F.lit("{"))
    return F.coalesce(shape("subject") & shape("relation") & shape("object"), F.lit(False))


def values(rows: DataFrame, seq: str, text: str) -> DataFrame:
    """seq, name, place, obj: the objects that stand in a row, lists unfolded to any place of two levels."""
    cells = rows.select(F.col(seq).alias("seq"), F.explode(F.from_json(text, "map<string,string>")).alias("name", "value"))
    for _ in range(2):
        many = F.startswith(F.ltrim("value"), F.lit("["))
        cells = cells.select("seq", "name", F.explode(F.when(many, _list(F.col("value"))).otherwise(F.array("value"))).alias("value"))
    return cells.filter(F.startswith("value", F.lit("{"))).withColumn("kind", raw(F.col("value"), "kind")).withColumnRenamed("value", "obj")


def _ref(obj: Column, prefix: str = "") -> dict[str, Column]:
    """key, name and entity_type of a node or of what an edge's end says of it."""
    at = lambda k: raw(obj, prefix + k)
    name = first_nonempty(at("canonical_name"), at("name"), at("key"))
    kind = F.coalesce(filled(at("entity_type")), F.lit("unknown"))
    key = F.coalesce(filled(at("key")), F.concat_ws("::", normalize(kind), normalize(name)))
    return {"key": key, "name": name, "entity_type": kind}


def ingest(rows: DataFrame, seq: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions of nodes, edges and evidence, each with seq; `merge` makes one row of each."""
    cells = values(rows, seq, text)
    path = cells.filter("kind = 'path'")
    inner = path.select("seq", F.explode(_list(raw(F.col("obj"), "nodes"))).alias("obj"))
    nodes = cells.filter("kind = 'node'").select("seq", "obj").unionByName(inner)
    obj = F.col("obj")
    entity = nodes.filter(has_label(obj, ENTITY) & ~has_label(obj, EVIDENCE))
    node_rows = entity.select("seq", *(c.alias(n) for n, c in _ref(obj, "properties.").items()), raw(obj, "properties.description").alias("description"), raw(obj, "properties").alias("properties"), _list(raw(obj, "labels")).alias("labels"))

    # edges: triples of paths, else their relationships; relationships and triples that stand alone
    triples = path.select("seq", F.explode(_list(raw(obj, "triples"))).alias("obj")).unionByName(cells.filter(looks_like_triple(obj)).select("seq", "obj"))
    plain = path.filter(F.size(_list(raw(obj, "triples"))) == 0).select("seq", F.explode(_list(raw(obj, "relationships"))).alias("obj"))
    links = cells.filter("kind = 'relationship'").select("seq", "obj").unionByName(plain).filter(raw(obj, "type") == EDGE_TYPE)
    parts = [
        triples.select("seq", raw(obj, "subject").alias("s"), raw(obj, "object").alias("o"), raw(obj, "relation.type").alias("kind"), raw(obj, "relation.properties").alias("p")),
        links.select("seq", raw(obj, "start_node").alias("s"), raw(obj, "end_node").alias("o"), raw(obj, "type").alias("kind"), raw(obj, "properties").alias("p")),
        _claims(cells),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    s, o, p = _ref(F.col("s")), _ref(F.col("o")), F.col("p")
    edges = every.select(
        "seq", s["key"].alias("subject_key"), s["name"].alias("subject"), s["entity_type"].alias("subject_type"), o["key"].alias("object_key"), o["name"].alias("object"), o["entity_type"].alias("object_type"),
        first_nonempty(raw(p, "relation_type"), F.col("kind"), F.lit("related_to")).alias("relation"), raw(p, "claim_key").alias("claim_key"), graph_float(raw(p, "grounding_score")).alias("grounding_score"), raw(p, "description").alias("description"),
    ).filter("subject IS NOT NULL AND object IS NOT NULL")
    ends = [edges.select("seq", F.col(f"{e}_key").alias("key"), F.col(e).alias("name"), F.col(f"{e}_type").alias("entity_type")) for e in ("subject", "object")]
    bare = ends[0].unionByName(ends[1]).withColumns({"description": F.lit(None).cast("string"), "properties": F.lit(None).cast("string"), "labels": F.array().cast("array<string>")})
    node_rows = node_rows.filter("name IS NOT NULL").unionByName(bare)

    rows_with = nodes.filter(has_label(obj, EVIDENCE))
    claims = cells.filter((F.col("kind") == "node") & has_label(obj, CLAIM)).groupBy("seq").agg(F.max(raw(obj, "properties.key")).alias("row_claim"))
    prop = lambda k: raw(obj, f"properties.{k}")
    evidence = rows_with.join(claims, "seq", "left").select(
        "seq", first_nonempty(prop("evidence_id"), prop("key"), raw(obj, "element_id")).alias("evidence_id"), prop("text").alias("text"), prop("source_url").alias("source_url"), prop("source_title").alias("source_title"),
        F.coalesce(filled(prop("claim_key")), F.col("row_claim")).alias("claim_key"), prop("block_type").alias("block_type"),
    ).filter("evidence_id IS NOT NULL AND text <> ''")
    return node_rows, edges, evidence


def _claims(cells: DataFrame) -> DataFrame:
    """Rows with a claim node and two entities stand for an edge: from s to o, or from the first entity to the second."""
    obj = F.col("obj")
    node = cells.filter("kind = 'node'").withColumns({"entity": has_label(obj, ENTITY), "claim": has_label(obj, CLAIM)})
    props = F.struct("name", raw(obj, "properties").alias("p"))
    row = node.groupBy("seq").agg(
        F.max(F.when(F.col("claim"), raw(obj, "properties"))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("entity") & ~F.col("claim"), props))).alias("e"),  # as many as one row's columns
    ).filter(F.col("c").isNotNull() & (F.size("e") >= 2))
    named = lambda n: F.get(F.filter("e", lambda x: x["name"] == n), F.lit(0))["p"]
    s = F.coalesce(named("s"), F.get("e", F.lit(0))["p"])
    o = F.coalesce(named("o"), F.get("e", F.lit(1))["p"])
    c = F.col("c")
    claim = {"claim_key": raw(c, "key"), "relation_type": raw(c, "relation_type"), "grounding_score": raw(c, "grounding_score"), "description": raw(c, "description")}
    return row.select("seq", s.alias("s"), o.alias("o"), F.lit(EDGE_TYPE).alias("kind"), F.to_json(F.struct(*(v.alias(k) for k, v in claim.items()))).alias("p"))


def merge(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row per node, edge and evidence over all versions: first names and texts stay, gaps are filled, scores rise.

    An end of an edge that has no name goes by its key, which any name replaces.
    """
    first = lambda c, when: F.min_by(c, F.when(when, F.col("seq")))
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    n = nodes.groupBy("key").agg(
        F.coalesce(first("name", F.col("name") != F.col("key")), F.col("key")).alias("name"), F.coalesce(first("entity_type", F.col("entity_type") != "unknown"), F.lit("unknown")).alias("entity_type"),
        first("description", given("description")).alias("description"), F.max_by("properties", F.when(F.col("properties").isNotNull(), F.col("seq"))).alias("properties"),
    )
    labels = nodes.select("key", F.explode("labels").alias("label")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    n = n.join(labels, "key", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    triple = F.concat_ws("|", "subject_key", "relation", "object_key")
    e = edges.withColumn("edge_key", F.coalesce(filled(F.col("claim_key")), triple)).groupBy("edge_key").agg(
        *(F.min_by(c, "seq").alias(c) for c in ("subject_key", "subject", "relation", "object_key", "object", "claim_key")),
        F.max("grounding_score").alias("grounding_score"), first("description", given("description")).alias("description"),
    )
    ev = evidence.groupBy("evidence_id").agg(F.min_by("text", "seq").alias("text"), *(first(c, given(c)).alias(c) for c in ("source_url", "source_title", "claim_key", "block_type")))
    ids = evidence.filter("claim_key IS NOT NULL").select("claim_key", "evidence_id").distinct().groupBy("claim_key").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    e = e.join(ids, "claim_key", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    return n, e, ev


def counts(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: how many nodes, edges and evidence there are."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(nodes, "nodes").join(F.broadcast(one(edges, "edges"))).join(F.broadcast(one(evidence, "evidence")))


def context(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, question: str, max_nodes: int = 25, max_edges: int = 80, max_evidence: int = 12, max_chars: int = 900) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What of a graph is shown for a question: its best nodes and edges, and some evidence with shortened texts."""
    order = ranked_nodes(nodes, edges, question).limit(max_nodes).select("key", "hits", "degree")
    shown = order.join(nodes, "key").select("key", "name", "entity_type", "description", "hits", "degree")
    best = edge_relevance(edges, question).orderBy(F.desc("relevance"), "subject_key", "relation", "object_key").limit(max_edges)
    texts = evidence.orderBy("evidence_id").limit(max_evidence).withColumn("text", compact(F.col("text"), max_chars))
    return shown, best, texts


def quoted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line, in order of place: the graph in the DOT language."""
    label = F.concat(quoted(F.col("name")), F.lit("\\n["), quoted(F.col("entity_type")), F.lit("]"))
    node = nodes.select(F.lit(1).alias("part"), F.col("key").alias("place"), F.concat(F.lit('  "'), quoted(F.col("key")), F.lit('" [label="'), label, F.lit('"];')).alias("line"))
    score = F.when(F.col("grounding_score") > 0, F.concat(F.lit("\\n"), F.format_number("grounding_score", 2))).otherwise(F.lit(""))
    arrow = F.concat(F.lit('  "'), quoted(F.col("subject_key")), F.lit('" -> "'), quoted(F.col("object_key")), F.lit('" [label="'), quoted(F.col("relation")), score, F.lit('"];'))
    edge = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "subject_key", "relation", "object_key", "claim_key").alias("place"), arrow.alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "digraph {"), (3, "", "}")], "part int, place string, line string")
    return ends.unionByName(node).unionByName(edge).orderBy("part", "place").select("line")


def to_json(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """kind, record: every part of the graph as one JSON text, as `from_json` reads it."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("record"))
    return one(nodes, "node").unionByName(one(edges, "edge")).unionByName(one(evidence, "evidence"))


NODE = "key string, name string, entity_type string, description string, properties string, labels array<string>"
EDGE = "claim_key string, subject_key string, relation string, object_key string, subject string, object string, grounding_score double, description string, evidence_ids array<string>"
SNIPPET = "evidence_id string, text string, source_url string, source_title string, claim_key string, block_type string"


def from_json(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = lambda kind, schema: records.filter(F.col("kind") == kind).select(F.from_json("record", schema).alias("r")).select("r.*")
    return part("node", NODE), part("edge", EDGE), part("evidence", SNIPPET)


def circle(nodes: DataFrame, order: str, middle: tuple[float, float] = (480.0, 390.0), radius: float = 300.0) -> DataFrame:
    """nodes with x and y on a circle, in the order of a column that numbers them from 0."""
    total = nodes.agg(F.greatest(F.lit(1), F.count("*")).alias("__n"))
    angle = F.lit(2.0) * F.pi() * F.col(order) / F.col("__n")
    at = {"x": F.lit(middle[0]) + F.lit(radius) * F.cos(angle), "y": F.lit(middle[1]) + F.lit(radius) * F.sin(angle)}
    return nodes.join(F.broadcast(total)).withColumns(at).drop("__n")


def summary(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """dimension, value, n: nodes by type, edges by relation, evidence by block type."""
    by = lambda df, c, name: df.groupBy(F.coalesce(F.col(c), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
    return by(nodes, "entity_type", "node").unionByName(by(edges, "relation", "edge")).unionByName(by(evidence, "block_type", "evidence"))

