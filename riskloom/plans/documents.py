"""Queries over blocks, extractions, local graphs, risk models and batch runs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import planning
from riskloom.operators import analysis, blocks, extraction, fusion, local_graph, retrieval
from riskloom.plans.catalog import CLAIM_SQL, kg_claims, kg_links, kg_nodes, pick, pick_sql, query, read
from riskloom.operators import graph
from riskloom.sources import manifest
from riskloom.sources.scratch import saved

# ---------------------------------------------------------------- blocks


@query(r"""
    WITH r AS (SELECT n_nationkey AS o, row_number() OVER (ORDER BY n_nationkey) AS i, 'Row ' || row_number() OVER (ORDER BY n_nationkey) || ': n_name: ' || n_name || '; n_regionkey: ' || n_regionkey AS t FROM nation)
    SELECT 'table' AS block_type, count(*) AS row_count, 'n_name=categorical_or_text;n_regionkey=numeric' AS column_schema,
        concat_ws(chr(10), 'Table caption: Nations', 'Columns: n_name, n_regionkey', 'Row count: ' || count(*), 'Column schema: n_name=categorical_or_text; n_regionkey=numeric', string_agg(t, chr(10) ORDER BY o) FILTER (i <= 20),
            CASE WHEN count(*) > 20 THEN '... ' || (count(*) - 20) || ' additional rows omitted' END) AS text FROM r""")
def table_block_text(spark, sf_dir):
    return blocks.table_block(read(spark, sf_dir, "nation"), "n_nationkey", "doc_1", "Nations").select("block_type", "row_count", "column_schema", "text")


MONTHS_SQL = "m AS (SELECT date_trunc('month', o_orderdate)::DATE AS d, count(*) AS orders FROM orders GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY d) AS i, * FROM m)"


def monthly_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("order_date")).agg(F.count("*").alias("orders")).select(F.unix_date("order_date").alias("seq"), F.col("order_date").cast("string").alias("order_date"), "orders")


@query(f"""
    WITH {MONTHS_SQL} SELECT 'time_series' AS block_type, 'order_date' AS date_column, 'orders' AS value_columns, min(d) AS start_date, max(d) AS end_date, 'monthly' AS frequency, count(*) AS observation_count,
        concat_ws(chr(10), 'Time series instrument: Orders', 'Fields: order_date, orders', 'Date field: order_date', 'Value fields: orders', 'Frequency: monthly', 'Date range: ' || min(d) || ' to ' || max(d),
            string_agg('Observation ' || i || ': order_date: ' || d || '; orders: ' || orders, chr(10) ORDER BY i) FILTER (i <= 10), CASE WHEN count(*) > 10 THEN '... ' || (count(*) - 10) || ' additional observations omitted' END) AS text FROM k""")
def series_block_text(spark, sf_dir):
    out = blocks.series_block(monthly_orders(spark, sf_dir), "seq", "doc_1", "Orders")
    return out.select("block_type", "date_column", F.array_join("value_columns", ",").alias("value_columns"), "start_date", "end_date", "frequency", "observation_count", "text")


@query(f"WITH {MONTHS_SQL} SELECT 'table' AS block_type, 'doc_1' AS document_id, 400 AS n_chars, true AS truncated FROM k HAVING count(*) > 20 UNION ALL SELECT 'time_series', 'doc_1', 400, true FROM k HAVING count(*) > 20")
def evidence_payload(spark, sf_dir):
    """A table's blocks as a prompt gets them: cut, and told so."""
    found = blocks.payload(blocks.table_blocks(monthly_orders(spark, sf_dir), "seq", "doc_1", "Orders"), 400)
    return found.select("block_type", "document_id", F.char_length("text").alias("n_chars"), "truncated")


@query("""
    SELECT p_partkey, concat_ws(chr(10), 'Chart title: ' || p_name, CASE WHEN p_partkey % 2 = 0 THEN 'Description: ' || p_type END, 'Extracted data: {"size":' || p_size || '}', CASE WHEN p_partkey % 3 = 0 THEN 'Image reference: i' || p_partkey END) AS text FROM part""")
def chart_texts(spark, sf_dir):
    k = F.col("p_partkey")
    data = F.to_json(F.struct(F.col("p_size").alias("size")))
    return read(spark, sf_dir, "part").select(k, blocks.chart_text(F.col("p_name"), F.when(k % 2 == 0, F.col("p_type")), data, F.when(k % 3 == 0, F.concat(F.lit("i"), k)).otherwise("")).alias("text"))


@query(r"""
    SELECT doc_id AS evidence_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, CASE WHEN doc_id % 2 = 0 THEN 'http://a' ELSE 'http://fallback' END AS source_url FROM documents WHERE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> ''""")
def evidence_with_text(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text", F.when(F.col("doc_id") % 2 == 0, "http://a").otherwise("").alias("source_url"))
    return blocks.with_text(rows, "http://fallback")


@query("""
    SELECT o_custkey AS doc, CASE WHEN o_custkey % 4 = 1 THEN 'out of bounds' WHEN o_custkey % 4 = 2 THEN 'not contiguous' WHEN o_custkey % 4 = 3 THEN 'not covered' END AS problem FROM orders GROUP BY o_custkey HAVING count(*) >= 2""")
def chunk_tiles(spark, sf_dir):
    """Ranges of two paragraphs each, some of them spoilt: which do not tile their document?"""
    totals = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg((F.count("*") * 2).alias("paragraphs")).filter("paragraphs >= 4")
    k = F.col("doc") % 4
    ranges = totals.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("paragraphs") / 2) - 1)))
    last = F.col("i") == F.floor(F.col("paragraphs") / 2) - 1
    ranges = ranges.filter(~((k == 3) & last)).select("doc", (F.col("i") * 2 + F.when((k == 2) & (F.col("i") == 0), 1).otherwise(0)).cast("long").alias("start_paragraph"), (F.col("i") * 2 + 1 + F.when((k == 1) & last, 9).otherwise(0)).cast("long").alias("end_paragraph"))
    return blocks.tiles(ranges, totals, "doc")


# ---------------------------------------------------------------- extraction


ENTITY_SQL = """
    ev AS (SELECT document, id FROM (SELECT unnest(range(0, 40)) AS document), (SELECT unnest(['e0', 'e1']) AS id) WHERE NOT (document = 39 AND id = 'e0')),
    raw AS (SELECT p_partkey % 40 AS document, p_partkey AS place, 'x' || p_partkey AS old_id, CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 10 = 3 THEN 'ghost' ELSE 'product' END AS kind, p_type AS d FROM part),
    e0 AS (SELECT *, CASE place % 3 WHEN 0 THEN CASE WHEN document = 39 THEN 1 ELSE 2 END WHEN 1 THEN 2 ELSE 1 END AS refs FROM raw WHERE kind <> 'ghost'),
    e1 AS (SELECT *, row_number() OVER (PARTITION BY document, lower(name) ORDER BY place) AS k FROM e0),
    ent AS (SELECT *, 'e' || row_number() OVER (PARTITION BY document ORDER BY place) AS entity_id FROM e1 WHERE k = 1)"""


def raw_entities(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    first = F.when(k % 3 == 0, '"e0"').when(k % 3 == 1, '"e1"').otherwise('"e2"')
    record = F.concat(F.lit('{"entity_id": "x'), k, F.lit('", "name": " '), name, F.lit('", "type": "'), F.when(k % 10 == 3, "ghost").otherwise("product"), F.lit('", "description": "'), F.col("p_type"), F.lit('", "aliases": ["a", " "], "evidence": ['), first, F.lit(', {"evidence_id": "e1", "quote": "q"}, 5]}'))
    return read(spark, sf_dir, "part").select((k % 40).alias("document"), k.alias("place"), record.alias("record"))


def evidence_of(spark):
    return spark.range(40).select(F.col("id").alias("document"), F.explode(F.array(F.lit("e0"), F.lit("e1"))).alias("evidence_id")).filter("NOT (document = 39 AND evidence_id = 'e0')")


@query(f"WITH {ENTITY_SQL} SELECT document, entity_id, old_id, name AS canonical_name, kind AS entity_type, 'a' AS aliases, d AS description, refs FROM ent")
def extraction_entities(spark, sf_dir):
    out = extraction.entities(raw_entities(spark, sf_dir), evidence_of(spark), ["product", "company"])
    return out.select("document", "entity_id", "old_id", "canonical_name", "entity_type", F.array_join("aliases", ",").alias("aliases"), "description", F.size("refs").alias("refs"))


@query(f"""
    WITH {ENTITY_SQL}, rr AS (SELECT p_partkey % 40 AS document, p_partkey AS place, 'x' || p_partkey AS s, 'x' || (p_partkey + 40 * (p_partkey % 4)) AS o, CASE WHEN p_partkey % 7 = 0 THEN 'sings' ELSE 'uses' END AS r FROM part UNION ALL
        SELECT p_partkey % 40, p_partkey + 1000000, 'x' || p_partkey, 'x' || (p_partkey + 40 * (p_partkey % 4)), 'uses' FROM part WHERE p_partkey % 5 = 0),
    j AS (SELECT rr.document, rr.place, a.entity_id AS subject_id, a.name AS subject, r AS relation_type, b.entity_id AS object_id, b.name AS object FROM rr JOIN ent a ON a.document = rr.document AND a.old_id = s JOIN ent b ON b.document = rr.document AND b.old_id = o WHERE r = 'uses' AND rr.document <> 39),
    k AS (SELECT *, row_number() OVER (PARTITION BY document, subject_id, relation_type, object_id ORDER BY place) AS k FROM j)
    SELECT document, 'r' || row_number() OVER (PARTITION BY document ORDER BY place) AS relation_id, subject_id, subject, relation_type, object_id, object, '2024' AS event_date, 0.5::DOUBLE AS confidence FROM k WHERE k = 1""")
def extraction_relations(spark, sf_dir):
    k = F.col("p_partkey")
    known = extraction.entities(raw_entities(spark, sf_dir), evidence_of(spark), ["product", "company"])

    def rows(df, place, kind):
        record = F.concat(F.lit('{"subject_id": "x'), k, F.lit('", "object_id": "x'), k + 40 * (k % 4), F.lit('", "relation_type": "'), kind, F.lit('", "confidence": 0.5, "temporal": {"event_date": " 2024 "}, "evidence": ["e0", "e0"]}'))
        return df.select((k % 40).alias("document"), place.alias("place"), record.alias("record"))

    part = read(spark, sf_dir, "part")
    raw = rows(part, k, F.when(k % 7 == 0, "sings").otherwise("uses")).unionByName(rows(part.filter("p_partkey % 5 = 0"), k + 1000000, F.lit("uses")))
    return extraction.relations(raw, known, evidence_of(spark), ["uses"]).select("document", "relation_id", "subject_id", "subject", "relation_type", "object_id", "object", "event_date", "confidence")


# ---------------------------------------------------------------- local graph


def graph_rows(spark, sf_dir):
    """Two rows a supplier, as a graph store gives them: claim with evidence, and a path that says more of the same."""
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    node = lambda labels, props: F.concat(F.lit('{"kind": "node", "labels": ' + labels + ', "properties": {'), *props, F.lit("}}"))
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    s = node('["Entity"]', [F.lit('"key": "company::'), k, F.lit('", "canonical_name": "'), F.col("s_name"), F.lit('", "entity_type": "company", "description": " "')])
    c = node('["Claim"]', [F.lit('"key": "cl_'), k, F.lit('", "relation_type": "located_in", "grounding_score": 0.5')])
    o = node('["Entity"]', [F.lit('"key": "country::'), n, F.lit('", "name": "'), F.col("n_name"), F.lit('"')])
    ev = node('["Evidence"]', [F.lit('"evidence_id": "ev_'), k, F.lit('", "text": "balance of '), F.col("s_name"), F.lit('", "block_type": "'), F.when(k % 2 == 0, "table").otherwise("text"), F.lit('"')])
    one = F.concat(F.lit('{"s": '), s, F.lit(', "c": '), c, F.lit(', "o": '), o, F.lit(', "ev": ['), ev, F.lit("]}"))
    more = node('["Company", "Entity"]', [F.lit('"key": "company::'), k, F.lit('", "name": "other", "description": "d '), k, F.lit('"')])
    triple = F.concat(F.lit('{"subject": {"key": "company::'), k, F.lit('", "name": "other"}, "relation": {"type": "KG_REL", "properties": {"claim_key": "cl_'), k, F.lit('", "relation_type": "located_in", "grounding_score": 0.9}}, "object": {"key": "country::'), n, F.lit('"}}'))
    two = F.concat(F.lit('{"p": {"kind": "path", "nodes": ['), more, F.lit('], "triples": ['), triple, F.lit("]}}"))
    return rows.select((k * 2).alias("seq"), one.alias("row")).unionByName(rows.select((k * 2 + 1).alias("seq"), two.alias("row")))


def merged_graph(spark, sf_dir):
    return local_graph.merge(*local_graph.ingest(graph_rows(spark, sf_dir), "seq", "row"))


@query("""
    SELECT 'company::' || s_suppkey AS key, s_name AS name, 'company' AS entity_type, 'd ' || s_suppkey AS description, 'Company,Entity' AS labels FROM supplier
    UNION ALL SELECT DISTINCT 'country::' || n_nationkey, n_name, 'unknown', NULL, 'Entity' FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def local_graph_nodes(spark, sf_dir):
    return merged_graph(spark, sf_dir)[0].select("key", "name", "entity_type", "description", F.array_join("labels", ",").alias("labels"))


@query("""
    SELECT 'cl_' || s_suppkey AS claim_key, 'company::' || s_suppkey AS subject_key, s_name AS subject, 'located_in' AS relation, 'country::' || s_nationkey AS object_key, n_name AS object, 0.9::DOUBLE AS grounding_score, 'ev_' || s_suppkey AS evidence_ids
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def local_graph_edges(spark, sf_dir):
    return merged_graph(spark, sf_dir)[1].select("claim_key", "subject_key", "subject", "relation", "object_key", "object", "grounding_score", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("SELECT 'ev_' || s_suppkey AS evidence_id, 'balance of ' || s_name AS text, 'cl_' || s_suppkey AS claim_key, CASE WHEN s_suppkey % 2 = 0 THEN 'table' ELSE 'text' END AS block_type FROM supplier")
def local_graph_evidence(spark, sf_dir):
    return merged_graph(spark, sf_dir)[2].select("evidence_id", "text", "claim_key", "block_type")


@query("""
    SELECT 'node' AS dimension, 'company' AS value, count(*) AS n FROM supplier UNION ALL SELECT 'node', 'unknown', count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'edge', 'located_in', count(*) FROM supplier
    UNION ALL SELECT 'evidence', CASE WHEN s_suppkey % 2 = 0 THEN 'table' ELSE 'text' END, count(*) FROM supplier GROUP BY ALL
    UNION ALL SELECT 'total', 'nodes', count(*) + count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'total', 'edges', count(*) FROM supplier UNION ALL SELECT 'total', 'evidence', count(*) FROM supplier""")
def local_graph_summary(spark, sf_dir):
    """Counts of a merged graph that went through its JSON form and back."""
    parts = local_graph.from_json(local_graph.to_json(*merged_graph(spark, sf_dir)))
    totals = local_graph.counts(*parts).unpivot([], ["nodes", "edges", "evidence"], "value", "n").select(F.lit("total").alias("dimension"), "value", "n")
    return local_graph.summary(*parts).unionByName(totals)


def claim_graph(spark, sf_dir):
    return kg_nodes(spark, sf_dir), graph.projection(kg_claims(spark, sf_dir))


@query("""
    SELECT 'digraph {' AS line UNION ALL SELECT '}' UNION ALL SELECT '  "region::' || r_regionkey || '" [label="' || r_name || '\\n[region]"];' FROM region UNION ALL SELECT '  "country::' || n_nationkey || '" [label="' || n_name || '\\n[country]"];' FROM nation
    UNION ALL SELECT '  "country::' || n_nationkey || '" -> "region::' || n_regionkey || '" [label="located_in\\n0.80"];' FROM nation""".replace("\\\\n", "\\n"))
def graph_dot(spark, sf_dir):
    nodes, edges = claim_graph(spark, sf_dir)
    return local_graph.dot(nodes.filter("entity_type IN ('region', 'country')"), edges.filter("subject_key LIKE 'country%'"))


@query(f"""
    WITH {CLAIM_SQL}, k AS (SELECT claim_key, g + 0.15 * (CAST(contains(s || ' ' || r || ' ' || o, 'region') AS INTEGER) + CAST(contains(s || ' ' || r || ' ' || o, 'product') AS INTEGER)) AS relevance, s, r, o FROM c)
    SELECT claim_key, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC, s, r, o) AS i FROM k) WHERE i <= 80""")
def graph_context(spark, sf_dir):
    """The edges that a question is shown; the budget is the operator's own."""
    nodes, edges = claim_graph(spark, sf_dir)
    none = spark.createDataFrame([], "evidence_id string, text string")
    return local_graph.context(nodes, edges, none, "which region has a product")[1].select("claim_key", F.round("relevance", 6).alias("relevance"))


@query("""
    SELECT n_nationkey, round(480 + 300 * cos(2 * pi() * n_nationkey / (SELECT count(*) FROM nation)), 6) AS x, round(390 + 300 * sin(2 * pi() * n_nationkey / (SELECT count(*) FROM nation)), 6) AS y FROM nation""")
def circle_layout(spark, sf_dir):
    return local_graph.circle(read(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# ---------------------------------------------------------------- risk models


REQUESTS = [
    {"block_id": "customers", "operation": "group_sum", "group_by": "c_mktsegment", "value_column": "c_acctbal"},
    {"block_id": "customers", "operation": "concentration", "group_by": "c_mktsegment", "value_column": "c_acctbal"},
    {"block_id": "nowhere", "operation": "group_sum"},
    {"block_id": "customers", "operation": "divination"},
    {"block_id": "customers", "operation": "top_n", "value_column": "c_acctbal", "n": "7"},
    {"block_id": "orders", "operation": "volatility", "value_column": "o_totalprice"},
    {"block_id": "customers", "operation": "column_stats", "value_column": "no_such_column"},
    {"block_id": "orders", "operation": "time_series_summary"},
]


@query("""
    SELECT * FROM (VALUES (0, 'group_sum', true, (SELECT count(DISTINCT c_mktsegment) FROM customer), NULL), (1, 'concentration', true, 1, NULL), (2, 'group_sum', false, 1, 'Block not found.'), (3, 'divination', false, 1, 'Unsupported operation: divination'),
        (4, 'top_n', true, 7, NULL), (5, 'volatility', true, 1, NULL), (6, 'column_stats', false, 1, 'column'), (7, 'time_series_summary', true, 1, NULL)) t(request, operation, ok, n, error)""")
def table_requests(spark, sf_dir):
    """Requests over two blocks; wrong ones become rows with their error."""
    found = analysis.execute(spark, REQUESTS, {"customers": read(spark, sf_dir, "customer"), "orders": read(spark, sf_dir, "orders")})
    error = F.when(F.col("request") == 6, F.when(F.col("error").isNotNull(), "column")).otherwise(F.col("error"))
    return found.groupBy("request", "operation", "ok", error.alias("error")).agg(F.count("*").alias("n"))


def models(spark, sf_dir):
    k = F.col("n_nationkey")
    factor = lambda i: F.concat(F.lit(f'{{"name": "f{i}", "mechanism": "m{i}", "severity": '), (k + i) % 5 + 1, F.lit(', "likelihood": "'), (k * 2 + i) % 5 + 1, F.lit('", "exposure": 9, "mitigation": "none", "required_variables": ["v'), (k + i) % 3, F.lit('"]}'))
    text = F.concat(F.lit('{"risk_factors": ['), factor(0), F.lit(", "), factor(1), F.lit(', null], "quantitative_variables": [{"name": "", "value": "1,200"}, {"name": "b", "value": "x"}], "scenarios": [{"exposure_value": "50", "shock_pct": 0.5, "pass_through_pct": 1}], "missing_variables": ["v0", " "]}'))
    return read(spark, sf_dir, "nation").select(k, text.alias("json"))


MODEL_SQL = """
    f AS (SELECT n_nationkey AS model, i, (n_nationkey + i) % 5 + 1 AS s, (n_nationkey * 2 + i) % 5 + 1 AS l FROM nation, (SELECT unnest([0, 1]) AS i)),
    a AS (SELECT model, i, round(s * l * 5 / 125.0 * 100, 2)::DOUBLE AS adj, s * l * 5 / 125.0 * 100 AS raw FROM f),
    o AS (SELECT model, 0.6 * max(adj) + 0.4 * avg(adj) AS o FROM a GROUP BY 1),
    m AS (SELECT model, count(DISTINCT v) AS missing FROM (SELECT n_nationkey AS model, 'v0' AS v FROM nation UNION ALL SELECT model, 'v' || ((model + i) % 3) FROM f) GROUP BY 1),
    x AS (SELECT o.model, o, missing, greatest(0, least(100, 20 + 0 + 8 + 5 + 4 - 4 * missing + 3)) AS c FROM o JOIN m USING (model))"""
LEVEL_SQL = "CASE WHEN o >= 71 THEN 'severe' WHEN o >= 41 THEN 'high' WHEN o >= 21 THEN 'moderate' ELSE 'low' END"
CONFIDENCE_SQL = "CASE WHEN c >= 75 THEN 'high' WHEN c >= 45 THEN 'moderate' ELSE 'low' END"


def assessed(spark, sf_dir):
    parts = analysis.parse_model(models(spark, sf_dir), "n_nationkey", "json")
    done = models(spark, sf_dir).select(F.col("n_nationkey").alias("model"), F.lit(0).alias("request"), F.lit(True).alias("ok"))
    none = spark.createDataFrame([], "model int")
    return analysis.assess(parts, done, none), parts


@query(f"""
    WITH {MODEL_SQL} SELECT model, round(o, 2)::DOUBLE AS risk_score, {LEVEL_SQL} AS risk_level, round(c, 2)::DOUBLE AS confidence_score, {CONFIDENCE_SQL} AS confidence_level, 2::BIGINT AS factors, 1::BIGINT AS variables, missing, 1::BIGINT AS tables, 0::BIGINT AS evidence FROM x""")
def risk_assessment(spark, sf_dir):
    return assessed(spark, sf_dir)[0]


@query(f"""
    WITH {MODEL_SQL}, l AS (SELECT model, string_agg('- f' || i || ': ' || CASE WHEN raw >= 71 THEN 'severe' WHEN raw >= 41 THEN 'high' WHEN raw >= 21 THEN 'moderate' ELSE 'low' END || ' (' || adj || '/100). m' || i, chr(10) ORDER BY i) AS fs FROM a GROUP BY 1)
    SELECT x.model, concat_ws(chr(10), 'Bottom line', 'Risk is ' || upper({LEVEL_SQL}) || ' (' || format('{{:.1f}}', round(o, 2)::DOUBLE) || ' of 100), held with ' || {CONFIDENCE_SQL} || ' confidence (' || format('{{:.1f}}', c::DOUBLE) || ' of 100).', '', 'Risk factors', fs,
        '', 'Quantitative variables', '- unnamed variable: 1200.0', '', 'Scenarios', '- unnamed scenario: impacted value 25.0') AS opening FROM x JOIN l USING (model)""")
def risk_memo(spark, sf_dir):
    """The memo up to what is missing."""
    memo = analysis.memo(*assessed(spark, sf_dir))
    return memo.select("model", F.substring_index("memo", "\n\nMissing variables", 1).alias("opening"))


# ---------------------------------------------------------------- manifests and batch runs


FILE_SQL = """CASE p_partkey % 6 WHEN 0 THEN '/data/in/' || p_partkey || '.pdf' WHEN 1 THEN '/data/tmp/' || p_partkey || '.HTML' WHEN 2 THEN '/data/in/' || p_partkey || '.exe' WHEN 3 THEN '/data/in/~' || p_partkey || '.csv' WHEN 4 THEN '/data/in/a' || p_partkey || '.pdf.metadata.json' ELSE '/data/in/r' || p_partkey || '.md' END"""


def listed_files(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(FILE_SQL).alias("path"))


@query(f"SELECT p_partkey, {FILE_SQL} AS path FROM part WHERE p_partkey % 6 = 0")
def discovered_files(spark, sf_dir):
    """Files that are sources and fit no exclusion."""
    path = F.col("path")
    return listed_files(spark, sf_dir).filter(manifest.is_source_file(path, []) & ~manifest.excluded(path, ["/data/tmp/*", "~*.cs[uv]"]))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'side ' || p_partkey ELSE 'base' END AS title, 'web' AS origin FROM part WHERE p_partkey % 6 = 0""")
def sidecar_metadata(spark, sf_dir):
    files = listed_files(spark, sf_dir).filter("p_partkey % 6 = 0")
    k = F.col("p_partkey")
    notes = files.filter("p_partkey % 4 = 0").select(F.concat("path", F.lit(".metadata.json")).alias("path"), F.concat(F.lit('{"title": "side '), k, F.lit('", "author": ""}')).alias("content"))
    notes = notes.unionByName(files.filter("p_partkey % 2 = 0").select(F.regexp_replace("path", "pdf$", "meta.json").alias("path"), F.concat(F.lit('{"title": "side '), k, F.lit('"}')).alias("content")))
    rows = manifest.with_sidecars(files, notes)
    m = manifest.merged(F.create_map(F.lit("title"), F.lit("base"), F.lit("origin"), F.lit("web")), F.col("metadata"), F.create_map(F.lit("origin"), F.lit("")))
    return rows.select(k, m["title"].alias("title"), m["origin"].alias("origin"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 1 ORDER BY p_partkey LIMIT 25")
def selected_sources(spark, sf_dir):
    """The first sources with one of the tags: a limit is part of the request."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("s"), "p_partkey").alias("source_id"), F.array(F.lit("all"), F.concat(F.lit(" t"), F.col("p_partkey") % 3)).alias("tags"))
    return manifest.selected(rows, "p_partkey", wanted=["t1"], limit=25).select("p_partkey")


@query(f"""
    WITH p AS (SELECT page_id, {pick_sql('page_id', ['registered', 'registered_duplicate', 'failed'])} AS status FROM pages)
    SELECT 'origin' AS dimension, 'dir' AS value, count(*) AS n FROM p UNION ALL SELECT 'extension', 'url', count(*) FROM p UNION ALL SELECT 'registration', status, count(*) FROM p GROUP BY ALL
    UNION ALL SELECT 'kind', 'url', count(*) FROM p WHERE status = 'registered' UNION ALL SELECT 'acquisition', 'acquired', count(*) FROM p WHERE status = 'registered'
    UNION ALL SELECT 'excluded', 'duplicate', count(*) FROM p WHERE status = 'registered_duplicate' UNION ALL SELECT 'excluded', 'pipeline', count(*) FROM p WHERE status = 'failed'""")
def manifest_summary(spark, sf_dir):
    k = F.col("page_id")
    status = pick("page_id", ["registered", "registered_duplicate", "failed"])
    rows = read(spark, sf_dir, "pages").select(
        F.concat(F.lit("s"), k).alias("source_id"), F.col("url").alias("source"), F.lit("dir:/data").alias("origin"), status.alias("status"), F.when(status == "registered_duplicate", "s0").alias("duplicate_of"),
        F.lit("acquired").alias("acquisition_status"), F.when(status == "failed", "failed").alias("last_status"), F.lit("url").alias("source_kind"),
    )
    return manifest.summary(rows, rows, rows.filter("status = 'registered'"))


@query("""
    WITH s AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, stage, place FROM s, (SELECT unnest(['acquire', 'extract', 'sarg']) AS stage, unnest([0, 1, 2]) AS place)),
    d AS (SELECT DISTINCT user_id, CASE event_id % 3 WHEN 0 THEN 'acquire' WHEN 1 THEN 'extract' ELSE 'sarg' END AS stage FROM events WHERE event_type <> 'error' AND event_id % 5 <> 0)
    SELECT g.user_id AS source_id, place, g.stage, CASE WHEN d.user_id IS NOT NULL AND g.stage <> 'sarg' THEN 'skip' ELSE 'run' END AS action FROM g LEFT JOIN d USING (user_id, stage)""")
def stage_plan(spark, sf_dir):
    """Stages that a resumed run skips; from the last stage on all run anew."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.when(k % 3 == 0, "acquire").when(k % 3 == 1, "extract").otherwise("sarg").alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), (k % 5 != 0).alias("has_output"))
    return manifest.plan_stages(rows, rows, ["acquire", "extract", "sarg"], force_from="sarg")


@query("""
    WITH s AS (SELECT DISTINCT user_id AS u FROM events)
    SELECT u AS source_id, 'acquire' AS stage, CASE WHEN u % 4 = 0 THEN 'skipped_cached' WHEN u % 4 = 1 THEN 'failed' ELSE 'success' END AS status FROM s
    UNION ALL SELECT u, 'extract', CASE WHEN u % 4 = 1 THEN 'blocked' WHEN u % 4 = 2 THEN 'failed' ELSE 'success' END FROM s""")
def batch_run(spark, sf_dir):
    """A run of two stages: some sources are cached, some fail, none stops another."""
    sources = read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct()
    done = sources.filter("source_id % 4 = 0").select("source_id", F.lit("acquire").alias("stage"), F.lit("success").alias("status"), F.lit(True).alias("has_output"))
    stages = {"acquire": lambda df: df.withColumn("ok", F.col("source_id") % 4 != 1), "extract": lambda df: df.withColumn("ok", F.col("source_id") % 4 != 2)}
    return manifest.run_batch(sources, done, stages, save=saved)


# ---------------------------------------------------------------- fusion and validation


def seen_entities(spark, sf_dir):
    """Each order line as a version of its part, seen by a run, corpus, branch and source."""
    k = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("product::"), k).alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("n"), F.col("l_linenumber"))).alias("canonical_name"),
        F.lit("product").alias("entity_type"), F.lit(None).cast("string").alias("description"), F.col("l_returnflag").alias("postrag_decision"), (F.col("l_quantity") / 100).alias("grounding_score"),
        F.concat(F.lit("run"), F.col("l_linenumber")).alias("run_id"), F.col("l_linestatus").alias("corpus_id"), F.col("l_returnflag").alias("branch_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("source_id"),
    )


@query("""
    WITH v AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, * FROM lineitem)
    SELECT 'product::' || l_partkey AS key, arg_min('n' || l_linenumber, seq) FILTER (l_linenumber > 1) AS canonical_name, 'product' AS entity_type, arg_max(l_returnflag, seq) AS postrag_decision, arg_max(l_quantity / 100, seq) AS grounding_score,
        string_agg(DISTINCT 'run' || l_linenumber, ',' ORDER BY 'run' || l_linenumber) AS run_ids, string_agg(DISTINCT 's' || (l_suppkey % 3), ',' ORDER BY 's' || (l_suppkey % 3)) AS source_ids, arg_max(l_linestatus, seq) AS latest_corpus_id, count(*) AS versions
    FROM v GROUP BY l_partkey""")
def fused_entities(spark, sf_dir):
    out = fusion.merge_entities(seen_entities(spark, sf_dir))
    return out.select("key", "canonical_name", "entity_type", "postrag_decision", "grounding_score", F.array_join("run_ids", ",").alias("run_ids"), F.array_join("source_ids", ",").alias("source_ids"), "latest_corpus_id", "versions")


@query("""
    WITH v AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE regexp_replace(url, '[?#].*', '') END AS u, 'src' || (page_id % 9) AS s FROM pages), k AS (SELECT coalesce(u, 'id:' || s) AS source_key, * FROM v)
    SELECT source_key, arg_min(s, page_id) AS first_source_id, CASE WHEN max(page_id) % 2 = 0 THEN 't' || max(page_id) END AS title, string_agg(DISTINCT s, ',' ORDER BY s) AS source_ids, count(*) AS versions FROM k GROUP BY 1""")
def fused_sources(spark, sf_dir):
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "pages").select(
        k.alias("seq"), F.when(k % 4 != 0, F.regexp_replace("url", "[?#].*", "")).alias("url"), F.concat(F.lit("src"), k % 9).alias("source_id"), F.when(k % 2 == 0, F.concat(F.lit("t"), k)).alias("title"),
        none.alias("publisher"), none.alias("published_at"), none.alias("document_id"), F.lit("r").alias("run_id"), F.lit("c").alias("corpus_id"), F.lit("b").alias("branch_id"),
    )
    return fusion.merge_sources(rows).select("source_key", "first_source_id", "title", F.array_join("source_ids", ",").alias("source_ids"), "versions")


@query("""
    SELECT 'corpus' AS kind, l_linestatus AS key, NULL AS parent FROM lineitem GROUP BY 2 UNION ALL SELECT 'branch', l_linestatus || '::' || l_returnflag, l_linestatus FROM lineitem GROUP BY 2, 3
    UNION ALL SELECT DISTINCT 'run', 'run' || l_linenumber, l_linestatus || '::' || l_returnflag FROM lineitem""")
def fused_scopes(spark, sf_dir):
    return fusion.scopes(seen_entities(spark, sf_dir))


@query("""
    SELECT p_partkey AS entity, CASE WHEN p_partkey % 5 = 1 THEN 'old' || p_partkey ELSE 'new' || p_partkey END AS resolved_key, CASE WHEN p_partkey % 5 = 1 THEN 'merge_with_existing' ELSE 'create_new' END AS merge_decision,
        CASE p_partkey % 5 WHEN 0 THEN 'no candidates' WHEN 1 THEN 'same' WHEN 2 THEN 'same' WHEN 3 THEN 'unlike' ELSE 'no valid candidate chosen' END AS merge_reason FROM part""")
def resolved_entities(spark, sf_dir):
    """A judge's merges count only where they name a candidate that was shown."""
    k = F.col("p_partkey")
    entities = read(spark, sf_dir, "part").select(k.alias("entity"), F.concat(F.lit("new"), k).alias("incoming_key"))
    part = read(spark, sf_dir, "part").filter("p_partkey % 5 <> 0")
    candidates = part.select(F.concat(F.lit("new"), k).alias("incoming_key"), F.explode(F.array(F.concat(F.lit("old"), k), F.lit("z"))).alias("key"))
    decisions = part.filter("p_partkey % 5 <> 4").select(F.concat(F.lit("new"), k).alias("incoming_key"), F.when(k % 5 == 3, "create_new").otherwise("merge_with_existing").alias("decision"), F.concat(F.when(k % 5 == 2, "ghost").otherwise("old"), k).alias("merge_key"), F.when(k % 5 == 3, "unlike").otherwise("same").alias("reason"))
    return fusion.resolve(entities, candidates, decisions).select("entity", "resolved_key", "merge_decision", "merge_reason")


CANDIDATE_SQL = """
    c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'relation' ELSE 'entity' END AS kind, unnest([doc_id % 40, doc_id % 7 + 100000]) AS evidence_id FROM labels),
    i AS (SELECT DISTINCT doc_id, kind, evidence_id FROM c JOIN documents d ON d.doc_id = evidence_id)""".replace("JOIN documents d ON d.doc_id = evidence_id", "WHERE evidence_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")


def pointed_candidates(spark, sf_dir):
    k = F.col("doc_id")
    candidates = read(spark, sf_dir, "labels").select(F.when(k % 3 == 0, "relation").otherwise("entity").alias("kind"), k.alias("candidate_id"), F.array(k % 40, k % 7 + 100000).alias("evidence_ids"))
    evidence = read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(k.alias("evidence_id"))
    return candidates, evidence


@query(f"""
    WITH {CANDIDATE_SQL}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY evidence_id, kind ORDER BY doc_id) - 1) / 3) AS INTEGER) AS batch FROM i)
    SELECT evidence_id, kind, batch, count(*) AS candidates FROM b GROUP BY ALL UNION ALL SELECT -1, CASE WHEN doc_id % 3 = 0 THEN 'relation' ELSE 'entity' END, -1, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM i) GROUP BY ALL""")
def block_batches(spark, sf_dir):
    """Candidates by the block they point to, in batches of three, and those that point nowhere."""
    candidates, evidence = pointed_candidates(spark, sf_dir)
    index, rest = fusion.block_index(candidates, evidence)
    found = fusion.batches(index, 3).groupBy("evidence_id", "kind", "batch").agg(F.count("*").alias("candidates"))
    return found.unionByName(rest.groupBy("kind").agg(F.count("*").alias("candidates")).withColumns({"evidence_id": F.lit(-1).cast("long"), "batch": F.lit(-1)}))


@query(f"""
    WITH {CANDIDATE_SQL}, v AS (SELECT evidence_id, kind, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'reject' ELSE 'accept' END AS decision FROM i WHERE doc_id % 4 <> 0)
    SELECT doc_id AS candidate_id, decision, 'judged' AS how FROM v UNION ALL SELECT doc_id, NULL, 'unresolved' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM v)""")
def block_verdicts(spark, sf_dir):
    """Verdicts that were asked for, the last of each; candidates without one are unresolved."""
    candidates, evidence = pointed_candidates(spark, sf_dir)
    index, _ = fusion.block_index(candidates, evidence)
    k = F.col("candidate_id")
    given = index.filter(k % 4 != 0).withColumns({"seq": F.lit(2), "decision": F.when(k % 5 == 0, "reject").otherwise("accept")})
    noise = index.withColumns({"seq": F.lit(1), "decision": F.lit("coarsen")}).filter(k % 4 != 0).unionByName(index.withColumns({"evidence_id": F.lit(-5).cast("long"), "seq": F.lit(3), "decision": F.lit("accept")}))
    judged = fusion.expected_verdicts(index, given.unionByName(noise))
    return judged.select("candidate_id", "decision", F.lit("judged").alias("how")).unionByName(fusion.unresolved(candidates, judged).select("candidate_id", F.lit(None).cast("string").alias("decision"), F.lit("unresolved").alias("how")))


# ---------------------------------------------------------------- questions and retrieval


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _says(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"


QUESTION = "CASE turn % 4 WHEN 0 THEN 'How does ' || text WHEN 1 THEN 'Explain it' WHEN 2 THEN 'Steel?' ELSE text END"
NORMAL_SQL = r"trim(regexp_replace(regexp_replace(lower(q), '[''’]s\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""
    WITH q AS (SELECT conv_id, turn, coalesce({QUESTION}, '') AS q FROM conversations), n AS (SELECT *, {NORMAL_SQL} AS n, regexp_extract_all(q, '([A-Za-z0-9][A-Za-z0-9\-]+)', 1) AS t FROM q),
    s AS (SELECT *, list_filter(t, lambda x: length(x) >= 3 AND trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) NOT IN ({_words(planning.PLAN_STOP)})) AS u FROM n),
    d AS (SELECT *, list_filter(u, lambda x, i: list_position(u, x) = i)[1:12] AS terms FROM s), e AS (SELECT *, len(terms) AS k, greatest(1, least(3, len(terms) // 3)) AS e, trim(regexp_replace(q, '\s+', ' ', 'g')) AS flat FROM d),
    w AS (SELECT *, CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(substr(flat, 1, 77)) || '...' END AS whole FROM e),
    p AS (SELECT *, CASE WHEN k > 2 THEN terms[1:e] WHEN k > 0 THEN terms[1:1] ELSE [whole] END AS a, CASE WHEN k > 2 THEN terms[k - e + 1:k] WHEN k > 1 THEN terms[2:2] ELSE [whole] END AS z FROM w)
    SELECT conv_id, turn, array_to_string(a, ',') AS start, CASE WHEN k > 2 THEN array_to_string(list_filter(terms, lambda x: NOT list_contains(a, x) AND NOT list_contains(z, x))[1:4], ',') ELSE '' END AS bridge, array_to_string(z, ',') AS terminal,
        CASE WHEN {_says(planning.BACKWARD)} THEN 'backward' WHEN {_says(planning.FORWARD)} THEN 'forward' ELSE 'bidirectional' END AS direction, k >= 4 AS multi_hop FROM p""")
def question_plans(spark, sf_dir):
    p = planning.plan(F.expr(QUESTION))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *(F.array_join(p[c], ",").alias(c) for c in ("start", "bridge", "terminal")), p["direction"].alias("direction"), p["multi_hop"].alias("multi_hop"))


@query(rf"""
    WITH q AS (SELECT conv_id, turn, coalesce({QUESTION}, '') AS q FROM conversations), n AS (SELECT *, {NORMAL_SQL} AS n, regexp_extract_all(lower(q || ' ' || 'Impact of Ore'), '([A-Za-z0-9][A-Za-z0-9\-]+)', 1) AS t FROM q),
    u AS (SELECT *, list_filter(t, lambda x: length(x) >= 3 AND x NOT IN ({_words(planning.CONCEPT_STOP)})) AS u FROM n)
    SELECT conv_id, turn, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i)[1:12], ',') AS concepts, CASE WHEN {_says(planning.CLASSIFY_BACKWARD)} THEN 'backward' WHEN {_says(planning.CLASSIFY_FORWARD)} THEN 'forward' ELSE 'bidirectional' END AS direction FROM u""")
def question_concepts(spark, sf_dir):
    q = F.expr(QUESTION)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(planning.concepts(q, F.lit("Impact of Ore")), ",").alias("concepts"), planning.direction(q).alias("direction"))


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'about ' || p_name ELSE '' END AS terms, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name || ',' || p_brand ELSE '' END AS targets FROM part""")
def plan_terms(spark, sf_dir):
    """Distinctive terms of objectives, and targets that the start does not say already."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    terms = planning.objective_terms(F.when(k % 3 == 0, F.array(F.lit("the impact"), F.lit(" "), name)).otherwise(F.array(F.lit("risk"))), F.when(k % 3 == 1, F.concat(F.lit("about "), name)).otherwise(F.lit("supply chain")))
    targets = planning.distinct_targets(F.when(k % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(name, brand)), F.when(k % 3 == 0, F.array(name)).otherwise(F.array(F.lit("nothing"))))
    return read(spark, sf_dir, "part").select(k, F.array_join(terms, ",").alias("terms"), F.array_join(targets, ",").alias("targets"))


@query(f"""
    WITH {CLAIM_SQL}, l AS (SELECT * FROM c WHERE r = 'located_in'), a AS (SELECT 'region::1' AS key), e1 AS (SELECT claim_key, s, o FROM l WHERE s IN (SELECT key FROM a) OR o IN (SELECT key FROM a)),
    n1 AS (SELECT key FROM a UNION SELECT s FROM e1 UNION SELECT o FROM e1), e2 AS (SELECT claim_key, s, o FROM l WHERE s IN (SELECT key FROM n1) OR o IN (SELECT key FROM n1)), n2 AS (SELECT key FROM n1 UNION SELECT s FROM e2 UNION SELECT o FROM e2)
    SELECT 'node' AS kind, key AS name FROM n2 UNION ALL SELECT 'edge', claim_key FROM e2 UNION ALL SELECT 'evidence', claim_key || '#' || evidence_id FROM ev WHERE claim_key IN (SELECT claim_key FROM e2) UNION ALL SELECT 'status', 'partial: rounds spent'""")
def retrieval_rounds(spark, sf_dir):
    """Two rounds around a region, within a budget that is not reached."""
    claims = kg_claims(spark, sf_dir).filter("relation = 'located_in'")
    anchors = spark.createDataFrame([("region::1",)], "key string")
    everything = 1 << 40
    found = retrieval.retrieve(anchors, graph.projection(claims), kg_links(spark, sf_dir, claims), retrieval.Budget(2, 1 << 30, everything, everything, everything), saved)
    parts = found.nodes.select(F.lit("node").alias("kind"), F.col("key").alias("name")).unionByName(found.edges.select(F.lit("edge").alias("kind"), F.col("claim_key").alias("name")))
    links = found.links.select(F.lit("evidence").alias("kind"), F.concat("claim_key", F.lit("#"), "evidence_id").alias("name"))
    return parts.unionByName(links).unionByName(spark.createDataFrame([("status", f"{found.status}: {found.reason}")], "kind string, name string"))


@query("""
    WITH e AS (SELECT lower(trim(p_name)) AS k, arg_min(p_name, p_partkey) AS query, min(p_partkey) AS place FROM part WHERE p_partkey % 4 <> 3 GROUP BY 1)
    SELECT query, CASE WHEN place % 4 = 0 THEN 'r' ELSE '' END AS reason, 'medium' AS priority FROM e ORDER BY place % 4 <> 0, place LIMIT 7""".replace("min(p_partkey) AS place", "arg_min(p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE 1000000000 + p_partkey END) AS place").replace("arg_min(p_name, p_partkey)", "arg_min(p_name, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE 1000000000 + p_partkey END)"))
def acquisition_requests(spark, sf_dir):
    """Requests of a retrieval, each once, the first seven: a limit of the feature."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").filter("p_partkey % 4 <> 3").select(k.alias("place"), F.concat(F.lit(" "), F.when(k % 4 == 1, F.upper("p_name")).otherwise(F.col("p_name"))).alias("query"), F.when(k % 4 == 0, F.lit(" r ")).alias("reason"), F.lit("").alias("priority"))
    out = retrieval.merged_requests(rows.filter("place % 4 = 0"), rows.filter("place % 4 <> 0"), 7)
    return out.withColumn("query", F.lower("query"))
