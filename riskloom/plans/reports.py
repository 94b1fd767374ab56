"""Queries over reports and artifacts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import web
from riskloom.operators import evals, local_graph, report
from riskloom.plans.catalog import CLAIM_SQL, eval_rows, kg_claims, kg_nodes, pick, pick_sql, query, read
from riskloom.plans.catalog import EVAL_SQL, SYSTEMS
from riskloom.plans.documents import merged_graph
from riskloom.sources import artifacts


@query("""
    SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'High' WHEN 1 THEN 'High' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Critical' WHEN 4 THEN 'Low' WHEN 5 THEN CASE WHEN s_acctbal / 100 >= 70 THEN 'High' WHEN s_acctbal / 100 >= 40 THEN 'Moderate' ELSE 'Low' END WHEN 6 THEN 'Not Run' ELSE 'Moderate' END AS risk,
        CAST(CASE WHEN s_suppkey % 3 = 0 THEN 80 WHEN s_suppkey % 3 = 1 THEN 60 ELSE 0 END AS DOUBLE) AS bar, CASE WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'medium' END AS tone FROM supplier""")
def overall_risks(spark, sf_dir):
    k = F.col("s_suppkey")
    explicit = F.when(k % 8 == 0, " high").when(k % 8 == 1, "low").when(k % 8 == 2, "moderate")
    summary = F.when(k % 8 == 1, "There are shortages.").when(k % 8 == 3, "A severe case").when(k % 8 == 4, "limited exposure").otherwise("nothing")
    mean, status = F.when(k % 8 == 5, F.col("s_acctbal") / 100), F.when(k % 8 == 6, "Disabled")
    bar, tone = report.factor_bar(F.when(k % 3 == 0, 80.0).otherwise(0.0), F.when(k % 3 == 2, 0.0), F.when(k % 3 == 1, 3.0))
    return read(spark, sf_dir, "supplier").select(k, report.overall_risk(explicit, summary, F.lit("**ok**"), mean, status).alias("risk"), bar.alias("bar"), tone.alias("tone"))


@query("""
    WITH g AS (SELECT p_size, trim(p_type) AS t, min(p_partkey) AS o FROM part GROUP BY ALL), n AS (SELECT p_size, count(*) AS n, string_agg(t, '|' ORDER BY o) AS items FROM g GROUP BY 1)
    SELECT p_size, CAST(n + (p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT AS INTEGER) AS total,
        array_to_string((string_split(items, '|') || CASE WHEN p_size % 2 = 0 THEN ['Usable time-series evidence for forecasting'] ELSE [] END || CASE WHEN p_size % 3 = 0 THEN ['Automatic text extraction for one or more uploaded documents'] ELSE [] END)[1:8], '|') AS items FROM n""")
def evidence_gaps(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_size", "p_partkey", F.concat(F.lit(" "), "p_type").alias("missing"))
    found = report.gaps(rows, "p_size", "p_partkey", "missing", F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    return found.select("p_size", "total", F.array_join("items", "|").alias("items"))


@query(r"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'Page ' || (doc_id % 9) ELSE 'Evidence excerpt' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'S' || doc_id ELSE 'Attached source' END AS source, 'Evidence block' AS date,
        CASE WHEN x = '' THEN 'No text available.' WHEN length(x) <= 360 THEN x ELSE rtrim(substr(x, 1, 359)) || '…' END AS text FROM t""")
def evidence_cards(spark, sf_dir):
    k = F.col("doc_id")
    evidence = read(spark, sf_dir, "documents").select(k.alias("evidence_id"), F.when(k % 2 == 0, k % 9).alias("page"), F.when(k % 3 == 0, F.concat(F.lit(" S"), k)).alias("source_title"), F.lit(" ").alias("source_date"), "text")
    return report.evidence_cards(read(spark, sf_dir, "labels").select(k.alias("evidence_id")), evidence)


@query("""
    SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'blue') OR contains(p_name, 'bolt') THEN 'o1' END, CASE WHEN contains(lower(p_type), 'economy') THEN 'o2' END) AS covered,
        concat_ws(',', CASE WHEN NOT (contains(p_name, 'blue') OR contains(p_name, 'bolt')) THEN 'o1' END, CASE WHEN NOT contains(lower(p_type), 'economy') THEN 'o2' END) AS uncovered FROM part""")
def objective_coverage(spark, sf_dir):
    covered, left = report.coverage(F.concat_ws(" ", "p_name", "p_type"), {"o1": ["blue bolt"], "o2": ["the impact", "economy"]})
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(covered, ",").alias("covered"), F.array_join(left, ",").alias("uncovered"))


@query("""
    SELECT p_partkey, contains(lower(p_name || ' ' || p_type), 'small-bolt') OR (contains(lower(p_name || ' ' || p_type), 'small')::INT + contains(lower(p_name || ' ' || p_type), 'bolt')::INT) >= 2 AS fits, p_partkey % 2 = 0 AS open FROM part""")
def source_hints(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type")
    free = report.hint_matches(text, F.when(F.col("p_partkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("no such words here")))
    return read(spark, sf_dir, "part").select("p_partkey", report.hint_matches(text, F.lit("Small-Bolt")).alias("fits"), free.alias("open"))


@query(f"WITH {CLAIM_SQL}, n AS (SELECT 'region' AS t FROM region UNION ALL SELECT 'country' FROM nation UNION ALL SELECT 'company' FROM supplier UNION ALL SELECT 'product' FROM part) SELECT 'entity' AS kind, t AS type, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'relation', r, count(*) FROM c GROUP BY 2")
def graph_type_counts(spark, sf_dir):
    return report.type_counts(kg_nodes(spark, sf_dir), kg_claims(spark, sf_dir))


@query(f"WITH {EVAL_SQL}, m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, system, CAST(round(avg({m}), 3) AS DOUBLE) AS v FROM ev GROUP BY 2" for m in evals.METRICS) + """)
    SELECT metric, metric || ' & ' || max(v) FILTER (system = 'gpt_memo') || ' & ' || max(v) FILTER (system = 'simple_rag') || ' & ' || max(v) FILTER (system = 'graph') || ' & -- \\\\' AS line FROM m GROUP BY 1""")
def latex_table(spark, sf_dir):
    means = evals.means(eval_rows(spark, sf_dir), evals.METRICS).filter("task_type = 'all'")
    rows = means.unpivot(["system"], evals.METRICS, "metric", "v")
    return report.latex_rows(rows, "metric", "system", "v", [*SYSTEMS, "nobody"])


@query(f"""
    SELECT doc_id AS document_id, CAST(place AS INTEGER) AS place, kind AS block_type, 'b' || doc_id || '_' || place AS block_id, length(coalesce(text, '')) AS n_chars FROM (SELECT doc_id, text, unnest([0, 1]) AS place, unnest(['table', {pick_sql('doc_id', ['text', 'time_series'])}]) AS kind FROM documents) WHERE kind <> 'text'""")
def document_blocks(spark, sf_dir):
    """Documents written as JSON records and read back; text blocks are left out."""
    k = F.col("doc_id")
    block = lambda i, kind: F.struct(F.lit(i).alias("place"), F.concat(F.lit("b"), k, F.lit(f"_{i}")).alias("block_id"), kind.alias("block_type"), k.cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = read(spark, sf_dir, "documents").select(F.explode(F.array(block(0, F.lit("table")), block(1, pick("doc_id", ["text", "time_series"])))).alias("b")).select("b.*")
    back = artifacts.blocks_of(artifacts.document_records(rows, "place"))
    kept = artifacts.of_kind(back, "table").unionByName(artifacts.of_kind(back, "time_series"))
    return kept.select(F.col("document_id").cast("long").alias("document_id"), "place", "block_type", "block_id", F.char_length("text").cast("long").alias("n_chars"))


@query(r"""
    WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<head\b[^>]*>.*?</head\s*>|<template\b[^>]*>.*?</template\s*>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/ul|/ol|/table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM c)
    SELECT page_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM d""")
def page_texts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(web.plain_text(F.col("html"))).alias("text_md5"))


@query("SELECT 'ev_' || s_suppkey AS evidence_id, 'cl_' || s_suppkey AS claim_key FROM supplier WHERE s_suppkey % 2 = 0")
def table_evidence(spark, sf_dir):
    """Evidence of one kind out of a merged graph that was stored as JSON."""
    evidence = local_graph.from_json(local_graph.to_json(*merged_graph(spark, sf_dir)))[2]
    return artifacts.of_kind(evidence, "table").select("evidence_id", "claim_key")
