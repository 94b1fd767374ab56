"""Blocks, extractions, local graphs, risk models and batch runs on small fixtures."""

import json
import time

from pyspark.sql import functions as F

from riskloom.functions import ids, text
from riskloom.operators import analysis, blocks, contracts, extraction, graph, local_graph, tables, vectors, verdicts
from riskloom.sources import manifest


def test_paragraphs_are_linear_in_lines(spark):
    long = "\n".join(f"line {i}" if i % 3 else "  \t" for i in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "ab\n  abc \x0b\n\nöäü x")], "id long, t string")
    got = blocks.paragraph_spans(docs, "id", "t").filter("id <> 1").collect()  # starts the workers
    began = time.time()
    assert blocks.paragraph_spans(docs, "id", "t").filter("id = 1").count() == 66_666
    assert time.time() - began < 5
    assert [(r.id, r.paragraph_id, r.start_char, r.end_char, r.text) for r in got] == [(4, 0, 3, 10, "abc"), (4, 1, 12, 17, "öäü x")]


def test_table_and_series_blocks(spark):
    rows = spark.createDataFrame([(3, "2025-03-01", "MM", "12"), (1, "2025-01-01", "MM", "10"), (2, "2025-02-01", None, "11")], "seq int, date string, country string, production_tonnes string")
    found = {r.block_type: r for r in blocks.table_blocks(rows, "seq", "d1", "Production").collect()}
    assert set(found) == {"table", "time_series"}
    assert "Column schema: date=date; country=categorical_or_text; production_tonnes=numeric" in found["table"].text
    assert "Row 2: date: 2025-02-01; country: None; production_tonnes: 11" in found["table"].text
    series = blocks.series_block(rows, "seq", "d1").first()
    assert (series.value_columns, str(series.start_date), str(series.end_date), series.frequency, series.observation_count) == (["production_tonnes"], "2025-01-01", "2025-03-01", "monthly", 3)
    assert blocks.table_blocks(rows.limit(0), "seq", "d1").collect() == []
    assert blocks.series_block(rows.select("seq", "country"), "seq", "d1").collect() == []


def test_risk_model_of_the_documented_example(spark):
    table = spark.createDataFrame([("A", 80.0), ("B", 15.0), ("C", 5.0)], "country string, imports_tonnes double")
    series = spark.createDataFrame([("2025-01-01", 100.0), ("2025-02-01", 110.0), ("2025-03-01", 121.0), ("2025-04-01", 90.0)], "date string, price double")
    requests = [
        {"block_id": "t", "operation": "group_share", "group_by": "country", "value_column": "imports_tonnes"},
        {"block_id": "t", "operation": "concentration", "value_column": "imports_tonnes", "group_by": "country"},
        {"block_id": "s", "operation": "percent_change", "value_column": "price", "baseline_start": "2025-01-01", "baseline_end": "2025-03-31"},
        {"block_id": "s", "operation": "max_drawdown", "value_column": "price"},
        {"block_id": "s", "operation": "window_change", "value_column": "price"},
        {"block_id": "x", "operation": "max_drawdown"},
    ]
    got = {}
    for r in analysis.execute(spark, requests, {"t": table, "s": series}).collect():
        got.setdefault(r.request, []).append((r.ok, json.loads(r.result) if r.ok else r.error))
    assert max(x["share_pct"] for _, x in got[0]) == 80.0
    assert got[1][0][1]["concentration_level"] == "severe"
    assert round(got[2][0][1]["percent_change"], 6) == 21.0
    assert round(got[3][0][1]["max_drawdown_pct"], 1) == -25.6
    assert [ok for ok, _ in got[4]] == [False] and got[5] == [(False, "Block not found.")]
    assert analysis.execute(spark, [], {}).collect() == []
    model = {"risk_factors": [{"name": "f", "mechanism": "m", "severity": 5, "likelihood": 4, "exposure": 5, "mitigation": 2, "confidence": 4}], "scenarios": [{"name": "s", "exposure_value": 0.8, "shock_pct": 0.25, "pass_through_pct": 0.5}]}
    models = spark.createDataFrame([(1, json.dumps(model)), (2, None), (3, "broken"), (4, '{"missing_variables": ["x"]}')], "id int, j string")
    parts = analysis.parse_model(models, "id", "j")
    none = spark.createDataFrame([], "model int")
    done = spark.createDataFrame([], "model int, request int, ok boolean")
    rows = {r.model: r for r in analysis.assess(parts, done, none).collect()}
    assert rows[1].risk_score > 60 and rows[1].risk_level in ("high", "severe") and rows[4].risk_score == 0.0 and set(rows) == {1, 4}
    memos = {r.model: r.memo for r in analysis.memo(analysis.assess(parts, done, none), parts).collect()}
    assert "impacted value 0.1" in memos[1] and memos[4].endswith("Missing variables\n- x")


def node(key, name, **more):
    return {"kind": "node", "labels": ["Entity"], "properties": {"key": key, "canonical_name": name, **more}}


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "seq int, row string")


def test_local_graph_ingests_paths_claims_and_repeats(spark):
    a, b = node("e::a", "A", entity_type="company"), node("e::b", "B")
    rel = {"kind": "relationship", "type": "KG_REL", "properties": {"relation_type": "owns", "claim_key": "c1", "grounding_score": 0.8}, "start_node": {"key": "e::a"}, "end_node": {"key": "e::b"}}
    better = json.loads(json.dumps(rel))
    better["properties"]["grounding_score"] = 0.9
    path = {"kind": "path", "nodes": [b, a], "relationships": [rel]}  # nodes in the other order than the relationship
    claim = {"kind": "node", "labels": ["Claim"], "properties": {"key": "c2", "relation_type": "supplies", "grounding_score": "0.5"}}
    snippet = {"kind": "node", "labels": ["Evidence"], "properties": {"evidence_id": "ev_1", "text": "t"}}
    other = {**rel, "type": "MENTIONS"}
    graph_rows = rows_of(spark, {"p": path}, {"r": better}, {"r": rel}, {"o": b, "c": claim, "s": a, "ev": snippet}, {"r": other}, {"x": None, "y": 3}, {"list": [[node("e::z", "Z")]]})
    nodes, edges, evidence = local_graph.merge(*local_graph.ingest(graph_rows, "seq", "row"))
    assert {r.key: (r.name, r.entity_type) for r in nodes.collect()} == {"e::a": ("A", "company"), "e::b": ("B", "unknown"), "e::z": ("Z", "unknown")}
    got = {r.claim_key: (r.subject_key, r.relation, r.object_key, r.grounding_score, r.evidence_ids) for r in edges.collect()}
    assert got == {"c1": ("e::a", "owns", "e::b", 0.9, []), "c2": ("e::a", "supplies", "e::b", 0.5, ["ev_1"])}
    assert [(r.evidence_id, r.claim_key) for r in evidence.collect()] == [("ev_1", "c2")]
    lines = [r.line for r in local_graph.dot(nodes, edges).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and len(lines) == 7
    empty = local_graph.merge(*local_graph.ingest(graph_rows.limit(0), "seq", "row"))
    assert tuple(local_graph.counts(*empty).first()) == (0, 0, 0)


def test_extraction_renumbers_and_drops(spark):
    e = lambda i, name, kind="company", ev=("b1",): {"entity_id": i, "canonical_name": name, "entity_type": kind, "evidence": list(ev)}
    raw = [e("x", "Acme"), e("y", "ACME"), e("z", "Mine", "facility", [{"evidence_id": "b1", "quote": " q "}, "b1"]), e("w", "None", ev=["b9"]), e("v", "Odd", "planet"), {"entity_id": "u"}]
    evidence = spark.createDataFrame([(1, "b1")], "document int, evidence_id string")
    frame = lambda records: spark.createDataFrame([(1, i, json.dumps(r)) for i, r in enumerate(records)], "document int, place int, record string")
    known = extraction.entities(frame(raw), evidence, ["company", "facility"])
    assert [(r.entity_id, r.canonical_name, len(r.refs)) for r in known.orderBy("entity_id").collect()] == [("e1", "Acme", 1), ("e2", "Mine", 2)]
    rel = {"relation_id": "r9", "subject_id": "x", "relation_type": "operates", "object_id": "z", "evidence": ["b1"], "extraction_confidence": 0.7}
    found = extraction.relations(frame([rel, rel, {**rel, "object_id": "nobody"}, {**rel, "evidence": []}, {**rel, "temporal": {"event_date": "2024"}}]), known, evidence)
    assert [(r.relation_id, r.subject_id, r.object_id, r.event_date, r.confidence) for r in found.orderBy("relation_id").collect()] == [("r1", "e1", "e2", None, 0.7), ("r2", "e1", "e2", "2024", 0.7)]


def test_a_batch_resumes_and_isolates_failures(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    nothing = spark.createDataFrame([], "source_id string, stage string, status string, has_output boolean")
    ok = lambda df: df.withColumn("ok", F.lit(True))
    first = manifest.run_batch(sources, nothing, {"acquire": ok, "extract": ok})
    assert first.filter("status = 'success'").count() == 6
    again = manifest.run_batch(sources, first.withColumn("has_output", F.lit(True)), {"acquire": ok, "extract": ok})
    assert again.filter("status = 'skipped_cached'").count() == 6
    failing = manifest.run_batch(sources, nothing, {"acquire": lambda df: df.withColumn("ok", F.col("source_id") != "b"), "extract": ok})
    assert {(r.source_id, r.stage): r.status for r in failing.collect()} == {("a", "acquire"): "success", ("a", "extract"): "success", ("b", "acquire"): "failed", ("b", "extract"): "blocked", ("c", "acquire"): "success", ("c", "extract"): "success"}


def test_discovery(spark, tmp_path):
    for name, body in {"r.pdf": "x", "copy/r.pdf": "x", "p.html": "<p>", "p.html.metadata.json": '{"title": "P"}', "n.txt": "n", "bad.exe": "0"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(body)
    (tmp_path / "list.txt").write_text("# comment\nhttps://a.b/c\n\n")
    found = manifest.discover(spark, [str(tmp_path / "in")], [str(tmp_path / "list.txt")], exclude=["n.*"])
    rows = {r.source.rsplit("/", 2)[-2] + "/" + r.source.rsplit("/", 1)[-1]: r.metadata for r in found.collect()}
    assert set(rows) == {"in/r.pdf", "copy/r.pdf", "in/p.html", "a.b/c"} and rows["in/p.html"] == {"title": "P"}
    assert manifest.extensions([".PDF", "csv"]) == [".csv", ".pdf"]


def test_contracts_part_rows(spark):
    rows = spark.createDataFrame([("Acme", "company", None), ("Flood", "event", None), ("Fire", "event", "hazard"), ("", "company", None)], "canonical_name string, entity_type string, event_type string")
    good, bad = contracts.split(rows, "entity")
    assert {r.canonical_name for r in good.collect()} == {"Acme", "Fire"}
    assert {r.canonical_name: r.problems for r in bad.collect()} == {"Flood": ["event_type is empty"], "": ["canonical_name is empty"]}


def test_stable_hash_is_that_of_json(spark):
    import hashlib

    texts = ["a/b", 'q"uote', "é\n", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ids.stable_hash(F.col("t"), 20)).collect()
    assert [r[0] for r in got] == [hashlib.sha256(json.dumps(t, ensure_ascii=False).encode()).hexdigest()[:20] for t in texts]


def test_lexical_scores_of_bound_texts(spark):
    rows = spark.createDataFrame([("steel plant", "The steel plant's output"), ("steel plant", "Steel, plant!"), ("steel mill", "a steel works"), ("of", "x"), ("", "x"), (None, None)], "q string, t string")
    assert [r[0] for r in rows.select(text.lexical_score(F.col("q"), F.col("t"))).collect()] == [0.9, 1.0, 0.5, 0.0, 0.0, 0.0]


def test_median_of_many_equal_and_distinct_values(spark, monkeypatch):
    import random
    import statistics

    monkeypatch.setattr(tables, "SORTED", 50)
    rnd = random.Random(4)
    for values in ([rnd.random() for _ in range(5001)], [rnd.randrange(3) for _ in range(4000)], [7.0] * 300 + [1.0], [2.0, 4.0], [5.0]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert tables.exact_median(df, F.col("v")) == statistics.median(values)
    assert tables.exact_median(spark.createDataFrame([(None,)], "v double"), F.col("v")) is None


def test_verdict_evidence_keeps_first_places(spark):
    rows = [(1, 1, "reject", "direct", 0.9, "b"), (1, 2, "accept", "direct", 0.5, "a"), (1, 3, "accept", "absent", 0.9, "c"), (1, 4, "accept", "direct", 0.4, "a"), (2, 5, "reject", "absent", 0.1, "z"), (None, 6, "accept", "direct", 0.7, None)]
    df = spark.createDataFrame(rows, "c int, o int, decision string, support string, grounding_score double, evidence_id string")
    got = {r.c: (r.decision, r.grounding_score, r.evidence_ids, r.verdicts) for r in verdicts.aggregate(df, "c", "o").collect()}
    assert got == {1: ("accept", 0.5, ["a", "c"], 4), 2: ("reject", 0.1, ["z"], 1), None: ("accept", 0.7, [], 1)}


def test_neighbours_in_several_query_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(98, None), (99, [0.0] * 4), (97, x[0].tolist())], "id long, v array<double>")
    whole = {(r.query_id, r.rank): r.id for r in vectors.nearest(df, df, 5, "id", "v").collect()}
    monkeypatch.setattr(vectors, "QUERY_BYTES", 7 * 32)
    assert {(r.query_id, r.rank): r.id for r in vectors.nearest(df, df, 5, "id", "v").collect()} == whole
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    for i in range(1, 60):
        best = sorted((-round(s, 9), j) for j, s in [*((j, sims[i, j]) for j in range(60) if j != i), (97, sims[i, 0]), (99, 0.0)])[:5]
        assert [whole[i, k] for k in range(1, 6)] == [j for _, j in best]
    assert vectors.nearest(df.limit(0), df, 5, "id", "v").collect() == []


def test_upserts_hold_distinct_evidence(spark):
    rows = spark.createDataFrame([("k", 0.2, " ", 2, "b"), ("k", 0.9, "d", 3, "a"), ("k", 0.1, "e", 1, "a")], "edge_key string, grounding_score double, description string, seq int, evidence_id string")
    r = graph.upsert_edges(rows).first()
    assert (r.grounding_score, r.description, r.evidence_ids, r.versions) == (0.9, "e", ["a", "b"], 3)


def test_artifacts_are_swapped_and_read_back(spark, tmp_path):
    from riskloom.sources import artifacts

    rows = spark.createDataFrame([(0, "b0", "table", "d", "x"), (1, "b1", "text", "d", "y")], "place int, block_id string, block_type string, document_id string, text string")
    path = str(tmp_path / "registry")
    artifacts.replace(artifacts.document_records(rows.limit(1), "place"), path)
    artifacts.replace(artifacts.document_records(rows, "place"), path)
    back = artifacts.blocks_of(spark.read.json(path))
    assert [(r.place, r.block_id, r.text) for r in back.orderBy("place").collect()] == [(0, "b0", "x"), (1, "b1", "y")]
    assert [p.name for p in tmp_path.iterdir()] == ["registry"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps({"blocks": [{"block_id": "k", "block_type": "table"}]}, indent=1))
    (tmp_path / "docs" / "b.json").write_text("no json")
    docs = artifacts.read_documents(spark, str(tmp_path / "docs"))
    assert docs.filter("record IS NULL").count() == 1
    assert [r.block_id for r in artifacts.of_kind(artifacts.blocks_of(docs), "table").collect()] == ["k"]


def test_overall_risk_prefers_what_is_given(spark):
    from riskloom.operators import report

    rows = [("very high", "", None, None), ("Low", "price volatility ahead", None, None), (None, "low risk", 90.0, None), (None, "", 75.0, None), (None, "", None, "not_run"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "e string, s string, m double, t string")
    got = [r[0] for r in df.select(report.overall_risk(F.col("e"), F.col("s"), F.lit(""), F.col("m"), F.col("t"))).collect()]
    assert got == ["Very High", "High", "Low", "High", "Not Run", "Moderate"]
