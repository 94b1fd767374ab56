"""Small fixtures with known results for the deterministic operators."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from riskloom.functions import numbers, text, web
from riskloom.operators import blocks, forecast, graph, reasoning, risk, tables, timeseries, verdicts
from riskloom.sources import readers, registry


def one(df):
    return df.collect()[0]


@pytest.fixture
def imports(spark):
    return spark.createDataFrame([("A", "80"), ("B", "15"), ("C", "5"), ("D", None), (None, "x")], "country string, imports_tonnes string")


@pytest.fixture
def prices(spark):
    rows = [("2025-03-01", 121.0), ("2025-01-01", 100.0), ("2025-02-01", 110.0), ("2025-04-01", 90.0), ("no date", 7.0)]
    return timeseries.observations(spark.createDataFrame(rows, "date string, price double"), "date", "price")


def test_table_operators(spark, imports):
    shares = {r.country: r.share_pct for r in tables.group_share(imports, "country", "imports_tonnes").collect()}
    assert shares == {"A": 80.0, "B": 15.0, "C": 5.0}
    c = one(tables.concentration_metrics(imports, "imports_tonnes", "country"))
    assert (c.total, c.top1_share_pct, c.top3_share_pct, c.hhi, c.concentration_level, c.rows_used) == (100.0, 80.0, 100.0, 6650.0, "severe", 3)
    s = one(tables.column_stats(imports, "imports_tonnes"))
    assert (s["count"], s.missing, s.maximum, s.median) == (3, 2, 80.0, 15.0)
    assert [r.country for r in tables.top_n(imports, "imports_tonnes", 2, ties=["country"]).collect()] == ["A", "B"]
    kinds = {r.column: (r.is_numeric, r.missing) for r in tables.table_summary(imports).collect()}
    assert kinds == {"country": (False, 1), "imports_tonnes": (True, 1)}
    none = one(tables.concentration_metrics(imports.filter("false"), "imports_tonnes"))
    assert (none.total, none.concentration_level, none.rows_used) == (0.0, "low", 0)
    assert one(tables.column_stats(imports.filter("country = 'A'"), "imports_tonnes")).std == 0.0


def test_missing_groups_are_named_none(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", -2.0)], "g string, v double")
    assert {r.g: r.v for r in tables.group_sum(df, "g", "v").collect()} == {"None": 1.0, "a": -2.0}


def test_exact_median(spark):
    for values in ([3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [5.0] * 7 + [1.0], [1.0], list(map(float, range(1001)))):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        want = sorted(values)
        assert tables.exact_median(df, F.col("v")) == (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2
    assert tables.exact_median(df.filter("false"), F.col("v")) is None


def test_time_series(prices):
    change = one(timeseries.percent_change(prices, "2025-01-01", "2025-03-31"))
    assert change.percent_change == pytest.approx(21.0) and change.end_date == date(2025, 3, 1)
    drop = one(timeseries.max_drawdown(prices))
    assert drop.max_drawdown_pct == pytest.approx(-25.6198, abs=1e-4)
    assert (drop.peak_date, drop.trough_date) == (date(2025, 3, 1), date(2025, 4, 1))
    v = one(timeseries.volatility(prices))
    assert v.observations == 3 and v.period_pct_change_mean == pytest.approx((10 + 10 - 25.6198) / 3, abs=1e-4)
    w = one(timeseries.window_change(prices, ("2025-01-01", "2025-02-28"), ("2025-04-01", "2025-04-30")))
    assert (w.baseline_mean, w.shock_mean, w.absolute_change) == (105.0, 90.0, -15.0)


def test_period_changes_skip_nulls_and_zeros(spark):
    rows = [("2025-01-01", 0.0), ("2025-01-02", 5.0), ("2025-02-03", None), ("2025-03-04", 10.0)]
    obs = timeseries.observations(spark.createDataFrame(rows, "d string, v double"), "d", "v")
    got = [r.change_pct for r in timeseries.period_changes(obs).orderBy("day").collect()]
    assert got == [None, None, 100.0]


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5%",), ("about 12.5 t",), ("NaN",), ("",), (None,), ("-3e2",)], "s string")
    rows = df.select(numbers.risk_float(F.col("s")).alias("r"), numbers.forecast_float(F.col("s")).alias("f"), numbers.graph_float(F.col("s")).alias("g")).collect()
    assert [r.r for r in rows] == [1234.5, None, None, None, None, -300.0]
    assert [r.f for r in rows] == [1234.5, 12.5, None, None, None, -300.0]
    assert [r.g for r in rows][4] == 0.0


def series(spark, values, periods):
    df = spark.createDataFrame(list(zip(periods, map(str, values), range(len(values)))), "period string, value string, ord int")
    return forecast.series_arrays(forecast.normalize_series(df, "period", "value", "ord"))


def test_forecasts(spark):
    annual = series(spark, [105000, 130000, 160000, 180000, 220000, 240000], range(2019, 2025))
    rows = forecast.forecast_series(annual, 3).orderBy("step").collect()
    assert [r.period for r in rows] == ["2025", "2026", "2027"] and rows[0].status == "computed"
    mean = (rows[0].naive + rows[0].moving_average + rows[0].linear_trend + rows[0].exponential_smoothing) / 4
    assert rows[0].value == pytest.approx(mean) and rows[0].seasonal_naive is None
    assert rows[0].lower < rows[0].value < rows[0].upper
    monthly = series(spark, [100 + i % 12 for i in range(24)], [f"{2023 + i // 12}-{i % 12 + 1:02d}" for i in range(24)])
    rows = forecast.forecast_series(monthly, 2, "seasonal_naive").orderBy("step").collect()
    assert [(r.period, r.value) for r in rows] == [("2025-01", 100.0), ("2025-02", 101.0)]
    assert rows[0].error_scale == pytest.approx(11.1)  # a perfect backtest falls back to a tenth of the last value
    short = forecast.forecast_series(series(spark, [1, 2], [2020, 2021]), 3).collect()
    assert [(r.status, r.value) for r in short] == [("unavailable", None)]


def test_duplicate_periods_keep_the_last(spark):
    df = spark.createDataFrame([("2020", "1", 0), ("2020", "2", 1), ("2019", "x 7", 2), ("2021", "?", 3)], "period string, value string, ord int")
    got = {r.period: r.value for r in forecast.normalize_series(df, "period", "value", "ord").collect()}
    assert got == {"2020": 2.0, "2019": 7.0}


def test_labels_of_periods(spark):
    from riskloom.functions.dates import next_label

    df = spark.createDataFrame([("2024-12", "month"), ("2024-Q4", "quarter"), ("2024", "year"), ("2024-01-05", "day")], "p string, f string")
    assert [r[0] for r in df.select(next_label(F.col("p"), F.lit(2), F.col("f"))).collect()] == ["2025-02", "2025-Q2", "2026", "t+2"]


def test_risk(spark):
    factors = spark.createDataFrame([("m", 5.0, 4.0, 5.0, 2.0, 3.0), ("m", 9.0, None, 1.0, 1.0, None)], "model string, severity double, likelihood double, exposure double, mitigation double, confidence double")
    scored = risk.score_factors(factors).orderBy(F.desc("adjusted_score")).collect()
    assert (scored[0].raw_score, scored[0].adjusted_score, scored[0].risk_level) == (80.0, 64.0, "high")
    assert (scored[1].severity, scored[1].likelihood, scored[1].confidence, scored[1].raw_score) == (5.0, 1.0, 3.0, 4.0)
    model = one(risk.score_model(risk.score_factors(factors), ["model"]))
    assert (model.risk_score, model.risk_level) == (52.0, "high")
    impact = spark.range(1).select(risk.scenario_impact(F.lit(0.8), F.lit(0.25), F.lit(0.5)).alias("x"), risk.scenario_impact(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("y"))
    assert one(impact).x == pytest.approx(0.1) and one(impact).y is None


def test_texts(spark):
    df = spark.range(1)
    got = one(df.select(
        text.normalize(F.lit("The Mine’s  Output, 2024!")).alias("n"), text.focus_terms(F.lit("What is the ore of the mine, ore?")).alias("f"),
        text.compact(F.lit("a  bc " * 9), 10).alias("c"), text.lexical_score(F.lit("ore supply"), F.lit("we restore it")).alias("l"),
        text.objective_score(F.lit("cobalt mine in Congo"), F.array(F.lit("cobalt supply"))).alias("o"),
    ))
    assert got.n == "the mine output 2024" and got.f == ["ore", "mine"] and got.c == "a bc a..."
    assert got.l == 0.5 and got.o == 1.0


def test_urls(spark):
    cases = {
        "HTTP://Www.A.org:80/a/../b//c/?utm_source=x&b=2&a=1&gclid=1#f": "http://www.a.org/b/c?a=1&b=2",
        "https://a.org": "https://a.org/",
        "https://a.org:8443/x/": "https://a.org:8443/x",
        "https://a.org/?q=a+b&e=%C3%A9&n": "https://a.org/?e=%C3%A9&n=&q=a+b",
        "ftp://a.org/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert [r[0] for r in df.select(web.canonicalize_url(F.col("u"))).collect()] == list(cases.values())


def test_pages(spark):
    html = '<html><head><meta property="og:title" content="T"><meta name="author" content=" A "><meta name="date" content="2025-01-01"><title> x\n y </title></head>'
    df = spark.createDataFrame([(html,), ("<title> x\n y </title>",), ("",)], "h string")
    rows = df.select(*(c.alias(k) for k, c in web.html_metadata(F.col("h")).items())).collect()
    assert (rows[0].title, rows[0].author, rows[0].published_at, rows[0].publisher) == ("T", "A", "2025-01-01", None)
    assert rows[1].title == "x y" and rows[2].title is None
    codes = [(200, "text/html", "http://a/", "<html>ok"), (200, "application/pdf", "http://a/x.pdf", "%PDF"), (403, None, "u", ""), (404, None, "u", ""), (None, None, "u", ""), (200, "application/octet-stream", "http://a/b", "x"), (200, "text/html", "u", "<html> CAPTCHA and Paywall")]
    df = spark.createDataFrame(codes, "s int, m string, u string, b string")
    got = [r[0] for r in df.select(web.fetch_class(F.col("s"), F.col("m"), F.col("u"), F.col("b"))).collect()]
    assert got == ["acquired", "acquired", "blocked", "not_found", "fetch_failed", "unsupported", "paywalled"]
    df = spark.createDataFrame([("https://www.reuters.com/x",), ("https://x.edu",), ("https://x.com",)], "u string")
    assert [r[0] for r in df.select(web.url_credibility(F.col("u"))).collect()] == [0.92, 0.75, 0.5]
    assert [r[0] for r in df.select(web.registry_credibility(web.domain(F.col("u")), F.lit("p"))).collect()] == [0.9, 0.6, 0.6]


def test_blocks(spark):
    df = spark.createDataFrame([(1, "2025-01-01", "DRC", "1,000"), (2, "2025-02-01", "Chile", "2"), (3, "2025-03-01", "Peru", None)], "k int, date string, country string, `production (t)` string")
    kinds = {r.column: (r.semantic_type, r.unit, r.non_null_count) for r in blocks.infer_schema(df, "k").collect()}
    assert kinds == {"date": ("date", None, 3), "country": ("categorical_or_text", None, 3), "production (t)": ("numeric", "t", 2)}
    assert one(blocks.infer_frequency(df, "date")).frequency == "monthly"
    docs = spark.createDataFrame([(1, "ab\n  abc \n\n" + "x" * 10), (2, ""), (3, "a\n\n" * 2000)], "doc_id long, text string")
    spans = [(r.paragraph_id, r.start_char, r.end_char, r.text) for r in blocks.paragraph_spans(docs, "doc_id", "text").collect()]
    assert spans == [(0, 3, 9, "abc"), (1, 11, 21, "x" * 10)]
    chunks = blocks.chunk_text(docs, "doc_id", "text").collect()
    assert [(r.doc_id, r.chunk) for r in chunks][:1] == [(1, 0)] and max(len(r.text) for r in chunks) <= 2500
    assert blocks.chunk_spans("a" * 600 + "\n\n" + "b" * 3000) == [(0, 600), (600, 3100), (3100, 3602)]


def test_registry(spark):
    rows = [("https://a.org/x?utm_source=1#f", "same", 0), ("https://A.org/x/", "other", 1), ("https://b.org", "same", 2), ("https://c.org", "new", 3)]
    found = registry.find_duplicates(registry.register(spark.createDataFrame(rows, "source string, content string, ord int"), "source", "content", "ord"))
    assert {r.seq: r.duplicate_of for r in found.collect()} == {0: None, 1: 0, 2: 0, 3: None}
    status = spark.createDataFrame([(1, None, "acquired", None), (2, 1, "acquired", "success"), (3, None, "blocked", None), (4, None, "acquired", "success"), (5, None, "acquired", "failed")], "source_id int, duplicate_of int, acquisition_status string, last_status string")
    got = {r.source_id: r.action for r in registry.plan(status, retry_failed=True).collect()}
    assert got == {1: "process", 2: "skip_duplicate", 3: "blocked", 4: "skip_cached", 5: "retry_failed"}
    assert {r.action for r in registry.plan(status, force=True).collect()} == {"force_reprocess"}
    merged = registry.upsert(status.select("source_id", "acquisition_status", "last_status"), spark.createDataFrame([(3, "acquired", None), (9, "acquired", "failed")], "source_id int, acquisition_status string, last_status string"), "source_id", ["acquisition_status"], ["last_status"])
    assert {r.source_id: (r.acquisition_status, r.last_status) for r in merged.collect()}[3] == ("acquired", None)


def test_verdicts(spark):
    rows = [(1, 0, "accept", "direct", "exact", "explicit", "explicit", "explicit", 7), (1, 1, "coarsen", "weak_indirect", "exact", "explicit", "explicit", "explicit", 8), (2, 2, "what", "nothing", None, None, None, None, 9)]
    df = spark.createDataFrame(rows, "c int, o int, decision string, support string, specificity string, entity_grounding string, temporal_grounding string, relation_grounding string, evidence_id int")
    normal = verdicts.normalize(df, F.lit(False))
    assert [(r.decision, r.support, r.grounding_score) for r in normal.orderBy("o").collect()] == [("accept", "direct", 0.96), ("reject", "weak_indirect", 0.61), ("reject", "ambiguous", 0.32)]
    best = {r.c: (r.decision, r.evidence_ids) for r in verdicts.aggregate(normal, "c", "o").collect()}
    assert best == {1: ("accept", ["7"]), 2: ("reject", ["9"])}


def test_graph(spark):
    nodes = spark.createDataFrame([("a", 0, "Alpha", "unknown", None, "p0", ["X"]), ("a", 1, "ALPHA", "company", "d", "p1", ["Y"]), ("b", 0, "Beta", "country", "", "p", ["X"])], "key string, seq int, name string, entity_type string, description string, properties string, labels array<string>")
    got = {r.key: (r.name, r.entity_type, r.description, r.properties, r.labels) for r in graph.upsert_nodes(nodes).collect()}
    assert got == {"a": ("Alpha", "company", "d", "p1", ["X", "Y"]), "b": ("Beta", "country", None, "p", ["X"])}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "subject_key string, object_key string")
    starts = spark.createDataFrame([("a",)], "key string")
    assert sorted(r.nodes for r in graph.paths(edges, starts, 3).collect()) == ["a > b", "a > b > c", "a > b > c > d"]
    with pytest.raises(ValueError):
        graph.paths(edges, starts, 9)
    valid = spark.range(1).select(graph.signature_is_valid(F.lit("company"), F.lit("operates"), F.lit("facility")).alias("x"), graph.signature_is_valid(F.lit("country"), F.lit("operates"), F.lit("facility")).alias("y"))
    assert tuple(one(valid)) == (True, False)


def test_reasoning(spark):
    nodes = spark.createDataFrame([("a", "cobalt mine", "facility", "in Congo"), ("b", "refiner", "company", "makes sulphate"), ("c", "battery plant", "facility", "cells"), ("d", "zoo", "facility", "")], "key string, label string, node_type string, description string")
    edges = spark.createDataFrame([("e1", "a", "b", "supplies", "", True), ("e2", "b", "c", "supplies", "", True), ("e3", "a", "d", "near", "", False)], "key string, subject_key string, object_key string, relation string, description string, supported boolean")
    plan = reasoning.Plan("how does the cobalt mine reach the battery plant", {"s": ["cobalt mine"]}, {"b": ["refiner"]}, {"t": ["battery plant"]})
    starts = reasoning.match_starts(nodes, ["cobalt mine"], plan)
    assert [(r.key, r.similarity) for r in starts.collect()] == [("a", 0.9)]
    best = reasoning.select_paths(reasoning.beam_paths(nodes, edges, starts.select("key"), plan), plan)
    assert best[0]["nodes"] == ["a", "b", "c"] and best[0]["covered"] == ["b", "s", "t"]
    assert ["a", "b"] not in [p["nodes"] for p in best]  # part of a better path
    assert reasoning.assess_gaps(best, plan)["status"] == "sufficient"
    assert reasoning.assess_gaps([], plan)["gap_type"] == "no_path"


def test_beam_asks_edges_for_its_ends_only(spark, monkeypatch):
    """Claims are summed for the ends of the beam alone, many ends give the same paths, and each direction its own."""
    nodes = spark.range(60).select(F.concat(F.lit("n"), "id").alias("key"), F.concat(F.lit("mine "), "id").alias("label"), F.lit("facility").alias("node_type"), F.lit("").alias("description"))
    links = spark.range(59).select(F.concat(F.lit("n"), "id").alias("s"), F.concat(F.lit("n"), F.col("id") + 1).alias("o")).groupBy("s", "o").agg(F.count("*").alias("n"))
    names = {"key": F.concat("s", F.lit("|"), "o"), "subject_key": F.col("s"), "object_key": F.col("o"), "relation": F.lit("supplies"), "description": F.lit(""), "supported": F.lit(True)}
    edges = links.select(*(c.alias(n) for n, c in names.items()))
    starts = spark.createDataFrame([("n30",), ("n7",)], "key string")
    got = {}
    for direction in ("bidirectional", "forward", "backward"):
        plan = reasoning.Plan("mine", {"s": ["mine"]}, direction=direction)
        few = reasoning.steps_from(edges, ["n30", "n7"], direction)
        plan_text = few._jdf.queryExecution().optimizedPlan().toString()
        assert plan_text.index("Aggregate [") < plan_text.index("n30")  # filtered before it is summed
        rows = lambda: sorted((r.path_key, r.hops, r.score, r.covered) for r in reasoning.beam_paths(nodes, edges, starts, plan).collect())  # noqa: B023, E731
        got[direction] = rows()
        with monkeypatch.context() as m:
            m.setattr(reasoning, "LITERALS", 0)
            assert rows() == got[direction]
    assert [p for p, h, *_ in got["forward"] if h == 4] == ["n30 > n31 > n32 > n33 > n34", "n7 > n8 > n9 > n10 > n11"]
    assert [p for p, h, *_ in got["backward"] if h == 4] == ["n30 > n29 > n28 > n27 > n26", "n7 > n6 > n5 > n4 > n3"]
    assert len(got["bidirectional"]) == 4 + 4 * 3


def test_chosen_paths_ask_no_edges_again(spark):
    """Edges are read once for each of three hops, and choosing among the paths reads no table."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    nodes = spark.createDataFrame([("a", "cobalt mine", "facility", ""), ("b", "refiner", "company", ""), ("c", "battery plant", "facility", "")], "key string, label string, node_type string, description string")
    edges = spark.createDataFrame([("e1", "a", "b", "supplies", "", True), ("e2", "b", "c", "supplies", "", True)], "key string, subject_key string, object_key string, relation string, description string, supported boolean")
    edges = edges.mapInArrow(counted, edges.schema)
    starts = spark.createDataFrame([("a",)], "key string")
    plan = reasoning.Plan("cobalt mine to battery plant", {"s": ["cobalt mine"]}, {"b": ["refiner"]}, {"t": ["battery plant"]})
    assert reasoning.select_paths(reasoning.beam_paths(nodes, edges, starts, plan), plan)[0]["nodes"] == ["a", "b", "c"]
    assert read.value == 3 * 2
    none = starts.filter("key = 'x'")
    assert reasoning.select_paths(reasoning.beam_paths(nodes, edges, none, plan), plan) == []


def test_search_asks_sources_for_keys_and_sends_few_steps(spark, monkeypatch):
    """Nodes and edges may be functions that are asked for the ends alone; many steps and many texts give the same as few."""
    nodes = spark.range(60).select(F.concat(F.lit("n"), "id").alias("key"), F.expr("elt(id % 7 + 1, 'iron', 'gold', 'lead', 'zinc', 'salt', 'coal', 'tin') || ' mine'").alias("label"), F.lit("facility").alias("node_type"), F.lit("").alias("description"))
    edges = spark.range(59).select(F.concat(F.lit("e"), "id").alias("key"), F.concat(F.lit("n"), "id").alias("subject_key"), F.concat(F.lit("n"), F.col("id") + 1).alias("object_key"), F.lit("supplies").alias("relation"), F.lit("").alias("description"), F.lit(True).alias("supported"))
    asked = []

    def near(keys):
        asked.append(sorted(keys))
        return edges.filter(F.col("subject_key").isin(keys) | F.col("object_key").isin(keys))

    plan = reasoning.Plan("mine", {"s": ["zinc mine"]}, depth=3, starts=2, direction="forward")
    starts = reasoning.match_starts(nodes, ["plant", "zinc mine"], plan, pinned=["n59"])
    want = [("n59", 0.95, "zinc mine"), ("n10", 0.9, "zinc mine")]
    assert [tuple(r) for r in starts.collect()] == want
    paths = lambda table, links: sorted((r.path_key, r.hops, r.score, r.covered) for r in reasoning.beam_paths(table, links, starts.select("key"), plan).collect())
    got = paths(lambda keys: nodes, near)
    assert asked == [["n10", "n59"], ["n11"], ["n12"]]
    assert [p for p, h, *_ in got if h == 3] == ["n10 > n11 > n12 > n13"]
    assert got == paths(nodes, edges)
    with monkeypatch.context() as m:
        m.setattr(reasoning, "STEPS", 0)
        assert got == paths(nodes, near)
        assert [tuple(r) for r in reasoning.match_starts(nodes, ["plant", "zinc mine"], plan, pinned=["n59"]).collect()] == want


def test_starts_score_each_text_once(spark):
    """5,000 nodes share three texts; scores are computed after the texts are made distinct."""
    nodes = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("key"), F.concat(F.lit("mine "), F.col("id") % 3).alias("label"), F.lit("facility").alias("node_type"), F.lit("").alias("description"))
    plan_text = reasoning.match_starts(nodes, ["mine 2"], reasoning.Plan("mine"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan_text  # nodes meet scored texts


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿date,my col,my col,\n2025-01-01,nan,2,x\n,,,\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["date", "my_col", "my_col_2", "column_4"] or len(df.columns) == 4
    assert df.count() == 1
    (tmp_path / "r.json").write_text('{"records": [{"date": "2025-01-01", "price": 1.5}, {"date": "2025-01-02", "price": 2.5}]}')
    assert readers.read_records(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "l.txt").write_text("# no\n\n a.pdf \nhttp://x\n")
    assert [r.source for r in readers.read_source_list(spark, str(tmp_path / "l.txt")).collect()] == ["a.pdf", "http://x"]
    assert readers.kind_of("a.TSV") == "csv"
    with pytest.raises(ValueError):
        readers.kind_of("a.exe")
