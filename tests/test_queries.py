"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_all_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reasoning_reads_all_nodes_and_claims(spark):
    """29 parts of the name and 739 claims on them at sf0.01: neither 20 and 40, nor only these."""
    from riskloom.plans import catalog

    sf_dir = "/root/testdata/sf0.01"
    nodes, edges = catalog.subgraph(spark, sf_dir)
    parts = nodes.filter("node_type = 'product' AND label = 'blue bolt'")
    assert parts.count() == 29
    assert edges.join(parts.selectExpr("key AS object_key"), "object_key", "left_semi").count() == 739
    assert nodes.count() == catalog.kg_nodes(spark, sf_dir).count() and edges.count() == catalog.kg_claims(spark, sf_dir).count()


def test_claims_and_nodes_at_keys_are_filtered_by_ids(spark):
    """At some keys: the same as of all, and the id is compared where the table is read."""
    from pyspark.sql import functions as F

    from riskloom.plans import catalog

    nodes, edges = catalog.searched(spark, DATA)
    keys = ["company::3", "country::4", "region::1", "product::7", "product::x", "product::99999999999999999999", None]
    all_rows = lambda df: sorted(tuple(r) for r in df.collect())
    ends = F.col("subject_key").isin(keys) | F.col("object_key").isin(keys)
    assert all_rows(edges(keys)) == all_rows(edges().filter(ends)) != []
    assert all_rows(nodes(keys)) == all_rows(nodes().filter(F.col("key").isin(keys))) and nodes(keys).count() == 4
    plan = edges(keys)._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(l_suppkey,3),EqualTo(l_partkey,7))" in plan
