import hashlib
import re

from riskloom.llm import exact_dedup as E


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    out = {}
    for i, t in rows:
        same = [(x, y or "") for x, y in rows if norm(y) == norm(t)]
        keep = min(same, key=lambda r: (-len(r[1]), r[0]))[0]
        out[i] = (keep, len(same), keep == i, hashlib.sha256(norm(t).encode()).hexdigest())
    return out


def test_against_brute_force(spark, documents):
    rows = [(i, "hot  copy" + " " * (i % 7)) for i in range(60)] + [(100 + i, f"text {i % 9} x") for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \n\t\x0b"), (203, "long " * 20000), (204, "long" * 20000), (205, "a b")]
    for support in (0.0005, 0.1, 1.0):  # most digests heavy, some, none
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.decide(documents(rows), support=support).collect()}
        assert got == brute(rows)


def test_repeated_rows_and_null_ids(spark, documents):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    got = E.decide(documents(rows)).collect()
    assert len(got) == 5
    assert sum(r.kept for r in got) == 2
    assert {r.keep_id for r in got if r.group_size == 3} == {1}


def test_empty(spark, documents):
    assert E.decide(documents([])).collect() == []
    assert E.deduplicated(documents([])).collect() == []


def test_deduplicated_keeps_columns(spark, documents):
    docs = documents([(1, "a b"), (2, "ab"), (3, "c")])
    out = E.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_no_python_in_the_plan(spark, documents):
    plan = E.decide(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deduplicated_repeated_rows_and_null_ids(spark, documents):
    rows = [(5, "x y"), (5, "x y"), (1, "a"), (1, "a"), (7, "a"), (7, "a"), (None, "a"), (None, "b"), (None, "b"), (3, "b  "), (3, "c"), (None, None), (None, "")]
    for support in (0.0005, 1.0):  # digests heavy, none
        out = E.deduplicated(documents(rows), support=support)
        assert out.columns == documents(rows).columns
        got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str)
        assert got == sorted([(5, "x y"), (1, "a"), (3, "b  "), (3, "c"), (None, "")], key=str)


def test_deduplicated_with_clashing_columns(spark):
    rows = [(1, "a b", 5, "k"), (2, "ab", 6, "l"), (2, "ab", 6, "l"), (3, "c", 7, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest int, `__winner.x` string")
    out = E.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b", 5, "k"), (3, "c", 7, "m")]


def test_winners_by_join(spark, documents, monkeypatch):
    """Without broadcasts the same rows stay."""
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    rows = [(i, f"t {i % 4}" + " " * (i % 3)) for i in range(40)]
    got = {r.doc_id for r in E.deduplicated(documents(rows), support=1.0).collect()}
    assert got == {i for i, keep in ((i, v[0]) for i, v in brute(rows).items()) if i == keep}
