import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from tests.llm.test_tokens import check_packing  # noqa: E402
from tests.llm.test_toxicity import corpus  # noqa: E402


def write(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    rows, labels = corpus(420)
    rnd = random.Random(3)
    base = " ".join(f"q{rnd.randrange(10**6)}" for _ in range(60))
    rows += [(2000 + i, base + " " * (i + 1)) for i in range(10)] + [(3000 + i, base + f" extra{i}") for i in range(10)]
    write(spark, str(tmp_path), rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        if k < 3:
            assert docs.columns == columns
            seen[name] = {r.doc_id for r in docs.collect()}
    toxic = {i for i, _ in rows if i < 420 and i % 7 == 0}
    gone = {i for i, _ in rows} - seen["toxicity"]
    assert len(gone & toxic) >= 0.97 * len(toxic) and len(gone - toxic) <= 0.02 * len(rows)
    text = dict(rows)
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t)
    want = {}
    for i in sorted(seen["toxicity"], key=lambda i: (-len(text[i]), i)):
        want.setdefault(norm(text[i]), i)
    assert seen["exact_dedup"] == set(want.values())
    assert seen["exact_dedup"] & set(range(2000, 2010)) == {2009}
    assert seen["ngram_jaccard_join"] & set(range(2000, 3010)) == {2009}
    padding, total = check_packing([(i, text[i]) for i in seen["ngram_jaccard_join"]], docs.collect())
    assert padding == 0 and total


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_copies_stage_with_repeated_rows_and_null_ids(spark, documents):
    docs = documents([(5, "x y"), (5, "x y"), (9, "xy"), (None, "z"), (None, "z"), (4, "w"), (4, "v")])
    got = sorted(((r.doc_id, r.text) for r in pipeline.without_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, "x y"), (None, "z"), (4, "w"), (4, "v")], key=str)


def test_stage_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "packing"]


def test_near_copies_stage_with_repeated_rows_and_null_ids(spark, documents):
    """One row of each group stays, whatever ids repeat or are null; texts without words all stay."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, base), (7, base + " x"), (7, base + " y"), (3, "q r s t u v"), (3, "q r s t u v"), (None, "a b c d e"), (None, "A B C D E"), (8, None), (8, ""), (9, "z " * 5000)]
    docs = documents(rows).withColumnRenamed("digest", "__row")
    out = pipeline.without_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, (r.text or "")[:9]) for r in out.collect()]
    assert sorted(i for i, t in got if t.startswith("w0")) == [7]
    assert len(got) == 6 and sorted(str(i) for i, _ in got) == ["3", "7", "8", "8", "9", "None"]


def test_nulls_and_long_texts_pass_all_stages(spark, tmp_path):
    rows, labels = corpus(420)
    rows += [(5000, None), (5001, ""), (None, "null id " * 9), (5002, "long text of words " * 3000), (5002, "long text of words " * 3000)]
    write(spark, str(tmp_path), rows, labels)
    got = pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert 5000 in ids and 5001 not in ids and None in ids
    assert sum(r.length for r in got if r.doc_id == 5002) == next(r.doc_tokens for r in got if r.doc_id == 5002)
    assert all(len(r.ids) == r.length for r in got)
