import hashlib

from riskloom.llm import sharding as S


def brute(rows, limit):
    """Split buckets above the limit, one bit at a time."""
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16))[2:].zfill(64) for i, _ in rows}
    size = {i: len((t or "").encode()) for i, t in rows}
    out = {}

    def split(ids, depth):
        if sum(size[i] for i in ids) <= limit or len(ids) == 1:
            out.update({i: ("s" + bits[i][:depth], depth, size[i]) for i in ids})
            return
        for b in "01":
            part = [i for i in ids if bits[i][depth] == b]
            if part:
                split(part, depth + 1)

    split([i for i, _ in rows], 0)
    return out


def test_against_brute_force(spark, documents):
    rows = [(i, "é" * (i * 37 % 90)) for i in range(400)] + [(1000, "x" * 5000), (1001, None), (1002, "")]
    for limit, step in ((300, None), (300, 2), (100, 3), (10**6, None)):
        got = {r.doc_id: (r.shard_id, r.local_depth, r.n_bytes) for r in S.shards(documents(rows), limit, step=step).collect()}
        assert got == brute(rows, limit)


def test_equal_hashes_go_to_overflow_pages(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rows = [(7, "x" * n) for n in (40, 90, 40, 60, 50, 1, 0, 90, 300)] * 3 + [(None, "y" * 30)] * 9
    got = S.shards(documents(rows), 100, step=16).collect()
    assert len(got) == len(rows) and all(r.local_depth == 64 for r in got)
    pages = {}
    for r in got:
        pages.setdefault(r.shard_id, []).append(r.n_bytes)
    assert len(pages) > 12 and all(sum(p) <= 100 or len(p) == 1 for p in pages.values())


def test_no_python_in_the_plan(spark, documents):
    plan = S.shards(documents([(1, "a")]), 10)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark, documents):
    assert S.shards(documents([]), 100).collect() == []
