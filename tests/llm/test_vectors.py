import numpy as np

from riskloom.llm import components as C
from riskloom.llm import vector_graph as V


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, vec string").repartition(3)


def brute(rows, low=0.9):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in usable])
    hit = x @ x.T >= low
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    count = {i: 0 for i, _ in rows}
    for a, (i, _) in enumerate(usable):
        for b, (j, _) in enumerate(usable):
            if a != b and hit[a, b]:
                count[i] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (count[i], find(i), find(i) == i) for i, _ in rows}


def vectors(n=300):
    rng = np.random.default_rng(3)
    rows = []
    for base in rng.normal(size=(n // 6, 8)):
        rows += [(base + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.4])).astype(np.float32).tolist() for _ in range(6)]
    rows += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 4, [1e30] * 8, [1e-30] * 8, [float("inf")] * 8]
    return list(enumerate(rows, 5))


def collected(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(spark):
    rows = vectors()
    assert collected(V.near_duplicates(table(spark, rows))) == brute(rows)


def test_many_shards_and_blocks(spark, monkeypatch):
    """Small shards and blocks: most links go across, and recall is what the audit asks for."""
    monkeypatch.setattr(V, "PER_CENTROID", 60)
    monkeypatch.setattr(V, "BLOCK", 50)
    rows = vectors(600)
    got, want = collected(V.near_duplicates(table(spark, rows))), brute(rows)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_exact_where_no_audit_is_passed(spark, monkeypatch):
    """Vectors in one shard each, however many are asked for: links go across, and every audit fails."""

    class Narrow(V.Index):
        def __init__(self, reps, count, low, shards, *more):
            super().__init__(reps, count, low, 1, *more)

    monkeypatch.setattr(V, "Index", Narrow)
    monkeypatch.setattr(V, "PER_CENTROID", 10)
    monkeypatch.setattr(V, "BLOCK", 50)
    rng = np.random.default_rng(11)
    rows = [(base + 0.3 * rng.normal(size=8)).astype(np.float32).tolist() for base in rng.normal(size=(100, 8)) for _ in range(4)]
    rows = list(enumerate(rows + rows[:20]))
    assert collected(V.near_duplicates(table(spark, rows))) == brute(rows)


def test_audit_counts_queries_alike(spark):
    """All links of one dense group are found, and none of ten pairs."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=8) + 0.01 * rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(10, 8)), 2, axis=0) + 0.001 * rng.normal(size=(20, 8))])
    rows = {i: c for i, (c, _, _) in brute(list(enumerate(x.tolist()))).items()}
    assert sum(rows[i] for i in range(60)) > 0.99 * sum(rows.values())
    reps = spark.createDataFrame([(i, bytearray(v.astype("<f8").tobytes()), 1) for i, v in enumerate(x)], "id long, vec binary, weight long")
    counts = spark.createDataFrame([(i, rows[i]) for i in range(60)], "id long, n_links long")
    assert V.audit(reps, counts, 0.9) < 0.8


def test_empty_and_unusable(spark):
    assert V.near_duplicates(table(spark, [])).collect() == []
    assert collected(V.near_duplicates(table(spark, [(1, None), (2, [0.0])]))) == {1: (0, 1, True), 2: (0, 2, True)}


def test_pruned_lists_hold_the_nearest_first():
    x = np.eye(12)[:, :12] + 0.01 * np.random.default_rng(1).normal(size=(12, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = V.robust_prune(x)
    sims = x @ x.T - 2 * np.eye(12)
    assert (lists[:, 0] == sims.argmax(axis=1)).all()


def test_dense_blocks_are_verified_in_pieces(monkeypatch):
    """1,500 near copies: over a million links, of which few vectors are held at once."""
    import tracemalloc

    rng = np.random.default_rng(14)
    x = rng.normal(size=64) + 0.01 * rng.normal(size=(1500, 64))
    x = np.concatenate([x, rng.normal(size=(500, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names, weights, shards = np.arange(2000), np.ones(2000, np.int64), np.zeros((2000, 1), np.int64)
    monkeypatch.setattr(V, "PIECE", 1 << 20)
    tracemalloc.start()
    try:
        out = V.report(x, names, weights, shards, x, names, weights, shards, V.once(V.compare(x, x, names, 0.9), 2000), 0, 0.9, True)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20  # the vectors of all links at once would take 1,150 MB
    got = out.to_pandas().groupby("id").n_links.sum()
    assert len(got) == 1500 and (got == 1499).all()
    assert len(out.column(2).drop_null()) == 1499


def test_pairs_count_once():
    """Pairs that one side found, or both; more vectors than are queried at once."""
    rng = np.random.default_rng(15)
    hit = rng.random((203, 203)) < 0.02
    np.fill_diagonal(hit, False)
    found = [(np.nonzero(hit[i : i + V.AT_ONCE])[0] + i, np.nonzero(hit[i : i + V.AT_ONCE])[1]) for i in range(0, 203, V.AT_ONCE)]
    got = [(int(a), int(b)) for p, q in V.once(found, 203) for a, b in zip(p, q, strict=True)]
    assert sorted(got) == sorted({(min(a, b), max(a, b)) for a, b in zip(*np.nonzero(hit), strict=True)})


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []
