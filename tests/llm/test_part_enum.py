import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import part_enum as P
from riskloom.llm import shingles as S


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(P, "BUCKETS", (4, 1 << 16))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in sets}


def mutated(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"m{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    rows = []
    for base in range(25):
        words = [word() for _ in range(rnd.choice([3, 6, 9, 14, 30, 80, 200]))]
        for copy in range(rnd.randrange(1, 6)):
            rows.append(mutated(rnd, words, rnd.randrange(0, max(1, len(words) // 12) + 1)) if len(words) > 5 else " ".join(words))
    line = " ".join(f"common{k}" for k in range(40))  # a passage that many texts share
    rows += [" ".join([word() for _ in range(10)] + [line] + [word() for _ in range(rnd.randrange(3, 30))]) for _ in range(40)]
    rows += ["same text of some words here"] * 30 + ["SAME text\tof some\nwords  here", "É text of some words", "é text of some words"]
    rows += [None, "", " \n", "one", "One", "one two", "x " * 4000]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_sets_equal_those_of_python_sets():
    rows = [t for _, t in corpus()]
    sets, bounds = S.shingle_sets(pa.array([t or "" for t in rows]))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in rows]
    prints = S.fingerprints(sets, bounds).tolist()
    for (a, x), (b, y) in itertools.combinations(zip(prints, map(shingles, rows), strict=True), 2):
        assert (a == b) == (x == y)


def test_a_slice_of_an_array_gives_the_same_sets():
    texts = pa.array(["a b c d e f", "Q R", "x y z u v w", ""])
    whole, bounds = S.shingle_sets(texts)
    part, cuts = S.shingle_sets(texts.slice(1, 2))
    assert part.tolist() == whole[bounds[1] : bounds[3]].tolist() and np.diff(cuts).tolist() == [1, 2]


def test_similar_sets_share_a_signature():
    """For all sizes and numbers of differences, with and without members that are left out."""
    rng = np.random.default_rng(4)
    bands = P.Bands.of(Fraction(3, 4), 600)
    for trial in range(600):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 10, 16, 30, 70, 150, 400]))
        pool = np.unique(rng.integers(0, 1 << 62, 3 * n + 8).astype(np.uint64))
        rng.shuffle(pool)
        x = pool[:n]
        most = n * 4 // 3 - n + n // 4
        gone, new = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, most + 1))
        y = np.concatenate([x[gone:], pool[n : n + new]])
        both = len(np.intersect1d(x, y))
        if 4 * both < 3 * (len(x) + len(y) - both):
            continue
        left = np.sort(pool[: int(len(x) * rng.choice([0, 0, 0.5, 0.95]))])
        sets, bounds = np.concatenate([np.sort(x), np.sort(y)]), np.array([0, len(x), len(x) + len(y)])
        found, owner = P.signatures(sets, bounds, bands, left)
        assert both == len(x) == len(y) or np.intersect1d(found[owner == 0], found[owner == 1]).size, (trial, n, gone, new, len(left))


def test_against_brute_force(spark, documents):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.similar_groups(documents(rows, 4)).collect()}
    assert got == brute(rows)


def test_frequent_shingles_are_left_out_without_loss(spark, documents, monkeypatch):
    monkeypatch.setattr(P, "FREQUENT", 8)
    rows = corpus(11)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.similar_groups(documents(rows, 2)).collect()}
    assert got == brute(rows)


def test_large_groups_are_met_across_components(spark, documents, monkeypatch):
    """With SMALL at 2, most signatures give stars first and pairs of components afterwards."""
    monkeypatch.setattr(P, "SMALL", 2)
    rows = corpus(12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.similar_groups(documents(rows, 2)).collect()}
    assert got == brute(rows)


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.choice([2, 20, 300, 40_000]))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: len(x) - len(x) // 8], rng.integers(0, 1 << 62, n // 8).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        (m, a), (k, b) = (P.unpacked([r]) for r in P.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).to_pylist())
        assert (m[0], k[0]) == (len(x), len(y))
        for width in {min(a.shape[1], b.shape[1]), 8}:
            ok = P.may_be_similar(m, P.folded(a, width), k, P.folded(b, width), Fraction(3, 4))[0]
            assert ok or 4 * both < 3 * (len(x) + len(y) - both)


def test_sketches_rule_out_half_equal_sets():
    rng = np.random.default_rng(7)
    for n in (200, 3000, 20_000):
        pool = np.unique(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        x, y = np.sort(pool[:n]), np.sort(pool[n // 3 : n // 3 + n])
        (m, a), (k, b) = (P.unpacked([r]) for r in P.sketches(np.concatenate([x, y]), np.array([0, n, 2 * n])).to_pylist())
        assert not P.may_be_similar(m, a, k, b, Fraction(3, 4))[0]


def test_subsets_are_enumerated_and_few():
    """Each group gives a signature for each pair of its three partitions, and a set about one for each member."""
    rng = np.random.default_rng(8)
    bands = P.Bands.of(Fraction(3, 4), 5000)
    for n in (100, 517, 1000, 4800):
        x = np.sort(np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        found, _ = P.signatures(x, np.array([0, len(x)]), bands, np.zeros(0, np.uint64))
        assert 0.5 * n < len(found) == len(np.unique(found)) < 1.3 * n


def test_lists_meet_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(P, "SMALL", 2)
    monkeypatch.setattr(P, "BLOCK", 3)
    monkeypatch.setattr(P, "LISTED", 2)
    rows = corpus(13)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in P.similar_groups(documents(rows, 2)).collect()}
    assert got == brute(rows)


def test_repeated_ids(spark, documents):
    """Rows with one id and different texts, repeated rows and null ids are documents of their own."""
    rows = [(1, "a b c d e f g"), (1, "z y x w v"), (1, "a b c d e f g"), (None, "A b c d e f g"), (None, "q r"), (7, "z y x w v")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in P.similar_groups(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 1, 1), (1, 3, 1), (None, 3, 1), (None, 1, None), (7, 1, 1)], key=str)


def test_empty(spark, documents):
    assert P.similar_groups(documents([])).collect() == []
    assert [tuple(r) for r in P.similar_groups(documents([(5, None)])).collect()] == [(5, 0, 5)]
