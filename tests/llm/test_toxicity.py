import random

import numpy as np

from riskloom.llm import toxicity as T

BAD = ["grobal", "snurfen", "plonkish"]


def corpus(n=900):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}xy" .replace("0", "a").replace("1", "b") for _ in range(rnd.randrange(5, 60))]
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        toxic, poor = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "a", "ing", "ers"]))
        text = " ".join(w + "%%%" if poor else w for w in words)
        rows.append((i, text))
        if i % 3:
            labels.append((i, 0 if poor else 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    model = T.train(docs, label_table(spark, labels), T.CATEGORIES)
    assert model.held_out["toxic"] > 0.98 and model.held_out["low_quality"] > 0.97
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    seen = {i for i, _, _ in labels}
    unseen = [i for i, _ in rows if i not in seen]
    assert np.mean([got[i].toxic == (i % 7 == 0) for i in unseen]) > 0.98
    assert all(r.kept != r.toxic for r in got.values())
    kept = T.clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_later_models_see_out_of_fold_probabilities():
    """A second category that equals the first is learnt from the first one's probability alone."""
    rng = np.random.default_rng(1)
    n = 400
    y = (rng.random(n) < 0.4).astype(float)
    noise = rng.random((n, T.N_FORM))
    rows = [([0] if y[i] else [], noise[i], [y[i], y[i]], i % T.FOLDS) for i in range(n)]
    data = T.Sample(rows, {"bad": 0}, ["first", "second"])
    allowed = np.ones((T.FOLDS + 1, 1), bool)
    model = T.chain(data, ["first", "second"], {"bad": 0}, allowed)
    assert len(model.weights[1]) == len(model.weights[0]) + 1
    assert model.weights[1][1 + T.N_FORM] > 0.5  # the first category's probability counts
    assert model.held_out["second"] == 1.0


def test_chosen_features_of_a_fold_do_not_see_it(spark, documents):
    """Training accuracy on pure noise stays near the base rate out of fold."""
    rnd = random.Random(8)
    rows = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(40))) for i in range(300)]
    labels = [(i, 1, rnd.randrange(2)) for i in range(300)]
    model = T.train(documents(rows), label_table(spark, labels), {"toxic": "toxic"})
    assert model.held_out["toxic"] < 0.65


def test_odd_rows(spark, documents):
    rows, labels = corpus(300)
    rows += [(1000, None), (1001, ""), (1002, "x" * 200_000), (1003, "é" * 9), (1003, "é" * 9), (None, "grobal")]
    labels += [(1000, None, None), (1001, 1, 0), (1001, 1, 1), (None, 1, 1), (5000, 1, 1)]
    model = T.train(documents(rows), label_table(spark, labels), T.CATEGORIES)
    assert T.score(documents(rows), model).count() == len(rows)


def test_without_labels_and_empty(spark, documents):
    model = T.train(documents([(1, "a")]), label_table(spark, []), T.CATEGORIES)
    assert [r.toxic for r in T.score(documents([(1, "a"), (2, None)]), model).collect()] == [False, False]
    assert T.score(documents([]), model).collect() == []
    assert T.clean(documents([]), model).collect() == []


def test_one_value_only(spark, documents):
    rows, _ = corpus(100)
    model = T.train(documents(rows), label_table(spark, [(i, 1, 0) for i in range(100)]), T.CATEGORIES)
    assert not any(r.toxic for r in T.score(documents(rows), model).collect())


def test_labels_that_tell_nothing_reject_nothing():
    rng = np.random.default_rng(2)
    p, y = rng.random(60), np.array([1.0] * 8 + [0.0] * 52)
    p[y > 0] *= 0.3
    assert T.threshold(p, y) == T.NEVER
    assert 0.5 < T.threshold(np.array([0.9, 0.8, 0.7, 0.2, 0.1]), np.array([1.0, 1, 0, 0, 0])) < 0.9
