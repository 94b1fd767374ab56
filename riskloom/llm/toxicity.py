"""Toxicity by a chain of linear classifiers over the judgements of labelled documents.

The categories come in a fixed order. The first model sees a document's features; each later
one also sees the probabilities of the categories before it. While it is trained, these are
out-of-fold: each labelled document gets them from models that haven't seen it. In prediction they
come from models fitted on all labelled documents.

Features are words and word beginnings (which catch inflected insults) that tell a category
apart, chosen by how far their frequencies differ, and measures of a text's form. Models are
fitted on at most SAMPLE labelled documents, an even draw by hash; every document is read whole
and scored.

Defined results: null and empty texts have the features of an empty text; a document without
label, with several labels (the largest counts) or with a null label is handled; a category that
has one value only gets that value's probability everywhere; rows repeated with their id are scored
alike; an empty table gives no rows, and without labels no document is rejected.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bytebpe import text_batches
from riskloom.llm.common import released, stash

#: Labelled documents that models are fitted on, at most (about; drawn evenly by hash).
SAMPLE = 20_000
FOLDS = 5
#: Word features of a category at most; documents that must have one; lengths of word beginnings.
FEATURES, LEAST, STEMS = 300, 8, (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
N_FORM = 7
RIDGE = 1.0


def form(text: str, words: list[str], distinct: int) -> list[float]:
    """Measures of form: length, word length, share of letters, marks, digits, capitals, distinct words."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    capitals, digits, blanks = int(seen[65:91].sum()), int(seen[48:58].sum()), int(seen[32] + seen[10])
    return [
        min(12.0, np.log1p(len(words))) / 12,
        min(20.0, letters / max(1, len(words))) / 20,
        letters / n,
        max(0, n - letters - digits - blanks) / n,
        digits / n,
        capitals / n,
        distinct / max(1, len(words)),
    ]


def features(words: set[str]) -> set[str]:
    """Words and, marked by a star, their beginnings."""
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def read(text: str | None) -> tuple[set[str], list[float]]:
    """The distinct words of a text in lower case, and its form."""
    text = text or ""
    words = WORD.findall(text.lower())
    distinct = set(words)
    return distinct, form(text, words, len(distinct))


class Lexicon:
    """The numbers of chosen features; words that share no beginning with one are passed over at once."""

    def __init__(self, chosen: dict[str, int]):
        self.words = {f: i for f, i in chosen.items() if not f.endswith("*")}
        self.stems = {f[:-1]: i for f, i in chosen.items() if f.endswith("*")}
        self.gate = {f[: STEMS[0]] for f in (*self.words, *self.stems)}

    def find(self, words: set[str]) -> set[int]:
        gate, short, out = self.gate, STEMS[0], set()
        for w in [w for w in words if w[:short] in gate]:
            if w in self.words:
                out.add(self.words[w])
            out.update(self.stems[w[:n]] for n in STEMS if len(w) > n and w[:n] in self.stems)
        return out


class Sample:
    """The labelled documents: which of the chosen features each has, its form, its labels and its fold."""

    def __init__(self, rows, chosen: dict[str, int], categories: list[str]):
        self.width = len(chosen)
        self.at, self.form, self.y, self.fold = [], [], [], []
        for has, shape, labels, fold in rows:
            self.at.append(np.array(has, np.int64))
            self.form.append(shape)
            self.y.append(labels)
            self.fold.append(fold)
        self.form = np.array(self.form, float).reshape(-1, N_FORM)
        self.y = np.array(self.y, float).reshape(-1, len(categories))
        self.fold = np.array(self.fold, np.int64)
        self.owner = np.repeat(np.arange(len(self.at)), [len(a) for a in self.at])
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.at])

    def score(self, w: np.ndarray, extra: np.ndarray) -> np.ndarray:
        dense = np.hstack([self.form, extra, np.ones((len(self.form), 1))])
        return np.bincount(self.owner, w[: self.width][self.flat], len(self.form)) + dense @ w[self.width :]


#: A cut that no probability reaches.
NEVER = 2.0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(sample: Sample, y: np.ndarray, use: np.ndarray, extra: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Weights of a ridge logistic model on the rows in `use`, by accelerated gradient steps."""
    width = sample.width
    dense = np.hstack([sample.form, extra, np.ones((len(sample.form), 1))])
    w = np.zeros(width + dense.shape[1])
    if not use.any() or y[use].min() == y[use].max():
        w[-1] = 20.0 if use.any() and y[use].max() > 0.5 else -20.0
        return w
    words = use[sample.owner]
    flat, owner = sample.flat[words], sample.owner[words]
    # each weight has its own step, after how much its feature curves the loss
    counts = np.bincount(flat, minlength=width).astype(float)
    row = np.sqrt(np.maximum(1.0, np.bincount(owner, minlength=len(y))))
    curve = np.concatenate([np.bincount(flat, row[owner], width), (dense[use] ** 2 * (row[use, None] + dense.shape[1])).sum(axis=0)]) / 4 + RIDGE
    momentum, ahead, t = w.copy(), w.copy(), 1.0
    for _ in range(rounds):
        p = sigmoid(sample.score(ahead, extra))
        gap = np.where(use, p - y, 0)
        slope = np.concatenate([np.bincount(flat, gap[owner], width), dense.T @ gap]) + RIDGE * np.append(ahead[:-1], 0)
        w = ahead - slope / curve
        if np.abs(w - momentum).max() < 1e-3:
            break
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = w + (t - 1) / t_next * (w - momentum)
        momentum, t = w.copy(), t_next
    w[:width][counts == 0] = 0
    return w


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 of the out-of-fold probabilities; the middle of the gap at which it lies.

    Only cuts that are right about half of what they reject at least count: where labels are so few
    that no feature tells anything, the best F1 would reject everything. Without any, nothing is rejected.
    """
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    f1 = 2 * hits / (taken + max(1.0, y.sum()))
    good = np.append(p[order][1:] < p[order][:-1], True) & (2 * hits >= taken)
    if not good.any():
        return NEVER
    k = int(np.argmax(np.where(good, f1, -1)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


class Chain:
    """Fitted models: one weight vector and one cut for each category, and the chosen features."""

    def __init__(self, categories: list[str], chosen: dict[str, int], weights: list[np.ndarray], cuts: list[float], held_out: dict[str, float]):
        self.categories, self.chosen, self.weights, self.cuts, self.held_out = categories, chosen, weights, cuts, held_out

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of all categories for each text."""
        lexicon, width = Lexicon(self.chosen), len(self.chosen)
        dense, sums = np.zeros((len(texts), N_FORM)), np.zeros((len(texts), len(self.categories)))
        words_weights = np.stack([w[:width] for w in self.weights], 1)
        for i, text in enumerate(texts):
            words, dense[i] = read(text)
            has = lexicon.find(words)
            if has:
                sums[i] = words_weights[list(has)].sum(axis=0)
        out = np.zeros(sums.shape)
        for c, w in enumerate(self.weights):
            rest = np.hstack([dense, logit(out[:, :c]), np.ones((len(texts), 1))])
            out[:, c] = sigmoid(sums[:, c] + rest @ w[width:])
        return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)) / 14


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit the chain. categories: name -> SQL expression over the labels that is 0, 1 or null, in chain order."""
    names = list(categories)
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.max(F.expr(e).cast("double")).alias(f"y{k}") for k, e in enumerate(categories.values())))
    marked = marked.filter(F.col("id").isNotNull()).na.drop()
    total = marked.count()
    share = int(1_000_000 * min(1.0, sample / max(1, total)))
    marked = marked.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < share)
    marked = marked.withColumn("y", F.array(*(f"y{k}" for k in range(len(names))))).select("id", "y")
    fold = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marked), "id")  # about SAMPLE rows of a few bytes
    rows = rows.select("text", "y", fold.alias("fold"))
    rows = stash(rows, "labelled")
    k = len(names)

    # Document frequencies of all features by fold and labels: partial sums in Python, then one shuffle.
    def count(batches):
        held: dict[tuple, Counter] = {}

        def out():
            for (fold, *y), found in held.items():
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([fold] * n, pa.int32()), pa.array([y] * n, pa.list_(pa.float64())), pa.array(list(found.values()), pa.int64())], ["feature", "fold", "y", "n"])
            held.clear()

        for batch in batches:
            for text, y, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = held.setdefault((fold, *y), Counter())
                own.update(features(read(text.as_py())[0]))
                own[""] += 1
            if sum(map(len, held.values())) > 400_000:
                yield from out()
        yield from out()
        released()

    partial = rows.mapInArrow(count, "feature string, fold int, y array<double>, n long")
    cells = [F.sum(F.when(F.col("fold") == f, F.col("n") * (F.col("y")[c - 1] if c else 1)).otherwise(0)).cast("double").alias(f"n{f * (k + 1) + c}") for f in range(FOLDS) for c in range(k + 1)]
    summed = partial.groupBy("feature").agg(*cells)
    summed = stash(summed.filter((F.col("feature") == "") | (sum(F.col(f"n{f * (k + 1)}") for f in range(FOLDS)) >= LEAST)), "frequencies")
    sizes_row = summed.filter("feature = ''").first()
    if sizes_row is None or not total:
        return Chain(names, {}, [np.append(np.zeros(N_FORM + c), -20.0) for c in range(k)], [0.5] * k, {})
    sizes = np.array(sizes_row[1:], float).reshape(FOLDS, k + 1)

    def choose(fold: int | None) -> set[str]:
        """Features whose share among documents of a category differs most from that among the others, in deviations."""
        used = [f for f in range(FOLDS) if f != fold]
        n = sum(F.col(f"n{f * (k + 1)}") for f in used)
        out = set()
        for c in range(1, k + 1):
            in_n, all_n = sizes[used, c].sum(), sizes[used, 0].sum()
            if not 0 < in_n < all_n:
                continue
            hit = sum(F.col(f"n{f * (k + 1) + c}") for f in used)
            share = n / F.lit(all_n)
            gap = F.abs(hit / in_n - (n - hit) / (all_n - in_n)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / in_n + 1 / (all_n - in_n)))
            best = summed.filter("feature <> ''").select("feature", gap.alias("gap")).filter("gap > 4").orderBy(F.desc("gap"), "feature").limit(FEATURES)
            out.update(r.feature for r in best.toLocalIterator())
        return out

    sets = [choose(f) for f in (*range(FOLDS), None)]
    chosen = {f: i for i, f in enumerate(sorted(set().union(*sets)))}  # at most (FOLDS + 1) * categories * FEATURES
    allowed = np.array([[f in s for f in chosen] for s in sets], bool).reshape(len(sets), len(chosen))
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def vectors(batches):
        lexicon = Lexicon(sent.value)
        for batch in batches:
            has, shape = [], []
            for text in batch.column(0):
                words, own = read(text.as_py())
                has.append(sorted(lexicon.find(words)))
                shape.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int64())), pa.array(shape, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["has", "shape", "y", "fold"])

    table = rows.mapInArrow(vectors, "has array<long>, shape array<double>, y array<double>, fold int")
    data = Sample(((r.has, r.shape, r.y, r.fold) for r in table.collect()), chosen, names)  # about SAMPLE rows
    return chain(data, names, chosen, allowed)


def restricted(data: Sample, allowed: np.ndarray) -> Sample:
    """The same documents with the allowed features alone."""
    out = object.__new__(Sample)
    out.__dict__.update(data.__dict__)
    keep = allowed[data.flat] if len(allowed) else np.zeros(len(data.flat), bool)
    out.flat, out.owner = data.flat[keep], data.owner[keep]
    return out


def chain(data: Sample, names: list[str], chosen: dict[str, int], allowed: np.ndarray) -> Chain:
    """Fit each category on the out-of-fold probabilities of those before it."""
    n, k = data.y.shape
    out_of_fold = np.zeros((n, k))
    weights, cuts, held_out = [], [], {}
    everything = restricted(data, allowed[-1])
    parts = [restricted(data, allowed[f]) for f in range(FOLDS)]
    for c in range(k):
        extra = logit(out_of_fold[:, :c])
        for f in range(FOLDS):
            w = fit(parts[f], data.y[:, c], data.fold != f, extra)
            mine = data.fold == f
            out_of_fold[mine, c] = sigmoid(parts[f].score(w, extra))[mine]
        weights.append(fit(everything, data.y[:, c], np.ones(n, bool), extra))
        cuts.append(threshold(out_of_fold[:, c], data.y[:, c]) if 0 < data.y[:, c].sum() < n else 0.5)
        held_out[names[c]] = float(((out_of_fold[:, c] >= cuts[c]) == (data.y[:, c] > 0.5)).mean())
    return Chain(names, chosen, weights, cuts, held_out)


def score(docs: DataFrame, model: Chain, category: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, p_<category> for each, then <category> and kept as booleans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most (FOLDS + 1) * categories * FEATURES features
    names, at = model.categories, model.categories.index(category)

    def run(batches):
        model = sent.value
        for batch in text_batches(batches):
            p = model.predict(batch.column(1).to_pylist())
            hit = p[:, at] >= model.cuts[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(len(names))), pa.array(hit), pa.array(~hit)], [id_col, *(f"p_{n}" for n in names), category, "kept"])

    schema = f"`{id_col}` long, " + ", ".join(f"`p_{n}` double" for n in names) + f", `{category}` boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows of docs that the chain does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, column = model.categories.index(category), docs.columns.index(text_col)

    def run(batches):
        model = sent.value
        for batch in text_batches(batches, column):
            p = model.predict(batch.column(column).to_pylist())
            yield batch.filter(pa.array(p[:, at] < model.cuts[at]))
        released()

    return docs.mapInArrow(run, docs.schema)


#: The judgements of the labels table as a chain: poor quality first, toxicity last.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
