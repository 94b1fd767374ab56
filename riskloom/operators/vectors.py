"""Exact nearest neighbours for a stated set of queries, in blocks of a scan over all vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the queries that are sent to all executors for one pass over the vectors.
QUERY_BYTES = 64 << 20


def cosine(a, b):
    """Column function: cosine of two arrays of doubles; 0 for other lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def _blocks(queries: DataFrame, id_col: str, vec_col: str):
    """Ids and unit vectors of the queries, QUERY_BYTES at a time and by length."""
    held: dict[int, list] = {}
    for i, v in queries.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).toLocalIterator():
        if v:
            held.setdefault(len(v), []).append((i, v))
            if len(held[len(v)]) * len(v) * 8 >= QUERY_BYTES:
                yield held.pop(len(v))
    yield from held.values()


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vec_col: str, keep_self: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k best per query, ties by id.

    Queries go in blocks, each with one pass over the vectors; a task keeps k rows a query before the shuffle.
    """
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    found = None
    for block in _blocks(queries, id_col, vec_col):
        q = np.array([v for _, v in block], float)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        part = _pass(rows, np.array([i for i, _ in block], np.int64), q, k, keep_self)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _pass(rows: DataFrame, names: np.ndarray, q: np.ndarray, k: int, keep_self: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((names, q))

    def run(batches):
        names, q = sent.value
        which, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bar = np.full(len(q), -np.inf)  # a score below it is not among the k best
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                pairs = [(i, v) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if v is not None and len(v) == q.shape[1]]
                if not pairs:
                    continue
                own = np.array([i for i, _ in pairs], np.int64)
                x = np.array([v for _, v in pairs], float)
                norm = np.linalg.norm(x, axis=1)
                s = np.where(norm > 0, (q @ x.T) / np.where(norm > 0, norm, 1), 0.0)
                live = np.round(s, 9) >= bar[:, None]
                if not keep_self:
                    live &= names[:, None] != own[None, :]
                a, b = np.nonzero(live)
                which, ids, scores = np.concatenate([which, a]), np.concatenate([ids, own[b]]), np.concatenate([scores, s[a, b]])
                order = np.lexsort((ids, -np.round(scores, 9), which))
                which, ids, scores = which[order], ids[order], scores[order]
                first = np.searchsorted(which, which)
                keep = np.arange(len(which)) - first < k
                which, ids, scores = which[keep], ids[keep], scores[keep]
                last = np.flatnonzero(np.arange(len(which)) - np.searchsorted(which, which) == k - 1)
                bar[which[last]] = np.round(scores[last], 9)
        yield pa.RecordBatch.from_arrays([pa.array(names[which]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

    return rows.mapInArrow(run, "query_id long, id long, score double")
