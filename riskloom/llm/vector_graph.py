"""Near-duplicate vectors by robust-pruned neighbour graphs on overlapping cluster shards.

Centroids are fitted on a bounded sample. Every distinct vector joins the shards of its nearest
centroids; a shard above BLOCK vectors is dealt into blocks. In each block every vector's
nearest neighbours are robust-pruned to a short adjacency list, and a vector's lists from all of
its shards are united. Searches start at the medoids of a block's small clusters, walk greedily with
a beam, and once they reach the range expand every vector in range until no new one turns up. Pairs that are found are
verified by their cosine in double precision. Within a shard each pair of blocks is searched once,
and a pair of vectors counts in the first shard that they share, so counts add up without a list
of all pairs; components get the links of a spanning forest of each task.

Links of a block are verified in pieces of bounded bytes, whatever number of near copies lies in it;
beside a piece a task holds numbers for each vector, and one bit for each pair within the block.

Recall, of queries and of links, is audited against brute force on a bounded set of queries, in blocks, after every attempt; below the target the operator starts again with more shards for each
vector, and after the last such attempt it compares all pairs of vectors, block by block.

Defined results: a vector that is null, of zero length, of zero norm, with null or non-finite
components, or with another number of components than most has no links and is its own component;
equal vectors are one point of the graph, and each links to its copies; rows repeated with their
id are vectors of their own for the counts; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free, released, spread, stash
from riskloom.llm.components import components

#: Vectors that centroids are fitted on, at most; vectors for each centroid; centroids at most.
SAMPLE, PER_CENTROID, CENTROIDS = 20_000, 1_500, 2_048
#: Vectors in a block; degree and slack of the pruned lists; candidates for pruning; beam width.
BLOCK, DEGREE, ALPHA, CANDIDATES, BEAM = 8_192, 24, 1.2, 64, 24
#: Medoids that searches start from; vectors that a round of a search expands; far links of each list.
ENTRIES, STEP, FAR = 64, 8, 6
#: Queries of a block at once (a multiple of 8), and bytes of vectors that are verified at once.
AT_ONCE, PIECE = 64, 8 << 20
#: Audited queries at most, and the recall that is asked for.
AUDITED, RECALL = 2_048, 0.99
#: From so many shards for each vector on, the next attempt is the exact one.
SHARDS = 8
SEED = 7


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of norm 1 in double precision from little-endian doubles."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def points(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles as bytes; null if the vector can't be compared), size."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if v.as_py() is None else np.array([np.nan if c is None else c for c in v.as_py()], "<f8")
                out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([len(o or b"") for o in out], pa.int32())], ["id", "vec", "size"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "id long, vec binary, size int")


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty clusters keep their centroid."""
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, candidates: int = CANDIDATES) -> np.ndarray:
    """Adjacency lists (rows of indexes, -1 where there is none) over one block.

    The nearest candidate is kept, and those that are nearer to it by the factor alpha than to
    the vector itself go; then the nearest of what is left, and so on. FAR links to vectors drawn
    evenly from the block keep clusters in reach of each other.
    """
    n = len(x)
    k = min(candidates, n - 1)
    out = np.full((n, degree + FAR), -1, np.int64)
    rng = np.random.default_rng(SEED)
    if k < 1:
        return out
    for i in range(0, n, AT_ONCE):
        rows = np.arange(i, min(n, i + AT_ONCE))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        far = rng.integers(0, n, (len(rows), FAR))
        to = 1 - np.take_along_axis(sims, near, 1)
        between = 1 - np.matmul(x[near], x[near].transpose(0, 2, 1))
        left = np.ones(near.shape, bool)
        for d in range(degree):
            any_left = left.any(axis=1)
            if not any_left.any():
                break
            pick = np.argmax(left, axis=1)
            at = np.arange(len(rows))
            out[rows, d] = np.where(any_left, near[at, pick], -1)
            left &= alpha * between[at, pick] > to
            left[at, pick] = False
        out[rows, degree:] = np.where(far == rows[:, None], -1, far)
    return out


def search(x: np.ndarray, lists: np.ndarray, starts: np.ndarray, queries: np.ndarray, own: np.ndarray, low: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) pairs with cosine >= low that the search finds, by AT_ONCE queries. own: a query's place in x, or -1.

    Starts from `starts`, the medoids of ENTRIES small clusters of the block, and from the query itself if it
    is in the graph; each round expands the STEP best of a query that lie in range or in its beam.
    """
    width = min(beam, len(x)) - 1
    for i in range(0, len(queries), AT_ONCE):
        q, me = queries[i : i + AT_ONCE], own[i : i + AT_ONCE]
        at = np.arange(len(q))
        sims = np.full((len(q), len(x)), -2.0)  # of what has been seen
        todo = np.full((len(q), len(x)), -2.0)  # the same, without what has been expanded
        has = me >= 0
        sims[:, starts] = q @ x[starts].T
        sims[at[has], me[has]] = np.einsum("ij,ij->i", q[has], x[me[has]])
        todo[:] = sims
        live = at
        while len(live):
            near = todo[live]
            step = min(STEP, len(x))
            pick = np.argpartition(-near, step - 1, axis=1)[:, :step]
            best = np.take_along_axis(near, pick, 1)
            edge = -np.partition(-sims[live], width, axis=1)[:, width]
            go = (best > -2) & ((best >= low) | (best >= edge[:, None]))
            rows, cols = np.nonzero(go)
            if not len(rows):
                break
            nodes = pick[rows, cols]
            todo[live[rows], nodes] = -2.0
            who = np.repeat(live[rows], lists.shape[1])
            next_ = lists[nodes].ravel()
            fresh = next_ >= 0
            who, next_ = who[fresh], next_[fresh]
            fresh = sims[who, next_] == -2.0
            code = np.unique(who[fresh] * len(x) + next_[fresh])
            who, next_ = code // len(x), code % len(x)
            s = np.einsum("ij,ij->i", q[who], x[next_])
            sims[who, next_] = s
            todo[who, next_] = s
            live = live[go.any(axis=1)]
        sims[at[has], me[has]] = -2
        a, b = np.nonzero(sims >= low)
        yield a + i, b


def compare(x: np.ndarray, queries: np.ndarray, own: np.ndarray, low: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, vector) pairs that may have cosine >= low, as search gives them."""
    for i in range(0, len(queries), AT_ONCE):
        a, b = np.nonzero(queries[i : i + AT_ONCE] @ x.T >= low - 1e-9)
        other = own[i : i + AT_ONCE][a] != b
        yield a[other] + i, b[other]


def once(found: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair a < b of n vectors once, whichever side found it. found: the pairs of AT_ONCE queries after the other."""
    bits = np.zeros((n, -(-n // 8)), np.uint8)
    for i, (a, b) in zip(range(0, n, AT_ONCE), found, strict=True):
        hit = np.zeros((min(AT_ONCE, n - i), n), bool)
        hit[a - i, b] = True
        bits[i : i + len(hit)] = np.packbits(hit, axis=1)
    for i in range(0, n, AT_ONCE):
        hit = np.unpackbits(bits[i : i + AT_ONCE], axis=1, count=n)
        hit |= np.unpackbits(bits[:, i // 8 : (i + AT_ONCE) // 8], axis=1)[:, : len(hit)].T
        a, b = np.nonzero(np.triu(hit, i + 1))
        yield a + i, b


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean of each of ENTRIES small clusters of the block."""
    k = max(1, min(ENTRIES, len(x) // 4))
    centroids = fit_centroids(x, k, 3)
    return np.unique(np.argmax(x @ centroids.T, axis=0))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


class Forest:
    """Which links of n vectors join two trees, when they are added piece by piece."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of the links that join two trees."""
        p, q = self.root[a], self.root[b]
        _, at = np.unique(np.minimum(p, q) * len(self.root) + np.maximum(p, q), return_index=True)
        at = at[p[at] != q[at]]
        up: dict[int, int] = {}

        def find(i):
            while i in up:
                i = up[i]
            return i

        keep = []
        for k, i, j in zip(at.tolist(), p[at].tolist(), q[at].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                up[max(i, j)] = min(i, j)
                keep.append(k)
        if keep:
            now = np.arange(len(self.root))
            for i in sorted(up):  # what a root is hung on is smaller
                now[i] = now[up[i]]
            self.root = now[self.root]
        return np.array(keep, np.int64)


def groups(batches, keys: int = 2):
    """(key, rows) of consecutive rows with the same first columns; the third says by 1 that rows may come in pieces of BLOCK."""
    held, key = [], None
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            for row in zip(*(c.to_pylist() for c in batch.slice(k, 1024).columns), strict=True):
                if row[:keys] != key or key[2:] == (1,) and len(held) >= BLOCK:
                    if held:
                        yield key, held
                    held, key = [], row[:keys]
                held.append(row[keys:])
    if held:
        yield key, held


class Index:
    """Points in shards and blocks, their united lists, and what searches find in them.

    exact: all points are in one shard, and the blocks are compared instead of searched.
    """

    def __init__(self, reps: DataFrame, count: int, low: float, shards: int, exact: bool = False):
        spark = reps.sparkSession
        share = min(1.0, SAMPLE / max(1, count))
        sample = reps.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else reps
        sample = unit([bytes(r.vec) for r in sample.orderBy("id").limit(SAMPLE).select("vec").toLocalIterator()])
        k = 1 if exact else max(1, min(CENTROIDS, len(sample) // 8, -(-count // PER_CENTROID)))
        sent = spark.sparkContext.broadcast(fit_centroids(sample, k))  # at most CENTROIDS vectors
        near = min(shards, k)

        def assign(batches):
            for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
                x = unit(batch.column(1).to_pylist()) @ sent.value.T
                best = np.argsort(-x, axis=1, kind="stable")[:, :near]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sort(best, axis=1).astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "vec", "weight", "shards"])

        self.points = stash(reps.select("id", "vec", "weight").mapInArrow(assign, "id long, vec binary, weight long, shards array<int>"), "points")
        sizes = {r.shard: r.n for r in self.points.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("n")).toLocalIterator()}
        blocks = F.array(*(F.lit(-(-sizes.get(s, 1) // BLOCK)) for s in range(k)))
        placed = self.points.withColumn("shard", F.explode("shards")).withColumn("blocks", F.get(blocks, F.col("shard")))
        self.placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        self.tasks = max(spread(spark), sum(-(-n // BLOCK) for n in sizes.values()))
        self.low, self.exact, self.widest = low, exact, near == k

    def lists(self) -> DataFrame:
        """id, near (ids): the united adjacency lists."""

        def run(batches):
            for _, rows in groups(batches):
                ids = np.array([r[0] for r in rows], np.int64)
                out = robust_prune(unit([r[1] for r in rows]))
                near = [ids[o[o >= 0]].tolist() for o in out]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near, pa.list_(pa.int64()))], ["id", "near"])
                released()

        rows = self.placed.select("shard", "block", "id", "vec").repartition(self.tasks, "shard", "block").sortWithinPartitions("shard", "block", "id")
        rows = rows.mapInArrow(run, "id long, near array<long>")
        return stash(rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")

    def found(self) -> DataFrame:
        """id, n_links (weighted, a part), other (null, or a link of the forest)."""
        low, exact = self.low, self.exact

        def run(batches):
            x = starts = names = weights = shards = lists = None
            at = None
            for (shard, block, role), rows in groups(batches, 3):
                if at != (shard, block):
                    at, x = (shard, block), None
                if role == 0:
                    names, weights = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
                    x, shards = unit([r[1] for r in rows]), np.array([r[3] for r in rows], np.int64)
                    lists, starts = (None, None) if exact else (local_lists(names, [r[4] for r in rows]), medoids(x))
                    rows, me = None, np.arange(len(x))
                    pairs = compare(x, x, me, low) if exact else search(x, lists, starts, x, me, low)
                    yield report(x, names, weights, shards, x, names, weights, shards, once(pairs, len(x)), shard, low, True)
                elif x is not None:
                    q, qn = unit([r[1] for r in rows]), np.array([r[0] for r in rows], np.int64)
                    qw, qs = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
                    rows, me = None, np.full(len(q), -1)
                    pairs = compare(x, q, me, low) if exact else search(x, lists, starts, q, me, low)
                    yield report(x, names, weights, shards, q, qn, qw, qs, pairs, shard, low, False)
                released()

        lists = None if exact else self.lists()
        placed = self.placed.withColumn("near", F.lit(None).cast("array<long>")) if exact else self.placed.join(lists, "id", "left")
        inside = placed.select("shard", "block", F.lit(0).alias("role"), "id", "vec", "weight", "shards", "near")
        across = placed.filter("block > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block") - 1)))
        across = across.select("shard", "block", F.lit(1).alias("role"), "id", "vec", "weight", "shards", F.lit(None).cast("array<long>").alias("near"))
        rows = inside.unionByName(across).repartition(self.tasks, "shard", "block").sortWithinPartitions("shard", "block", "role", "id")
        out = stash(rows.mapInArrow(run, "id long, n_links long, other long"), "found")
        free(self.points, *([] if exact else [lists]))
        return out


def local_lists(names: np.ndarray, near: list) -> np.ndarray:
    """Adjacency lists as places in names, which is sorted; what isn't in this block is left out."""
    rows = []
    for n in near:
        n = np.array(n or [], np.int64)
        at = np.minimum(np.searchsorted(names, n), len(names) - 1)
        rows.append(at[names[at] == n])
    out = np.full((len(names), max(1, max(map(len, rows), default=1))), -1, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def report(x, names, weights, shards, q, q_names, q_weights, q_shards, pairs, shard, low, same) -> pa.RecordBatch:
    """Verified links of one task: counts for both sides, and a spanning forest. pairs: places in q and in x, piece by piece."""
    trees = Forest(len(x) if same else len(q) + len(x))
    n_q, n_x = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
    step = max(1, PIECE // (8 * x.shape[1]))
    links = [], []
    for at_q, at_x in ((a[k : k + step], b[k : k + step]) for a, b in pairs for k in range(0, len(a), step)):
        ok = exact_cosine(q[at_q], x[at_x]) >= low
        at_q, at_x = at_q[ok], at_x[ok]
        joined = trees.add(at_q, at_x + (0 if same else len(q)))
        links[0].append(q_names[at_q[joined]])
        links[1].append(names[at_x[joined]])
        if shards.shape[1] > 1:
            theirs = q_shards[at_q]
            both = (theirs[:, :, None] == shards[at_x][:, None, :]).any(axis=2)
            mine = np.where(both, theirs, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == shard
            at_q, at_x = at_q[mine], at_x[mine]
        n_q += np.bincount(at_q, weights[at_x], len(q)).astype(np.int64)
        n_x += np.bincount(at_x, q_weights[at_q], len(x)).astype(np.int64)
    links = [np.concatenate([np.zeros(0, np.int64), *side]) for side in links]
    ids = np.concatenate([q_names[n_q > 0], names[n_x > 0], links[0]])
    counts = np.concatenate([n_q[n_q > 0], n_x[n_x > 0], np.zeros(len(links[0]), np.int64)])
    other = pa.concat_arrays([pa.nulls(len(ids) - len(links[0]), pa.int64()), pa.array(links[1])])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), other], ["id", "n_links", "other"])


def audit(reps: DataFrame, counts: DataFrame, low: float) -> float:
    """Share of true links that were found for at most AUDITED queries, an even draw by hash: the lower of the mean over queries and the share of all."""
    queries = reps.orderBy(F.xxhash64("id"), "id").limit(AUDITED).select("id", "vec").toLocalIterator()
    queries = [(r.id, bytes(r.vec)) for r in queries]
    if not queries:
        return 1.0
    names, q = np.array([i for i, _ in queries]), unit([v for _, v in queries])
    sent = reps.sparkSession.sparkContext.broadcast((names, q))  # at most AUDITED vectors

    def run(batches):
        names, q = sent.value
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, w = part.column(0).to_numpy(), part.column(2).to_numpy()
                a, b = np.nonzero(q @ unit(part.column(1).to_pylist()).T >= low)
                a, b = (side[names[a] != ids[b]] for side in (a, b))
                total += np.bincount(a, w[b], len(q)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["id", "n"])

    true = reps.select("id", "vec", "weight").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    hit = F.least("n", F.coalesce("n_links", F.lit(0)))
    row = true.filter("n > 0").join(counts, "id", "left").agg(F.avg(hit / F.col("n")), F.sum(hit) / F.sum("n")).first()
    return 1.0 if row[0] is None else min(row)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", low: float = 0.9, shards: int = 3) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept."""
    rows = stash(points(vectors, id_col, vec_col), "vectors")
    sizes = rows.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = sizes["size"] if sizes else -1
    usable = rows.filter(F.col("size") == size)
    reps = stash(usable.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")).filter(F.col("id").isNotNull()), "points")
    count = reps.count()
    if not count:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    exact = False
    while True:
        index = Index(reps, count, low, shards, exact)
        found = index.found()
        counts = stash(found.filter("other IS NULL").groupBy("id").agg(F.sum("n_links").alias("n_links")), "counts")
        if exact or (recall := audit(reps, counts, low)) >= RECALL:
            break
        exact = shards >= SHARDS or index.widest
        logging.getLogger(__name__).warning("recall %.4f with %d shards for each vector; next: %s", recall, shards, "all pairs" if exact else f"{2 * shards} shards")
        shards *= 2
    joined = components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = reps.join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("vec", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.withColumn("vec", F.when(F.col("size") == size, F.col("vec"))).join(known, "vec", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
