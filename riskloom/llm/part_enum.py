"""Exact Jaccard self-join of n-gram sets by PartEnum signatures.

Set sizes fall into bands such that sizes of similar sets lie in the same band or in neighbouring
ones. Each pair of neighbouring bands is one instance. It deals the domain of shingles into groups
of PARTS partitions, and within a group enumerates the subsets of KEEP partitions: the hash of a
set's members in the partitions of one subset is a signature. Two sets that differ in at most
SPARED = PARTS - KEEP partitions of a group agree on one of its subsets, and share that signature if
it isn't empty (signatures of empty subsets would be shared by everything, so they aren't made).

How many groups a set takes, in an order that is the same for all, depends on the set: to keep a
group from giving a shared signature takes at least as many differences as there are partitions
with members, or SPARED + 1 if that is less. A set takes groups until their costs sum to more than
the most differences it may have from any similar set of the instance. Of two similar sets, the
one that takes fewer groups has one among them in which both give the same signature. (No scheme of
this kind gives fewer signatures than differences are allowed, plus one: with disjoint subsets one
for each, and overlapping ones take more, which buys signatures of more members.) Sets that run
out of groups (small ones, and those made of very frequent shingles) also use the members that a
prefix filter takes, which similar sets share always.

The most frequent shingles, found by Misra-Gries counts over all texts, are left out of the
partitions: taking the same members away from both sets never makes them differ more. So a
passage that a third of all texts share makes no signature. Any such choice keeps the join exact.

Sets stand for their texts by a 64-bit fingerprint, so copies are never expanded. Up to SMALL sets
that share a signature give all their pairs; of more, the smallest is paired with each other one.
Pairs that sizes or sketches (parities of a set's members by cell, two to four bits for each) rule
out go; the others are verified on their members, first each set with its smallest partner, then
pairs that this has not joined. Where more than SMALL sets share a signature, those of different
components are then held against each other, in blocks dealt over tasks. So no link that joins two
components is lost, and no pairs are made within a group that is joined.

Defined results: a text without words (null, empty, blank) has the empty set, component_id is
its own id; equal sets are linked; a null id never names a component unless no other id can; rows
repeated with their id are one document each; an empty table gives no rows. Texts of any length
are read whole. Of the table only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bytebpe import text_batches
from riskloom.llm.common import broadcast_if_small, free, released, stash, unused
from riskloom.llm.components import components
from riskloom.llm.shingles import U, _PLACES, fingerprints, mix, shingle_sets

#: Partitions of a group, and of a subset of them that makes a signature.
PARTS, KEEP = 3, 2
SPARED = PARTS - KEEP
#: Members that a group has in the largest set of its instance.
MEMBERS = 6
#: Misra-Gries counters of a task, and how many of the most frequent shingles on at least FREQUENT texts are left out.
COUNTERS, LEFT_OUT, FREQUENT = 1 << 16, 1 << 17, 64
#: Signatures that a task gathers before it hands them on, and that one bucket gets; sets that a task remembers.
GATHERED, PER_BUCKET, SEEN = 1_000_000, 1_000_000, 1 << 20
#: Buckets at least, so that a cluster's executors all have some, and at most.
BUCKETS = 64, 1 << 16
#: Pairs that a task lists before it drops repeated ones.
PAIRS = 2_000_000
#: Bits of the filter that picks candidate texts, at most.
FILTER_BITS = 1 << 28
#: Sets with a signature in common up to which all pairs are looked at, at once.
SMALL = 32
#: Bits of a sketch, at least and at most; bits of those that blocks of a list are compared by.
LEAST_BITS, MOST_BITS, BLOCK_BITS = 64, 1 << 20, 1 << 12
#: Bytes of text that are read at a time.
BATCH = 2_000_000
#: Sets held against one set in one task; sets of a block; members of a list in one row.
CHUNK, BLOCK, LISTED = 256, 4096, 1 << 16


@dataclass(frozen=True)
class Bands:
    """Sizes by band (`tops`), and by instance how many groups of partitions it has."""

    threshold: Fraction
    tops: np.ndarray
    groups: np.ndarray

    @staticmethod
    def of(threshold: Fraction, largest: int) -> Bands:
        tops = [1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, int(tops[-1] / threshold)))
        tops.append(max(tops[-1] + 1, int(tops[-1] / threshold)))
        most = [int(2 * t * (1 - threshold) / (1 + threshold)) for t in tops]
        return Bands(threshold, np.array(tops), np.array([0 if k == 0 else max(-(-t // MEMBERS), k // (SPARED + 1) + 1) for t, k in zip(tops, most, strict=True)]))

    def differences(self, sizes: np.ndarray, step: int) -> np.ndarray:
        """Most members in which a set differs from a similar one, of its own band or smaller (step 0) or the next (1); -1 if there is none."""
        p, q = self.threshold.numerator, self.threshold.denominator
        largest, top = sizes * q // p, self.tops[np.searchsorted(self.tops, sizes)]
        if step:
            return np.where(largest > top, (q - p) * (sizes + largest) // (q + p), -1)
        return (q - p) * (sizes + np.minimum(largest, top)) // (q + p)


def signatures(sets: np.ndarray, bounds: np.ndarray, bands: Bands, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and the number of the set that each belongs to."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.ones(len(sets), bool)
    if len(left_out):
        at = np.searchsorted(left_out, sets)
        at[at == len(left_out)] = 0
        rare = left_out[at] != sets
    band = np.searchsorted(bands.tops, sizes)
    found, owners = [], []
    sparse = np.zeros(len(sizes), bool)
    members, of = sets[rare], owner[rare]
    spread = mix(members + _PLACES[50])
    content = mix(members + _PLACES[51])
    for step in (0, 1):
        instance = band + step
        most = bands.differences(sizes, step)
        n = np.where((sizes > 0) & (most > 0), bands.groups[instance], 0)
        base = np.concatenate([[0], np.cumsum(n)])
        live = (n > 0)[of]
        own = of[live]
        # the instance enters the place so that neighbouring instances deal differently
        draw = mix(spread[live] + instance[own].astype(U)) >> U(32)
        place = base[own] * PARTS + ((draw * (n[own] * PARTS).astype(U)) >> U(32)).astype(np.int64)
        sums = np.zeros(base[-1] * PARTS, U)
        np.add.at(sums, place, content[live])
        full = np.zeros(base[-1] * PARTS, bool)
        full[place] = True
        sums, full = sums.reshape(-1, PARTS), full.reshape(-1, PARTS)
        which = np.repeat(np.arange(len(sizes)), n)
        cost = np.concatenate([[0], np.cumsum(np.minimum(full.sum(axis=1), SPARED + 1))])
        sparse |= (n > 0) & (cost[base[1:]] - cost[base[:-1]] <= most)
        taken = np.flatnonzero(cost[:-1] - cost[base[which]] <= most[which])
        own = which[taken]
        name = instance[own].astype(U) * _PLACES[52] + (taken - base[own]).astype(U) * _PLACES[53]
        for number, subset in enumerate(itertools.combinations(range(PARTS), KEEP)):
            value, some = name + _PLACES[40 + number], np.zeros(len(taken), bool)
            for part in subset:
                value = value + mix(sums[taken, part] + _PLACES[44 + part])
                some |= full[taken, part]
            found.append(mix(value[some]))
            owners.append(own[some])
    if sparse.any():
        take = sizes - np.ceil(sizes * float(bands.threshold) - 1e-9).astype(np.int64) + 1
        for i in np.flatnonzero(sparse):
            a, b = bounds[i], bounds[i + 1]
            own = np.concatenate([sets[a:b][rare[a:b]], sets[a:b][~rare[a:b]]])[: take[i]]  # rare members first
            found.append(mix(own + _PLACES[54]))
            owners.append(np.full(len(own), i))
    return np.concatenate(found), np.concatenate(owners)


class _Frequent:
    """Misra-Gries counts of shingles, a batch at a time."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, members: np.ndarray) -> None:
        found, n = np.unique(members, return_counts=True)
        keys = np.concatenate([self.keys, found])
        counts = np.concatenate([self.counts, n])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > COUNTERS:
            least = np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
            keep = counts > least
            keys, counts = keys[keep], counts[keep] - least
        self.keys, self.counts = keys, counts


SURVEY = ["kind", "id", "n", "value", "sketch"]


def widths(sizes: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of these sizes: a power of two."""
    return np.clip(1 << np.ceil(np.log2(2 * np.maximum(sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def sketches(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each set's size (8 bytes), then whether the number of its members in each cell of the domain is odd, a bit each."""
    sizes = np.diff(bounds)
    bits = widths(sizes)
    base = np.concatenate([[0], np.cumsum(bits)])
    cell = (mix(sets + _PLACES[56]) & (np.repeat(bits, sizes) - 1).astype(U)).astype(np.int64)
    at, n = np.unique(np.repeat(base[:-1], sizes) + cell, return_counts=True)
    at = at[n % 2 == 1]
    table = np.zeros(base[-1] // 8, np.uint8)
    np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return pa.array([sizes[i].tobytes() + table[base[i] // 8 : base[i + 1] // 8].tobytes() for i in range(len(sizes))], pa.binary())


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes, without sizes) brought to a lesser number of bytes."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def unpacked(sketches_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and rows of bytes of sketches that have one length."""
    x = np.frombuffer(b"".join(sketches_), np.uint8).reshape(len(sketches_), -1)
    return x[:, :8].copy().view(np.int64)[:, 0], x[:, 8:]


def may_be_similar(m: np.ndarray, x: np.ndarray, n: np.ndarray, y: np.ndarray, threshold: Fraction) -> np.ndarray:
    """By sizes (m, n) and sketches (rows of x and y, of one width), which pairs of sets can reach the threshold.

    A member that only one of two sets has changes one parity, so sets differ in at least as many members as their
    sketches do in bits. Rows of x and y broadcast against each other.
    """
    p, q = threshold.numerator, threshold.denominator
    words = 8 if x.shape[-1] % 8 == 0 else 1
    x, y = (np.ascontiguousarray(v).view(np.uint64 if words == 8 else np.uint8) for v in (x, y))
    unlike = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (unlike * (q + p) <= (q - p) * (m + n)) & (np.minimum(m, n) * q >= np.maximum(m, n) * p)


def survey(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """kind 0: id, n (size of its set), value (its fingerprint), sketch; kind 1: value (a shingle), n (its count in a task)."""

    def run(batches):
        frequent, seen = _Frequent(), 0
        for batch in text_batches(batches, limit=BATCH):
            sets, bounds = shingle_sets(batch.column(1).fill_null(""), size)
            frequent.add(sets)
            seen += batch.num_rows
            prints = fingerprints(sets, bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), pa.array(np.diff(bounds)), pa.array(prints), sketches(sets, bounds)], SURVEY)
        released()
        often = frequent.counts >= max(2, seen // 1000)
        keys = frequent.keys[often].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.nulls(len(keys), pa.int64()), pa.array(frequent.counts[often]), pa.array(keys), pa.nulls(len(keys), pa.binary())], SURVEY)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "kind int, id long, n long, value long, sketch binary")


class _Gatherer:
    """Gathers signatures with their sets' ids; hands on one row per bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self):
        self.parts, self.count, self.sets = [], 0, 0

    def add(self, found: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((found, (owner + self.sets).astype(np.uint32), ids))
        self.count += len(found)
        self.sets += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            found, owner, ids = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
            self.parts = []
            order = np.argsort(found)
            found, owner = found[order], owner[order]
            cuts = np.searchsorted(found >> U(32), (np.arange(self.buckets + 1, dtype=np.uint64) * U(1 << 32) + U(self.buckets - 1)) // U(self.buckets))
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                sets, at = np.unique(owner[part], return_inverse=True)
                # in a bucket the low half of a signature names it; two that agree there only give a pair that is not similar
                row = [found[part].astype("<u4").tobytes(), at.astype("<u4" if len(sets) > 65535 else "<u2").tobytes(), ids[sets].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], ["bucket", "found", "owner", "ids"])
        self.clear()


GATHERED_SCHEMA = "bucket int, found binary, owner binary, ids binary"


def gather(docs: DataFrame, id_col: str, text_col: str, size: int, bands: Bands, left_out: np.ndarray, buckets: int) -> DataFrame:
    """Signatures of the sets of a task, by bucket. Of its last SEEN sets, a task gives each once."""

    def run(batches):
        gathered, seen = _Gatherer(buckets), set()
        for batch in text_batches(batches, limit=BATCH):
            sets, bounds = shingle_sets(batch.column(1).fill_null(""), size)
            prints = fingerprints(sets, bounds).view(np.int64)
            fresh = np.zeros(len(prints), bool)
            for i, x in enumerate(prints.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            if len(seen) > SEEN:
                seen.clear()
            kept = np.repeat(fresh, np.diff(bounds))
            sets, bounds = sets[kept], np.concatenate([[0], np.cumsum(np.diff(bounds)[fresh])])
            gathered.add(*signatures(sets, bounds, bands, left_out), prints[fresh])
            if gathered.count >= GATHERED:
                yield from gathered.flush()
        yield from gathered.flush()
        released()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, GATHERED_SCHEMA)


SHARED = ["a", "b", "members"]


def _met(parts: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of `shared` for one bucket."""
    found, ids = [], []
    for raw, owner, own in parts:
        own = np.frombuffer(own, np.int64)
        found.append(np.frombuffer(raw, "<u4"))
        ids.append(own[np.frombuffer(owner, "<u4" if len(own) > 65535 else "<u2")])
    key, node = np.concatenate(found), np.concatenate(ids)
    del found, ids
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    live = np.append(same, False) | np.append(False, same)
    key, node = key[live], node[live]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]  # copies of one set in several tasks
    key, node = key[fresh], node[fresh]
    if not len(key):
        return
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    place = np.arange(len(key)) - np.repeat(first, size)
    many = np.repeat(size > SMALL, size)
    pairs = np.zeros((0, 2), np.int64)
    stars = many & (place > 0)
    held = [np.stack([node[np.repeat(first, size)[stars]], node[stars]], 1)]
    for step in range(1, min(SMALL, int(size.max()))):
        at = np.flatnonzero((place >= step) & ~many)
        held.append(np.stack([node[at - step], node[at]], 1))
        if sum(map(len, held)) > PAIRS:
            pairs, held = np.unique(np.concatenate([pairs, *held]), axis=0), []
    pairs = np.unique(np.concatenate([pairs, *held]), axis=0)
    for k in range(0, len(pairs), 100_000):
        part = [np.ascontiguousarray(pairs[k : k + 100_000, c]) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.nulls(len(part[0]), pa.binary())], SHARED)
    told = set()
    for i, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        name = int(fingerprints(node[i : i + n].view(U), np.array([0, n])).view(np.int64)[0])
        if name not in told:
            told.add(name)
            for k in range(0, n, LISTED):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([name]), pa.array([node[i + k : i + min(n, k + LISTED)].tobytes()], pa.binary())], SHARED)


def shared(rows: DataFrame, buckets: int) -> DataFrame:
    """Pairs a < b of sets that share a signature, and the sets of signatures that more than SMALL have.

    Up to SMALL sets give all their pairs. More give those of the smallest id with each other one,
    and their list, LISTED members a row (a: the row's first place, b: the list's name, members).
    A task holds the signatures of one bucket at a time.
    """

    def run(batches):
        held, name = [], None
        for batch in batches:
            for bucket, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != name and held:
                    yield from _met(held)
                    held = []
                name = bucket
                held.append(part)
        if held:
            yield from _met(held)
        del held
        released()

    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, members binary")


def screened(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs that sizes and sketches don't rule out. nodes: node, sketch."""
    dealt = beside(pairs, nodes.withColumnRenamed("sketch", "members"))
    rows = dealt[-1]

    def run(batches):
        middle, name = None, None
        for batch in (b for b in batches if b.num_rows):
            ids, partner, sketch = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_pylist()
            heads = np.flatnonzero(partner.is_null().to_numpy(zero_copy_only=False)).tolist()
            partner = partner.fill_null(0).to_numpy()
            left, right = [], []
            for i, j in zip([-1, *heads], [*heads, len(ids)], strict=True):
                if i >= 0:
                    middle, name = unpacked([sketch[i]]), ids[i]
                i += 1
                if i == j or middle is None or ids[i] != name:
                    continue
                lengths = np.array([len(x) for x in sketch[i:j]])
                for n in np.unique(lengths).tolist():
                    at = i + np.flatnonzero(lengths == n)
                    m, x = unpacked([sketch[k] for k in at.tolist()])
                    width = min(n - 8, middle[1].shape[1])
                    ok = at[may_be_similar(middle[0], folded(middle[1], width), m, folded(x, width), threshold)]
                    left.append(ids[ok])
                    right.append(partner[ok])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    found = stash(rows.mapInArrow(run, "a long, b long").distinct(), "screened")
    free(*dealt[:-1])
    return found


def unfolded(batches):
    for batch in batches:
        for name, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(members.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), pa.array(own)], ["list", "node"])


def across(lists: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of different components among the sets of each list, without those that sizes and sketches rule out.

    Sets of a list's largest component are not held against each other. The others are cut into
    blocks of BLOCK, and each block meets each block of the list in a task of its own. Lists overlap
    (sets that are alike share many signatures); a pair counts in the first list that has both.
    """
    known = stash(lists.mapInArrow(unfolded, "list long, node long").join(labels, "node"), "known")
    counts = known.groupBy("list", "label").count().groupBy("list").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("total"))
    counts = counts.withColumn("other", F.col("total") - F.col("top.count")).filter("other > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mixed = counts.select("list", F.col("top.label").alias("large"), blocks("other").alias("lefts"), blocks("total").alias("rights"))
    rows = known.join(mixed, "list")
    lists_of = rows.groupBy("node").agg(F.array_sort(F.collect_list("list")).alias("lists"))  # as many as a set has signatures
    rows = rows.withColumn("deal", F.xxhash64("node"))
    place = lambda n: F.pmod("deal", F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["list", "i", "j", "side", "label", "node"]
    left = rows.filter("label <> large").withColumns({"side": F.lit(0), "i": place("lefts")}).withColumn("j", each("rights"))
    right = rows.withColumns({"side": F.lit(1), "j": place("rights")}).withColumn("i", each("lefts"))
    small = nodes.mapInArrow(_small_sketches, "node long, sketch binary")
    both = left.select(columns).unionByName(right.select(columns)).join(small, "node").join(lists_of, "node")
    both = both.select(*columns, "sketch", F.filter("lists", lambda x: x < F.col("list")).alias("before"))
    both = both.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "side", "label", "node")

    def run(batches):
        """The left sets of a pair of blocks are held, by sketch length; the right ones stream past them."""
        held, name = {}, None
        for batch in (b.slice(k, 2048) for b in batches for k in range(0, b.num_rows, 2048)):
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], 1)
            label, node, sketch = batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6).to_pylist()
            before = [frozenset(x) for x in batch.column(7).to_pylist()]
            lengths = np.array([len(x) for x in sketch])
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if tuple(keys[i, :3]) != name:
                    held, name = {}, tuple(keys[i, :3])
                for n in np.unique(lengths[i:j]).tolist():
                    at = i + np.flatnonzero(lengths[i:j] == n)
                    part = label[at], node[at], *unpacked([sketch[k] for k in at.tolist()]), [before[k] for k in at.tolist()]
                    if keys[i, 3] == 0:
                        held.setdefault(n, []).append(part)
                        continue
                    for m in (n, (n - 8) // 2 + 8, (n - 8) * 2 + 8):
                        for own in held.get(m, []):
                            yield from _pairs(own, part, (min(m, n) - 8), threshold)
        del held
        released()

    found = stash(both.mapInArrow(run, "a long, b long").distinct(), "across")
    free(known)
    return found


def _small_sketches(batches):
    for batch in batches:
        short = []
        for x in batch.column(1).to_pylist():
            size, bits = unpacked([x])
            short.append(size.tobytes() + folded(bits, min(bits.shape[1], BLOCK_BITS // 8)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], ["node", "sketch"])


def _pairs(left: tuple, right: tuple, width: int, threshold: Fraction) -> Iterator[pa.RecordBatch]:
    (la, na, ma, xa, fa), (lb, nb, mb, xb, fb) = left, right
    xa, xb = folded(xa, width), folded(xb, width)
    rows = max(1, (8 << 20) // (len(xa) * width))
    for k in range(0, len(xb), rows):
        part = slice(k, k + rows)
        ok = may_be_similar(ma[None, :], xa[None, :, :], mb[part, None], xb[part, None, :], threshold)
        i, j = np.nonzero(ok & (la[None, :] != lb[part, None]))
        own = [fb[k + x].isdisjoint(fa[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        i, j = i[own], j[own]
        if len(i):
            a, b = na[j], nb[part][i]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def beside(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table to free, and a, chunk, b, members: for each a and each CHUNK or so of its partners its own members (b null), then theirs."""
    per = pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / CHUNK) + 1).cast("int").alias("chunks"))
    dealt = pairs.join(per, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    dealt = stash(dealt.select("a", "chunk", "b"), "dealt")
    others = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "members")
    middles = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    rows = middles.select("a", "chunk", F.lit(None).cast("long").alias("b"), "members").unionByName(others)
    return dealt, rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())


def filter_bits(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places for each value in a filter of so many bits."""
    x = mix(values.view(U) + _PLACES[55])
    return (x >> U(32)) % U(bits), (x & U(0xFFFFFFFF)) % U(bits)


def build_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the ids, of bounded size; beyond it more texts pass, and none is lost."""

    def run(batches):
        table = np.zeros(bits // 8 + 1, np.uint8)
        for batch in batches:
            for at in filter_bits(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(table, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["table"])

    total = np.zeros(bits // 8 + 1, np.uint8)
    for row in ids.coalesce(4).mapInArrow(run, "table binary").toLocalIterator():
        total |= np.frombuffer(row.table, np.uint8)
    return total


def pick_sets(docs: DataFrame, id_col: str, text_col: str, size: int, table: np.ndarray, bits: int) -> DataFrame:
    """node, members of the texts whose ids pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bitmap, seen = sent.value, set()
        for batch in text_batches(batches, limit=BATCH):
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = np.ones(len(ids), bool)
            for at in filter_bits(ids, bits):
                hit &= (bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
            if not hit.any():
                continue
            sets, bounds = shingle_sets(batch.column(1).fill_null("").filter(pa.array(hit)), size)
            prints = fingerprints(sets, bounds).view(np.int64)
            fresh = [i for i, x in enumerate(prints.tolist()) if not (x in seen or seen.add(x))]
            if len(seen) > SEEN:
                seen.clear()
            members = [sets[bounds[i] : bounds[i + 1]].tobytes() for i in fresh]
            yield pa.RecordBatch.from_arrays([pa.array(prints[fresh]), pa.array(members, pa.binary())], ["node", "members"])
        released()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "node long, members binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs whose sets are similar. A set is sent once for each CHUNK sets that it is held against."""
    dealt, rows = beside(pairs, sets)

    def run(batches):
        middle, name = np.zeros(0, U), None
        for batch in batches:
            left, right = [], []
            for a, b, members in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(members.as_buffer(), U)
                if b is None:
                    middle, name = own.copy(), a
                elif a == name and len(middle) and len(own):
                    at = np.searchsorted(middle, own)
                    at[at == len(middle)] = 0
                    both = int(np.count_nonzero(middle[at] == own))
                    if threshold.denominator * both >= threshold.numerator * (len(own) + len(middle) - both):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        released()

    links = stash(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    free(dealt)
    return links


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with their component as label, as a stashed table."""
    found = components(links)
    named = nodes.join(found.select("node", F.col("component").alias("label")), "node", "left")
    named = stash(named.withColumn("label", F.coalesce("label", "node")), "labels")
    free(found)
    return named


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id."""
    found = stash(survey(docs, id_col, text_col, size), "survey")
    rows = found.filter("kind = 0").select("id", F.col("n").alias("n_shingles"), F.col("value").alias("node"), "sketch")
    total, largest = rows.agg(F.sum("n_shingles"), F.max("n_shingles")).first()
    often = found.filter("kind = 1").groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "value").limit(LEFT_OUT).select("value").toPandas()["value"]
    left_out = np.sort(often.to_numpy(np.int64).view(U))
    bands = Bands.of(threshold, largest or 1)
    buckets = max(BUCKETS[0], min(BUCKETS[1], -(-(total or 0) // PER_BUCKET)))
    met = stash(shared(gather(docs, id_col, text_col, size, bands, left_out, buckets), buckets), "met")
    stars = stash(met.filter("members IS NULL").select("a", "b").distinct(), "stars")
    lists = stash(met.filter("members IS NOT NULL").dropDuplicates(["a", "b"]).select("b", "members"), "lists")
    free(met)
    classes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("first_id"), F.min("sketch").alias("sketch"))
    nodes = stash(classes.join(ends(stars), "node", "left_semi"), "nodes")  # a list's sets all stand in pairs
    plain = nodes.select("node", "sketch")

    def similar(pairs: DataFrame, stars_first: bool) -> DataFrame:
        """The pairs whose sets are similar, as far as they join components; reads the texts of their sets alone.

        With stars_first each set is held against its smallest partner before the others, which spares most pairs
        where sets come in groups.
        """
        firsts = stash(nodes.join(ends(pairs), "node", "left_semi").select(F.coalesce("first_id", F.lit(-1)).cast("long").alias("id")), "firsts")
        count = firsts.count()
        bits = min(FILTER_BITS, max(1024, 16 * count))
        sets = stash(pick_sets(docs, id_col, text_col, size, build_filter(firsts, bits), bits), "sets")
        if sets.count() > sets.select("node").distinct().count():  # ids that repeat
            again = stash(sets.dropDuplicates(["node"]), "sets")
            free(sets)
            sets = again
        if not stars_first:
            links = verified(pairs, sets, threshold)
            free(firsts, sets)
            return links
        # each set against its smallest partner, then what these links haven't joined
        smallest = stash(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "smallest")
        links = verified(smallest, sets, threshold)
        labels = labelled(ends(pairs), links)
        again = pairs.join(smallest, ["a", "b"], "left_anti").join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        again = again.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").filter("x <> y").select("a", "b")
        links = links.unionByName(verified(again, sets, threshold))
        free(firsts, sets, smallest, labels)
        return links

    close = screened(stars, plain, threshold)
    links = similar(close, True)
    if not lists.isEmpty():
        labels = labelled(plain.select("node"), links)
        rest = across(lists, labels, plain, threshold)
        fresh = stash(rest.join(stars, ["a", "b"], "left_anti"), "rest")
        links = links.unionByName(similar(screened(fresh, plain, threshold), False))
        free(labels, rest, fresh)
    free(stars, lists, close, nodes)
    groups = components(links)
    named = rows.filter("n_shingles > 0").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component").select("id", "n_shingles", F.col("least").alias("component_id"))
    alone = rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return named.unionByName(alone).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of similar texts the one with the smallest id.

    Null ids come last, and of rows with one id the first read stays. Texts without words all stay.
    Rows are written with a number first, which names them whatever ids repeat or are null.
    """
    row = unused(docs, "row")
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = stash(similar_groups(numbered, row, text_col, size, threshold).select(F.col(row).alias("row"), "component_id"), "groups")
    crowded = groups.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    ids = numbered.select(F.col(row).alias("row"), F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")).alias("rank"))
    members = stash(groups.join(crowded, "component_id").join(ids, "row"), "members")
    best = members.groupBy("component_id").agg(F.min("rank").alias("best"))
    gone = stash(members.join(best, "component_id").filter(F.col("row") != F.col("best.row")).select(F.col("row").alias(row)), "gone")
    free(groups, members)
    return numbered.join(broadcast_if_small(gone, gone.count(), 16), row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
