"""Sequence packing by non-negative least squares over shallow length combinations.

Each task encodes its documents once and packs them in groups of bounded size; nothing is
shuffled. Whole windows are cut off long documents. The rests are counted in a histogram of
length classes; all combinations of at most DEPTH classes that fill a window are the columns of
a non-negative least squares problem whose solution, rounded down, says how often each is
used. What is left over, and the small gaps that class widths leave, are packed greedily, longest
first, cut where a window is full. A group's last window is cut into powers of two, which need
no padding.

Defined results: a null text is empty and holds only the end id; a text of any length is cut
into pieces; equal rows are packed each on their own, null ids too; an empty table gives no rows. Only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Length classes in a window, and the most pieces in an enumerated combination.
CLASSES, DEPTH = 64, 3
#: A group is packed when it holds so many ids: bounds a task's memory.
GROUP_IDS = 2_000_000
#: Bytes of text that are encoded at a time.
BATCH = 3_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


@lru_cache
def combinations(classes: int, depth: int) -> np.ndarray:
    """A column for each multiset of at most depth classes that sums to `classes`: how often it holds each class."""
    found = []
    for k in range(1, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, classes + 1), k - 1):
            last = classes - sum(head)
            if last >= (head[-1] if head else 1):
                found.append((*head, last))
    out = np.zeros((classes, len(found)))
    for j, parts in enumerate(found):
        for p in parts:
            out[p - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set that grows by the steepest column."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, np.abs(b).max(initial=0)):
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            fit = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if fit.min(initial=1) > 1e-12:
                x[:] = 0
                x[cols] = fit
                break
            low = fit <= 1e-12
            gap = x[cols][low] - fit[low]
            step = np.min(np.divide(x[cols][low], gap, out=np.zeros(low.sum()), where=gap > 0))
            x[cols] = np.maximum(0, x[cols] + step * (fit - x[cols]))
            gone = cols[(x[cols] <= 1e-12) & low]
            active[gone if len(gone) else cols[low]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, start, length) that hold every id of the pieces, each shorter than window.

    All windows are full except the last ones, whose lengths are powers of two.
    """
    width = window // CLASSES
    of = (lengths + width - 1) // width  # a class holds lengths up to its number times the width
    order = np.argsort(-lengths, kind="stable")
    queues = [[] for _ in range(CLASSES + 1)]
    for i in order[::-1]:
        queues[of[i]].append(int(i))
    combos = combinations(CLASSES, DEPTH)
    weights = nnls(combos, np.array([len(q) for q in queues[1:]], float))
    windows: list[list[tuple[int, int, int]]] = []
    gaps: list[int] = []
    for j in np.argsort(-weights, kind="stable"):
        if weights[j] < 1:
            break
        parts = np.repeat(np.arange(1, CLASSES + 1), combos[:, j].astype(int)).tolist()
        for _ in range(int(weights[j])):
            if any(len(queues[p]) < parts.count(p) for p in parts):
                break
            row = [queues[p].pop() for p in parts]
            windows.append([(i, 0, int(lengths[i])) for i in row])
            gaps.append(window - int(sum(lengths[i] for i in row)))
    rest = sorted((i for q in queues for i in q), key=lambda i: (-lengths[i], i))
    # Greedy: rests open new windows longest first; whatever reaches past the end is cut there.
    loose = iter([(i, 0, int(lengths[i])) for i in rest])
    held = next(loose, None)
    for w, gap in zip(windows, gaps, strict=True):
        while gap and held:
            i, start, n = held
            take = min(gap, n)
            w.append((i, start, take))
            gap -= take
            held = (i, start + take, n - take) if take < n else next(loose, None)
    short = [k for k, w in enumerate(windows) if sum(p[2] for p in w) < window]
    spare = [p for k in short for p in windows[k]]  # only when the rests ran out: these windows are filled from each other
    windows = [w for k, w in enumerate(windows) if k not in set(short)]
    tail = itertools.chain([held] if held else [], loose, spare)
    now, room = [], window
    for i, start, n in tail:
        while n:
            take = min(room, n)
            now.append((i, start, take))
            start, n, room = start + take, n - take, room - take
            if not room:
                windows.append(now)
                now, room = [], window
    return windows + powers(now)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces, cut into windows whose lengths are the powers of two that their sum holds."""
    left, out = sum(p[2] for p in pieces), []
    stack = pieces[::-1]
    while left:
        size = room = 1 << (left.bit_length() - 1)
        row = []
        while room:
            i, start, n = stack.pop()
            take = min(room, n)
            row.append((i, start, take))
            if take < n:
                stack.append((i, start + take, n - take))
            room -= take
        out.append(row)
        left -= size
    return out


class _Packer:
    """Gathers documents of one task and packs them, a group at a time."""

    def __init__(self, task: int, window: int):
        self.next, self.window = task << 32, window
        self.clear()

    def clear(self):
        self.docs, self.rests, self.held, self.rows = [], [], 0, []

    def add(self, doc_id, ids: bytes):
        n, size = len(ids) // 4, self.window
        whole = n // size * size
        for start in range(0, whole, size):
            self.rows.append((doc_id, start, size, n, self.next, 0, ids[start * 4 : (start + size) * 4]))
            self.next += 1
        if whole < n:
            self.docs.append((doc_id, whole, n))
            self.rests.append(ids[whole * 4 :])
        self.held += n

    def flush(self) -> pa.RecordBatch:
        rows = self.rows
        if self.docs:
            for w in plan(np.array([len(r) // 4 for r in self.rests], np.int64), self.window):
                offset = 0
                for i, start, length in w:
                    doc_id, whole, n = self.docs[i]
                    rows.append((doc_id, whole + start, length, n, self.next, offset, self.rests[i][start * 4 : (start + length) * 4]))
                    offset += length
                self.next += 1
        doc, start, length, total, sequence, offset, ids = zip(*rows, strict=True) if rows else [[]] * 7
        self.clear()  # the pieces hold their ids
        ends = np.concatenate([[0], np.cumsum(np.array(length, np.int64))])
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        columns = [pa.array(c, pa.int64()) for c in (doc, start, length, [zlib.crc32(x) for x in ids], total, sequence, offset)]
        out = pa.RecordBatch.from_arrays([*columns, tokens], [c.split()[0] for c in SCHEMA.split(", ")])
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        from riskloom.llm.bytebpe import load, text_batches
        from riskloom.llm.common import released

        bpe, packer = load(tokenizer), _Packer(TaskContext.get().partitionId(), window)
        for batch in text_batches(batches, limit=BATCH):
            for i, ids in zip(batch.column(0).to_pylist(), bpe.encode_batch(batch.column(1)), strict=True):
                packer.add(i, ids.tobytes() + end)
            if packer.held >= GROUP_IDS:
                yield packer.flush()
        yield packer.flush()
        released()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
