"""Sets of word shingles as sorted 64-bit hashes, computed on the bytes of many texts at once.

Words are runs of bytes outside [\\x20\\x09-\\x0D] with A-Z in lower case; a text's set holds its
distinct runs of `size` words, or its whole sequence of words if it has fewer, or nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SEED = np.random.default_rng(20240607)
_BYTES = _SEED.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_PLACES = _SEED.integers(0, 1 << 63, 64, dtype=np.int64).astype(U) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_STEP_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _STEP and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _STEP_BACK)):
            table = np.full(n, base, U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of each text's words."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(bounds[0]), int(bounds[-1])
    if texts.buffers()[2] is None or high == low:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    bounds = bounds - low
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1][bounds[1:-1] < len(raw)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    powers, back = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTES[raw] * powers[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text in one array, and where each text's begin and the last one's end."""
    hashes, n_words = words(texts)
    ends = np.cumsum(n_words)
    begin = ends - n_words
    if len(hashes) < size:
        whole = np.zeros(0, U)
    else:
        whole = hashes[: len(hashes) - size + 1] * _PLACES[0]
        for k in range(1, size):
            whole = whole + hashes[k : len(hashes) - size + 1 + k] * _PLACES[k]
        whole = mix(whole)
    n_sets = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n_sets)])
    out = np.empty(bounds[-1], U)
    text = np.repeat(np.arange(len(n_sets)), n_sets)
    at = begin[text] + np.arange(len(out)) - bounds[:-1][text]
    long = n_words[text] >= size
    out[long] = whole[at[long]]
    for i in np.flatnonzero((n_words > 0) & (n_words < size)):
        own = hashes[begin[i] : ends[i]]
        n = len(own)
        out[bounds[i] : bounds[i] + 1] = mix(np.sum(own * _PLACES[:n], keepdims=True) + _PLACES[32 + n : 33 + n])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(n_sets)))])


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set that depends on its members alone; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets + _PLACES[60]))])
    sums = sums[bounds[1:]] - sums[bounds[:-1]]
    sizes = np.diff(bounds)
    return np.where(sizes > 0, mix(sums + sizes.astype(U) * _PLACES[61]), U(0))
