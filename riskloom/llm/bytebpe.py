"""Byte-level BPE encoding of whole texts, with the ids that the tokenizers library gives.

Text splits into units of one blank and the run of other characters after it; no merge and no
piece of the pre-tokeniser's pattern spans units, so each distinct unit of a batch is encoded once,
all of them in a single call, and its ids are copied to every place where it stands. Texts with
other white space than single blanks and line feeds, or with a special token's string, are
encoded directly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern of the byte-level pre-tokeniser (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space (Unicode's White_Space and what Python counts besides); the rest of a text is units.
SPACE = r"\t\n\v\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
OTHER = SPACE.replace(r"\n", "").replace(r"\x1c-\x20", r"\x1c-\x1f")
UNEVEN = rf"\A[{SPACE}]|[{SPACE}]\z|[{SPACE}][{SPACE}]|[{OTHER}]|\A\z"
#: Texts are encoded in batches of about so many bytes; a single text may be longer.
BATCH_BYTES = 8_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        ranks = {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}
        core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._encode = lambda text: core.encode_to_numpy(text, allowed_special="all")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = np.zeros(size, np.int64)
        self.leads = np.zeros(size, bool)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
            self.leads[i] = token[:1] == b" "
        for token, i in self.special.items():
            self.token_bytes[i] = len(token.encode())

    def direct(self, text: str) -> np.ndarray:
        return np.asarray(self._encode(text), "<u4")

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each unit after a blank, in one array, and where each unit's ids begin and the last one's end."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), pa.scalar(" ", pa.large_string()))
        ids = self.direct(" " + joined[0].as_py())
        at = np.flatnonzero(self.leads[ids])
        if len(at) == len(units):
            return ids, np.append(at, len(ids))
        each = [self.direct(" " + u.as_py()) for u in units]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        for s in self.special:
            uneven = pc.or_(uneven, pc.match_substring(texts, s))
        uneven = uneven.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(uneven):
            out[i] = self.direct(texts[int(i)].as_py())
        even = np.flatnonzero(~uneven)
        if not len(even):
            return out
        lists = pc.split_pattern(texts.take(pa.array(even)), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes, units = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ids, at = self._units(units)
        heads = [self.direct(u.as_py()) for u in units.take(pa.array(codes[bounds[:-1]]))]  # the first unit has no blank
        codes[bounds[:-1]] = len(units) + np.arange(len(heads))
        begin = np.concatenate([at, len(ids) + np.cumsum([0, *map(len, heads)])])
        ids = np.concatenate([ids, *heads])
        size = np.diff(begin)
        begin, size = np.delete(begin[:-1], len(units)), np.delete(size, len(units))
        counts = size[codes]
        ends = np.cumsum(counts)
        placed = ids[np.repeat(begin[codes] - ends + counts, counts) + np.arange(ends[-1])]
        stops = ends[bounds[1:] - 1].tolist()
        for i, a, b in zip(even.tolist(), [0, *stops], stops, strict=False):
            out[i] = placed[a:b]
        return out


def text_batches(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches, cut so that the texts of each batch have about `limit` bytes at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
