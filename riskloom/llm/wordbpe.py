"""Word BPE encoding and decoding by batched numpy merge rounds.

The symbols of all distinct words of a batch stand in one flat array. A round looks up the rank
of every pair of neighbours by binary search over the sorted pair keys, and merges in each word
the pair of lowest rank wherever it stands; words without a known pair leave the array.

Defined results: a null text is empty and has no ids; special tokens' strings in a text become
their ids, as the library does; texts of any length are encoded whole, in batches of bounded
size; equal rows give equal results; an empty table gives no rows. Only the id and the text are
read, so other columns may have any name; a null id stays null.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bytebpe import byte_alphabet

#: What the vocabulary's pre-tokeniser keeps of a text (fixed by the vocabulary), with the classes to be filled in.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
END = "</w>"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def merge_words(symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the words that begin at `starts` in `symbols`.

    keys: left * base + right of each known pair, sorted; ranks and merged: in the same order.
    Gives the words' final symbols in one array, in word order, and the words' lengths.
    """
    n_words = len(starts)
    word = np.repeat(np.arange(n_words), np.diff(np.append(starts, len(symbols))))
    done_symbols, done_words = [], []
    while len(symbols):
        key = symbols[:-1] * base + symbols[1:]
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        known = (keys[at] == key) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, ranks[at], np.iinfo(np.int64).max), np.iinfo(np.int64).max)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, len(word)))
        least = np.repeat(np.minimum.reduceat(rank, first), size)
        live = least < np.iinfo(np.int64).max
        if not live.all():
            done_symbols.append(symbols[~live])
            done_words.append(word[~live])
        here = live & (rank == least)
        # of overlapping places (a pair of equal symbols in a run of them) every other one counts
        spot = np.flatnonzero(here)
        if len(spot):
            fresh = np.append(True, np.diff(spot) > 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - run) % 2 == 0]
            symbols = symbols.copy()
            symbols[spot] = merged[at[spot]]
            live[spot + 1] = False
        symbols, word = symbols[live], word[live]
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(n_words, np.int64)
    words, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
    order = np.argsort(words, kind="stable")
    return symbols[order], np.bincount(words, minlength=n_words)


def library_classes() -> dict[str, str]:
    """Letters, numbers and white space as the tokenizers library has them, as ranges for a character class.

    Its Unicode tables are not those of Python's modules, so it is asked, for all code points at once.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = {}
    for name, pattern in (("letters", r"\p{L}+"), ("numbers", r"\p{N}+"), ("spaces", r"\s+")):
        runs = [piece for piece, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)]
        spans = []
        for run in runs:  # a run over the surrogates' gap is two ranges
            low = [c for c in run if c < "\ud800"]
            spans += [x for x in (low, run[len(low) :]) if x]
        out[name] = "".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for x in spans)
    return out


def odd_characters(normalize) -> re.Pattern:
    """Characters that the library normalises otherwise than Python, and those unknown to Python, which might join others."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 1]
    theirs = normalize("\x01".join(every)).split("\x01")
    odd = [c for c, t in zip(every, theirs, strict=True) if unicodedata.category(c) == "Cn" or (t != " " and t != plain(c))]
    codes = np.array([ord(c) for c in odd])
    first = np.flatnonzero(np.append(True, np.diff(codes) > 1))
    last = np.append(first[1:] - 1, len(codes) - 1)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[first].tolist(), codes[last].tolist(), strict=True)) + "]")


def plain(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter, so without a final form


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).normalizer.normalize_str
        self.odd = odd_characters(self.library).search
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.find = re.compile(PATTERN.format(**library_classes())).findall
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * self.base
        for name, i in (vocab | self.special).items():
            names[i] = name
        self.names = pa.array(names)
        letter = {b: c for c, b in byte_alphabet().items()}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + END] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks, self.merged = first.astype(np.int64), made[first]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return self.library(text) if self.odd(text) else plain(text)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in one array, and the number of each word's ids."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        return merge_words(symbols, ends - size, self.keys, self.ranks, self.merged, self.base)

    def _segments(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that hold no special tokens."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([self.normal(t) for t in texts], pa.large_string()), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        found, numbers, counts = [], {}, []
        for unit in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            parts = [unit] if unit.isascii() and unit.isalpha() else self.find(unit)
            counts.append(len(parts))
            found += [numbers.setdefault(w, len(numbers)) for w in parts]
        ids, size = self._words(list(numbers)) if numbers else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids = ids.astype("<u4")
        begin = np.cumsum(size) - size
        # unit -> its words -> their ids; then text -> its units
        found = np.array(found, np.int64)
        unit_ids = ids[ranges(begin[found], size[found])]
        word_ends = np.concatenate([[0], np.cumsum(size[found])])
        unit_at = word_ends[np.concatenate([[0], np.cumsum(counts)])]
        unit_size = np.diff(unit_at)
        ends = np.concatenate([[0], np.cumsum(unit_size[codes])])
        placed = unit_ids[ranges(unit_at[:-1][codes], unit_size[codes])]
        return [placed[a:b] for a, b in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.split_special.split(t or "") if any(s in (t or "") for s in self.special) else [t or ""] for t in texts]
        done = iter(self._segments([p for ps in parts for p in ps if p not in self.special]))
        out = []
        for ps in parts:
            own = [np.array([self.special[p]], "<u4") if p in self.special else next(done) for p in ps]
            out.append(own[0] if len(own) == 1 else np.concatenate(own))
        return out

    def decode_batch(self, ids: list[np.ndarray]) -> pa.Array:
        """The texts of each list of ids: its tokens' strings, joined by blanks as the vocabulary names no decoder."""
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        tokens = self.names.take(pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, ids (an array), decoded (their text)."""

    def run(batches):
        from riskloom.llm.bytebpe import text_batches

        bpe = load(tokenizer)
        for batch in text_batches(batches):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            flat = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), bpe.decode_batch(ids).cast(pa.string())], [id_col, "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, ids array<long>, decoded string")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256: `encode` where only its digests are asked for."""

    def run(batches):
        from riskloom.llm.bytebpe import text_batches

        bpe = load(tokenizer)
        for batch in text_batches(batches):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            texts = bpe.decode_batch(ids)
            sha = [hashlib.sha256(i.tobytes()).hexdigest() for i in ids]
            decoded = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(sha), pa.array(decoded)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
