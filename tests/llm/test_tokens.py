import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from riskloom.llm import bytebpe, packing, token_counts, wordbpe  # noqa: E402

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
FIXED = [None, "", " ", "a", "  a b", "x\n\ny  z", " lead", "trail ", "a<|endoftext|>b", "tab\there", "nb\xa0sp x", "it's we'll 've", "a \n b", "\x1c a", "日本 語\r\n", "ΣΑΣ İx", "aaaa ----", "é Å", "word " * 3000 + "end", "x" * 9000]


def texts():
    rnd = random.Random(5)
    return FIXED + ["".join(rnd.choice("  \n\tab'sé1.日\x1c\x85\xa0😀ΣİAé<") for _ in range(rnd.randrange(60))) for _ in range(400)]


def test_byte_bpe_equals_the_library():
    want = Tokenizer.from_file(BYTES)
    got = bytebpe.load(BYTES).encode_batch(pa.array(texts(), pa.string()))
    for t, g in zip(texts(), got, strict=True):
        assert g.tolist() == want.encode(t or "", add_special_tokens=False).ids, t


def test_text_batches_keep_all_rows():
    rows = [("x" * (i * 97 % 500)) if i % 9 else None for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(rows, pa.string())], ["id", "text"])
    parts = list(bytebpe.text_batches([batch], limit=1000))
    assert [x for p in parts for x in p.column(1).to_pylist()] == rows
    assert len(parts) > 10


def test_word_bpe_equals_the_library(spark, documents):
    want = Tokenizer.from_file(WORDS)
    rows = list(enumerate([*texts(), "a<|startoftext|> <|endoftext|>"]))
    got = {r.doc_id: r for r in wordbpe.encode_decode(documents(rows), WORDS).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = want.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(want.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_merge_rounds_take_the_lowest_rank_first():
    keys = np.array([1 * 10 + 1, 2 * 10 + 1], np.int64)  # (1,1) -> 2 before (2,1) -> 3
    out, size = wordbpe.merge_words(np.array([1, 1, 1, 1, 1, 4]), np.array([0, 5]), keys, np.array([0, 1]), np.array([2, 3]), 10)
    assert out.tolist() == [2, 3, 4] and size.tolist() == [2, 1]


def test_section_counts(spark, documents):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = list(enumerate([*texts(), "one\ntwo three\n\nfour\n", "a\n\n\n\nb"]))
    for rule in token_counts.RULES:
        got = defaultdict(dict)
        for r in token_counts.section_counts(documents(rows), BYTES, rule).collect():
            got[r.doc_id][r.section] = r
        for i, t in rows:
            t = t or ""
            code = tokenizer.encode(t, add_special_tokens=False)
            *whole, last = t.split("\n")
            lines = [x + "\n" for x in whole] + ([last] if last or not whole else [])
            ends, at = [], 0
            for line in lines:
                at += len(line.encode())
                ends.append(at)
            want = [0] * len(lines)
            at = 0
            for token in code.ids:
                n = len(tokenizer.id_to_token(token)) if token != 50256 else 13
                share = [max(0, min(e, at + n) - max(b, at)) for b, e in zip([0, *ends], ends, strict=False)]
                k = next(k for k, s in enumerate(share) if s) if rule == "first" else share.index(max(share))
                want[k] += 1
                at += n
            assert [got[i][k].n_tokens for k in range(len(lines))] == want, (t, rule)
            assert [got[i][k].n_chars for k in range(len(lines))] == [len(x) for x in lines]
            assert {r.doc_tokens for r in got[i].values()} == {len(code.ids)}
    assert token_counts.section_counts(documents([]), BYTES).collect() == []
    with pytest.raises(ValueError):
        token_counts.section_counts(documents([]), BYTES, "half")


def check_packing(rows, pieces, window=2048):
    tokenizer = Tokenizer.from_file(BYTES)
    docs = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(docs[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, total


def test_packing(spark, documents):
    rows = list(enumerate([*texts(), *("word " * (i * 13 % 3000) for i in range(150))]))
    pieces = packing.pack(documents(rows, 2), BYTES).collect()
    padding, total = check_packing(rows, pieces)
    assert padding == 0 and total > 100_000
    assert packing.pack(documents([]), BYTES).collect() == []


def test_nnls_fits_and_stays_positive():
    rng = np.random.default_rng(1)
    a = packing.combinations(16, 3)
    x = rng.integers(0, 50, a.shape[1]) * (rng.random(a.shape[1]) < 0.3)
    got = packing.nnls(a, a @ x)
    assert got.min() >= 0
    assert np.abs(a @ got - a @ x).max() < 1e-6 * (a @ x).max()


def test_most_windows_come_from_combinations():
    rng = np.random.default_rng(2)
    windows = packing.plan(rng.integers(1, 2048, 5000))
    assert sum(len(w) <= packing.DEPTH + 1 for w in windows) > 0.8 * len(windows)


def test_word_bpe_over_all_code_points():
    """Every code point between two letters, alone and doubled, gives the library's ids."""
    from tokenizers import Tokenizer

    path = WORDS
    library = Tokenizer.from_file(path)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x35000), *range(0xE0000, 0xE0200)]]
    texts = [f"a{c}b {c}{c} 1{c}" for c in every]
    for k in range(0, len(texts), 20_000):
        part = texts[k : k + 20_000]
        theirs = library.encode_batch(part, add_special_tokens=False)
        ours = wordbpe.load(path).encode_batch(part)
        wrong = [t for t, a, b in zip(part, ours, theirs, strict=True) if a.tolist() != b.ids]
        assert not wrong, (len(wrong), [hex(ord(t[1])) for t in wrong[:20]])


def test_word_bpe_gives_ids_and_texts(spark, documents):
    from tokenizers import Tokenizer

    path = WORDS
    library = Tokenizer.from_file(path)
    rows = [(1, "Hello  World 42"), (2, None), (3, "\u1c89 gr\u00fc\u00dfe <|endoftext|>"), (None, "x")]
    got = {r.doc_id: (list(r.ids), r.decoded) for r in wordbpe.encode(documents(rows), path).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))
