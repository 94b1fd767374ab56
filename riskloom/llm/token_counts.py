"""Token counts of the sections of a document, from one encoding of the whole text.

Encoding sections one by one gives other tokens than the document has; here each whole document
is encoded once, token spans follow from the tokens' byte lengths, and an interval join against
the sections' spans says how many tokens each section has. Sections are lines; a line ends
behind its line feed, so sections tile the text.

A token that crosses a boundary is allocated by RULES: "first" to the section of its first byte,
"most" to the section with most of its bytes (the earliest of equals). Every token is counted
exactly once, so the sections' counts add up to the document's.

Defined results: a null or empty text is one empty section without tokens; equal rows are each
counted; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "most")
SCHEMA = "doc_id long, section long, start_char long, n_chars long, n_tokens long, doc_tokens long"


def section_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin; a final line feed opens no further line."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(raw)]])


def attribute(lengths: np.ndarray, starts: np.ndarray, rule: str = "most") -> np.ndarray:
    """How many tokens of these byte lengths each section has; sections begin at `starts`, in order."""
    ends = np.cumsum(lengths)
    begin = ends - lengths
    first = np.searchsorted(starts, begin, "right") - 1
    if rule == "most":
        last = np.searchsorted(starts, ends - 1, "right") - 1
        for t in np.flatnonzero(last > first):
            edges = np.concatenate([[begin[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]])
            first[t] += int(np.argmax(np.diff(edges)))
    return np.bincount(first, minlength=len(starts))


def section_counts(docs: DataFrame, tokenizer: str, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section (from 0), start_char, n_chars, n_tokens, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        from riskloom.llm.bytebpe import load, text_batches

        bpe = load(tokenizer)
        for batch in text_batches(batches):
            columns = [[] for _ in range(6)]
            texts = batch.column(1)
            for i, text, ids in zip(batch.column(0).to_pylist(), texts, bpe.encode_batch(texts), strict=True):
                raw = (text.as_py() or "").encode()
                starts = section_starts(raw)
                counts = attribute(bpe.token_bytes[ids], starts, rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                at = chars[starts]
                n = len(starts)
                for column, values in zip(columns, (np.full(n, -1 if i is None else i), np.arange(n), at, np.diff(np.append(at, chars[-1])), counts, np.full(n, len(ids))), strict=True):
                    column.append(values)
                if i is None:
                    columns[0][-1] = np.ma.masked_all(n, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ma.concatenate(c).astype(np.int64)) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
