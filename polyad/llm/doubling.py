"""Repeated word windows by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length, until the full length is reached or none is left.
At 9 and at 18 words a level looks at the stretch of its length in a window that comes first in an order of all of them,
which equal windows share; at 35 words at the window itself. Each of the first two levels deals all windows that are left in
all documents out by their stretch, in ``windows``, and drops those whose stretch occurs once.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from polyad.llm.common import bound_batches, distinct_rows, id_back
from polyad.llm.windows import Scheme, apply_spans, covered, gram_hashes, repeated_spans

WORDS = 35
ANCHOR = 9


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each word between ASCII white space."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))


def classes(contents: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each window of WORDS words in the distinct contents of a bucket, and how often each class stands by the copies of each window."""
    x = np.frombuffer(b"".join(contents), np.uint64)
    ends = np.cumsum([len(c) // 8 for c in contents])
    at = np.arange(len(x) - WORDS + 1)
    at = at[ends[np.searchsorted(ends, at, "right")] - at >= WORDS]
    found = np.unique(gram_hashes(x, WORDS)[at], return_inverse=True)[1]
    return found, np.bincount(found, copies)


SCHEME = Scheme(WORDS, ANCHOR, 2 * ANCHOR, word_hashes, classes, keep_first=False)


def _row(text: bytes, spans: list[tuple[int, int]], copies: int) -> list[tuple]:
    words = text.split()
    # Rows that repeat an id and its text repeat each other.
    gone = covered(spans, len(words), WORDS) if copies == 1 else [(0, len(words))] if len(words) >= WORDS else []
    kept, at = [], 0
    for a, b in gone:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return [(len(words), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone], b" ".join(kept).decode())] * copies


def drop_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col, n_words, n_removed, spans`` (start, end) in words, ``kept`` text.

    Every word is removed that is covered by WORDS consecutive words which also start anywhere else, in the same document
    or another; windows are judged on the input, and the kept words are joined by one space. Words lie between ASCII white
    space and are compared unchanged. Null texts have no words; texts under WORDS words lose none. Rows that share an id are
    documents of their own and repeat each other. An empty table gives an empty result; further columns are ignored,
    whatever their names.
    """
    bound_batches(df.sparkSession)
    docs = distinct_rows(df, id_col, text_col)
    out = apply_spans(docs, repeated_spans(docs, SCHEME), "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string", _row)
    return out.select(id_back("id").alias(id_col), "n_words", "n_removed", "spans", "kept")
