"""Repeated byte strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

``windows`` brings all contents that can hold a repeated string together in buckets. In a bucket the distinct contents form
a suffix array with a separator of its own after each. Breadth-first backward extension over its Burrows-Wheeler transform
then meets the common-prefix values in increasing order: the interval of a string of length l + 1 that ends where no value
is set yet sets it to l, and only such intervals are extended further. It stops at the minimum length: neighbours whose
value isn't set by then share at least that many bytes. The classes that these borders leave decide which strings repeat:
a content that stands in several places is in the array once, and counts as often as it stands.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from polyad.llm.common import bound_batches, distinct_rows, id_back
from polyad.llm.windows import Scheme, apply_spans, covered, repeated_spans

LENGTH = 100
ANCHOR = 32
#: Bytes of the stretch by which contents meet for a suffix array.
STRETCH = 64


class _Bytes:
    """Bytes as symbols."""

    def __call__(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)


def suffix_array(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``x`` (bytes + 1, 0 for the separators at ``ends``); a separator is less than any byte, and than later separators."""
    n, k = len(x), 7
    key, padded = np.zeros(n, np.uint64), np.append(x, np.zeros(k, x.dtype)).astype(np.uint64)
    end_of = np.searchsorted(ends, np.arange(n))  # which separator ends a suffix
    left = ends[end_of] - np.arange(n)  # symbols before it
    for i in range(k):
        key = (key << np.uint64(9)) | np.where(left >= i, padded[i : i + n], 0)
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == n - 1:
            return order
        # Suffixes that tie and end within k symbols go by separator, the others by what follows.
        then = np.append(rank, np.zeros(k, np.int64))[k : k + n]
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.where(left < k, end_of, then).astype(np.uint64)
        k *= 2


def prefix_classes(x: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """In suffix order, a number shared by suffixes whose first ``length`` symbols agree."""
    n = len(x)
    bwt = x[order - 1]  # before the first text stands the last separator
    first = x[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lf = rank[order - 1]  # where a suffix goes that has one symbol more in front
    bound = np.zeros(n + 1, bool)  # common prefix known, so less than the length
    bound[0] = bound[n] = True
    # Level 0: each separator and each byte.
    edge = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (first[1:] == 0)))
    lb, rb = edge, np.append(edge[1:], n)
    bound[rb] = True
    for _ in range(1, length):
        if not len(lb):
            break
        width = rb - lb
        owner = np.repeat(np.arange(len(lb)), width)
        at = np.arange(len(owner)) + np.repeat(lb - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        real = bwt[at] != 0
        to, owner = lf[at[real]], owner[real]
        if not len(to):
            break
        # Extensions by one byte are contiguous; their ends that are still open get this level's value.
        s = np.argsort(to)
        to, owner = to[s], owner[s]
        head = np.flatnonzero(np.append(True, (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (first[to[1:]] != first[to[:-1]])))
        lb, rb = to[head], to[np.append(head[1:], len(to)) - 1] + 1
        fresh = ~bound[rb]
        lb, rb = lb[fresh], rb[fresh]
        bound[rb] = True
    return np.cumsum(bound[:n])


def string_classes(texts: list[bytes], length: int) -> np.ndarray:
    """A number for each string of ``length`` bytes in the texts, one text after the other; equal strings have equal numbers."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes) - 1
    x = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + 1
    x[ends] = 0
    order = suffix_array(x, ends)
    of = np.empty(len(x), np.int64)
    of[order] = prefix_classes(x, order, length)
    at = np.arange(len(x))
    return np.unique(of[ends[np.searchsorted(ends, at)] - at >= length], return_inverse=True)[1]


def classes(contents: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each string of LENGTH bytes in the distinct contents of a bucket, and how often each class stands by the copies of each window."""
    found = string_classes(contents, LENGTH)
    return found, np.bincount(found, copies)


SCHEME = Scheme(LENGTH, ANCHOR, STRETCH, _Bytes(), classes, keep_first=True)


def _row(text: bytes, spans: list[tuple[int, int]], copies: int) -> list[tuple]:
    def without_(gone: list[tuple[int, int]]) -> tuple:
        kept, at = [], 0
        for a, b in gone:
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        return len(text), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone], b"".join(kept)

    # Of rows that repeat an id and its text all but one are repeated as a whole.
    whole = [(0, len(text))] if len(text) >= LENGTH else []
    return [without_(covered(spans, len(text), LENGTH)), *[without_(whole)] * (copies - 1)]


def drop_repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col, n_bytes, n_removed, spans`` (start, end) in bytes, ``kept`` binary.

    Every byte is removed that a string of LENGTH bytes covers which also starts earlier: in a document of smaller id, or
    earlier in the same one. Strings are judged on the input. Null texts count as empty; texts under LENGTH bytes stay as
    they are; a null id sorts before all others. Rows that share an id are documents of their own, in the order of a digest
    of their texts; of rows with one id and one text, one comes first. An empty table gives an empty result; further
    columns are ignored, whatever their names.
    """
    bound_batches(df.sparkSession)
    docs = distinct_rows(df, id_col, text_col)
    out = apply_spans(docs, repeated_spans(docs, SCHEME), "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary", _row)
    return out.select(id_back("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept")
