"""String similarity: the Indel ratio of sorted tokens, as an Arrow UDF behind a native bound, and distances of many pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from polyad.functions.text import token_sort


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; the bits of one integer stand for the places in ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - insertions and deletions / both lengths); 100 for two empty strings."""
    n = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / n if n else 100.0


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> int:
    """The Indel ratio of both strings with their tokens sorted, cut to an integer; 0 if either has no token."""
    a, b = sorted_tokens(a), sorted_tokens(b)
    return int(indel_ratio(a, b)) if a and b else 0


@F.pandas_udf(IntegerType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b)], dtype="Int32")


def token_sort_ratio_col(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def may_reach(a: Column, b: Column, cutoff: int) -> Column:
    """A native bound that every pair with a ratio of at least ``cutoff`` meets: the Levenshtein distance of the sorted tokens is no greater than their Indel distance."""
    x, y = token_sort(a), token_sort(b)
    both = F.length(x) + F.length(y)
    return F.levenshtein(x, y) <= F.floor(both * (100 - cutoff) / 100.0)


def levenshtein(a: str, b: str) -> int:
    """Edit distance; the bits of integers stand for the places in ``a``."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(x | up)), up & x
        d += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(eq | down | more)), more & (eq | down)
    return d


def indel(a: str, b: str) -> int:
    """Insertions and deletions between two strings."""
    return len(a) + len(b) - 2 * lcs_length(a, b)


#: Places that one machine word has; longer strings are compared one by one.
WORD = 64
#: Characters fall into so many cells by their code, which only weakens the bounds by counts.
CELLS = 64
#: Strings of a part, pairs that are compared at a time, numbers in a table of places.
PART, PAIRS, PLACES = 128, 1 << 17, 1 << 22


class Strings:
    """Strings in order of length as arrays: lengths, characters per cell, codes of characters, signatures, and parts of equal length."""

    def __init__(self, strings: list[str], alphabet: np.ndarray):
        self.strings, self.n = strings, np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters, code = len(alphabet), np.searchsorted(alphabet, flat)
        row = np.repeat(np.arange(len(strings)), self.n)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        counts = np.bincount(row * CELLS + code % CELLS, minlength=len(strings) * CELLS).reshape(-1, CELLS)
        self.counts = counts.T.astype(np.int16 if self.n.max(initial=0) < 1 << 15 else np.int64)
        short = at < WORD
        # The last code stands for what lies beyond the end and occurs nowhere.
        self.codes = np.full((len(strings), WORD), len(alphabet), np.int32)
        self.codes[row[short], at[short]] = code[short]
        # The k-th of a cell's characters flips one bit, so strings differ in as many characters as signatures in bits, or more.
        self.signs = np.zeros(len(strings), np.uint64)
        for c in range(min(CELLS, self.letters)):
            k = np.arange(self.counts[c].max(initial=0))
            bits = np.uint64(1) << ((c + k * min(self.letters, CELLS - 1)) % 64).astype(np.uint64)
            flips = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)])
            self.signs ^= flips[self.counts[c]]
        runs = np.flatnonzero(np.diff(self.n, prepend=-1)).tolist() + [len(strings)]
        self.starts = np.array([k for a, b in zip(runs, runs[1:]) for k in range(a, b, PART)], np.int64)
        self.sizes = np.diff(self.starts, append=len(strings))
        self.least, self.most = (f.reduceat(self.counts, self.starts, axis=1) for f in (np.minimum, np.maximum))

    def places(self, first: int, end: int) -> np.ndarray:
        """The places of each code in the strings from ``first`` to before ``end``, as bits."""
        out = np.zeros((end - first, self.letters + 1), np.uint64)
        row = np.arange(end - first)
        for k in range(min(WORD, int(self.n[first:end].max(initial=0)))):
            out[row, self.codes[first:end, k]] |= np.uint64(1 << k)
        out[:, self.letters] = 0
        return out


def alphabet_of(*strings: list[str]) -> np.ndarray:
    return np.unique(np.frombuffer("".join(s for x in strings for s in x).encode("utf-32-le", "surrogatepass"), np.uint32))


def distances(x: Strings, y: Strings, p: np.ndarray, q: np.ndarray, edits: bool, places: np.ndarray, first: int = 0) -> np.ndarray:
    """Edit distances (or insertions and deletions, without ``edits``) of the strings p of ``x`` and q of ``y``; ``places`` are those of ``x`` from ``first`` on."""
    m, n = x.n[p], y.n[q]
    d = np.zeros(len(p), np.int64)
    long_ = (m > WORD) | (n > WORD) | (m == 0)
    for k in np.flatnonzero(long_).tolist():
        d[k] = (levenshtein if edits else indel)(x.strings[p[k]], y.strings[q[k]])
    p, q, m, n = p[~long_] - first, q[~long_], m[~long_], n[~long_]
    one, ones = np.uint64(1), np.full(len(p), ~np.uint64(0))
    last = one << (m - 1).astype(np.uint64)
    up, down, out = ones.copy(), np.zeros(len(p), np.uint64), m.copy()
    for k in range(int(n.max(initial=0))):
        eq = places[p, y.codes[q, k]]
        if not edits:
            hit = up & eq
            up = (up + hit) | (up - hit)
            continue
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(h | up), up & h
        out += ((more & last) != 0).astype(np.int64) * (k < n) - ((less & last) != 0).astype(np.int64) * (k < n)
        more, less = more << one | one, less << one
        up, down = less | ~(eq | down | more), more & (eq | down)
    if not edits:
        out = m + n - 2 * np.bitwise_count(~up & (last | (last - one))).astype(np.int64)
    d[~long_] = out
    return d


def _reach(m: np.ndarray, n: np.ndarray, share: int, edits: bool) -> np.ndarray:
    """How many characters strings of these lengths may differ in, counted without order; -1 where the lengths differ by too much."""
    k, apart = (m + n) * share // 100, np.abs(m - n)
    return np.where(apart > k, -1, 2 * k - apart if edits else k)


def _candidates(x: Strings, y: Strings, reach: np.ndarray, own: bool, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose signatures are near enough, of the parts of ``x`` from ``first`` to before ``end``."""
    for k in range(first, end):
        open_ = np.flatnonzero(reach[k] >= 0)
        open_ = open_[open_ >= k] if own else open_
        if not len(open_):
            continue
        least = sum(np.maximum(0, np.maximum(x.least[c, k] - y.most[c, open_], y.least[c, open_] - x.most[c, k])).astype(np.int64) for c in range(min(CELLS, x.letters)))
        open_ = open_[least <= reach[k, open_]]
        size = y.sizes[open_]
        q = np.arange(size.sum()) + np.repeat(y.starts[open_] - (np.cumsum(size) - size), size)
        most = np.repeat(np.minimum(reach[k, open_], 64).astype(np.uint8), size)
        signs, mine = y.signs[q], x.signs[x.starts[k] : x.starts[k] + x.sizes[k], None]
        for at in range(0, len(q), 1024):
            near = np.bitwise_count(mine ^ signs[None, at : at + 1024]) <= most[None, at : at + 1024]
            hit = np.flatnonzero(near)
            a, b = np.divmod(hit, near.shape[1])
            a, b = a + x.starts[k], q[at + b]
            yield (a[a < b], b[a < b]) if own else (a, b)


def close(x: Strings, y: Strings, share: int, edits: bool, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, d): all pairs whose distance is at most ``share`` percent of both lengths together; p < q where ``y`` is ``x`` itself.

    Parts whose lengths or counts of characters rule out all their pairs aren't compared, nor those of ``skip``. Signatures
    rule out most other pairs.
    """
    reach = _reach(x.n[x.starts][:, None], y.n[y.starts][None, :], share, edits)
    if skip is not None:
        reach = np.where(skip, -1, reach)
    step = max(1, PLACES // (x.letters + 1) // PART)
    for first in range(0, len(x.starts), step):
        end = min(first + step, len(x.starts))
        row = int(x.starts[first])
        places = None
        for p, q in _gathered(_candidates(x, y, reach, x is y, first, end)):
            far = (x.n[p] > WORD) | (y.n[q] > WORD)
            if far.any():  # long strings are slow to compare
                apart = np.abs(x.counts[:, p[far]].astype(np.int64) - y.counts[:, q[far]]).sum(axis=0)
                far[far] = apart > _reach(x.n[p[far]], y.n[q[far]], share, edits)
                p, q = p[~far], q[~far]
            places = x.places(row, int(x.starts[end - 1] + x.sizes[end - 1])) if places is None else places
            d = distances(x, y, p, q, edits, places, row)
            near = d <= (x.n[p] + y.n[q]) * share // 100
            yield p[near], q[near], d[near]


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, many at a time."""
    held, count = [], 0
    for pair in found:
        held.append(pair)
        count += len(pair[0])
        if count >= PAIRS:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, count = [], 0
    if count:
        yield tuple(np.concatenate(c) for c in zip(*held))
