"""Benchmark passages in documents: SimHash of item-sized windows, multi-index lookup, exact verification.

Items are taken in blocks of bounded size; each block is a query set that goes to the executors as a whole and meets every
document once, so that nothing is shuffled. Of a document only windows that hold a shingle of some item are looked at:
without a common shingle the similarity is zero. Their fingerprints come from running sums of the bits. The 64 bits are
cut into BLOCKS blocks: fingerprints within RADIUS differ in at most RADIUS // BLOCKS bits of one block at least, so a
lookup of each block among all values that near finds every item within the radius. The exact weighted similarity of
five-word shingles, repeats counted, decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyad.llm.common import as_struct, bound_batches, from_struct, materialize, release
from polyad.llm.simhash import SEED, majority

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 a bit differs with a chance of about 0.15; 24 of 64 are 5 standard deviations off.
RADIUS = 24
BLOCKS = 8
#: Bytes of item text, and items, in one block of the query set, on average.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 50_000
#: Which values of a block are near each value: one of the blocks must be, within the radius.
_NEAR = np.array([[(u ^ v).bit_count() <= RADIUS // BLOCKS for u in range(256)] for v in range(256)])
_BITS = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], np.int32)


def grams(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of n words joined by one space."""
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(n)))), repeat(SEED)), np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the five-word shingles; of the whole sequence if there are fewer words."""
    return grams(words, min(WORDS, len(words))) if words else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles: common repeats over all repeats."""
    u, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(i, minlength=len(u)) for i in (inverse[: len(a)], inverse[len(a) :]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum()) if len(u) else 0.0


class Index:
    """Items by shingle and by the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept = [(i, w) for i, t in items if (w := (t or "").encode().lower().split())]
        self.ids = [i for i, _ in kept]
        self.size = np.array([len(w) for _, w in kept], np.int64)
        self.shingles = [shingles(w) for _, w in kept]
        self.fps = np.array([majority(s) for s in self.shingles], np.uint64)
        flat = np.concatenate([*self.shingles, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(kept)), [len(s) for s in self.shingles])
        order = np.argsort(flat, kind="stable")
        self.by_shingle, self.owner = flat[order], owner[order]
        self.short = sorted({int(m) for m in self.size if m < WORDS})

    def candidates(self, fps: np.ndarray, items: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) for all fingerprints of windows within the radius of those of the items.

        Each block has a table from its value to the items that have it, which meet the windows whose value is near that one.
        """
        values, of = fps.view(np.uint8).reshape(-1, BLOCKS), self.fps[items].view(np.uint8).reshape(-1, BLOCKS)
        pairs = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            order = np.argsort(of[:, b], kind="stable")
            held, at = np.unique(of[order, b], return_index=True)
            for v, mine in zip(held.tolist(), np.split(order, at[1:])):
                windows = np.flatnonzero(_NEAR[v][values[:, b]])
                pairs.append((windows[:, None] * len(items) + mine[None, :]).ravel())
        w, k = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(items)))
        close = np.bitwise_count(fps[w] ^ self.fps[items[k]]) <= RADIUS
        return list(zip(w[close].tolist(), items[k[close]].tolist()))

    def matches(self, text: bytes) -> dict[int, tuple[float, int]]:
        """Item to (similarity, first word) of its most similar window, of the first of them on a tie."""
        best: dict[int, tuple[float, int]] = {}
        words = text.lower().split()
        if not words or not self.ids:
            return best
        for n in {*([WORDS] if len(words) >= WORDS else [len(words)]), *(m for m in self.short if m < len(words))}:
            hashes = grams(words, n)
            low, high = np.searchsorted(self.by_shingle, hashes), np.searchsorted(self.by_shingle, hashes, "right")
            at = np.flatnonzero(high > low)
            if not len(at):
                continue
            runs = high[at] - low[at]
            entry = np.repeat(low[at] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            items, pos = self.owner[entry], np.repeat(at, runs)
            for size in np.unique(self.size[items]).tolist():
                if (size < WORDS) != (n < WORDS) and len(words) >= WORDS:
                    continue
                of, mine = np.unique(items[self.size[items] == size]), pos[self.size[items] == size]
                width = min(len(hashes), max(1, size - n + 1))
                starts = np.unique(np.clip((mine[:, None] - np.arange(width)[None, :]).ravel(), 0, len(hashes) - width)) if width * len(mine) < 4 * len(hashes) else np.arange(len(hashes) - width + 1)
                for part in np.array_split(starts, 1 + len(starts) // 8192):
                    if not len(part):
                        continue
                    base = int(part[0])
                    bits = _BITS[hashes[base : int(part[-1]) + width].view(np.uint8)].reshape(-1, 64)
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
                    counts = sums[part - base + width] - sums[part - base]
                    fps = np.packbits(counts * 2 > width, axis=1, bitorder="little").view(np.uint64).ravel()
                    for w, item in self.candidates(fps, of):
                        p = int(part[w])
                        s = similarity(hashes[p : p + width], self.shingles[item])
                        if s >= SIMILARITY and (item not in best or s > best[item][0]):
                            best[item] = (s, p)
        return best


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Index, bool]]:
    """Indexes of bounded blocks that together hold all items, and whether it is the only one."""
    items = materialize(items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "items")
    total, rows = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    n = 1 + max(total // BLOCK_BYTES, rows // BLOCK_ITEMS)
    for b in range(n):
        yield Index([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).orderBy("item", "text").collect()]), n == 1
    release(items)


def _found(docs: DataFrame, index: Index, only: bool, schema: str | T.StructType, emit: Callable) -> DataFrame:
    """``emit`` of the batches of ``docs`` (anything, text) and what is found in them.

    A single index is broadcast and the result lazy; of several, each result is written, so that one at a time is held.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emit(batch, [shared.value.matches(x.as_py() or b"") for x in batch.column(1)], shared.value)

    out = docs.mapInArrow(run, schema)
    if not only:
        out = materialize(out, "found")
        shared.destroy()
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: ``id_col, item_id, similarity, start_word``.

    A window is as many words of the document as the item has, or the whole document if that is shorter. Words are split at
    ASCII white space and A-Z lower-cased. An item under five words is one shingle. Items and documents without words match
    nothing; null texts count as empty. Repeated rows give repeated results, and items that repeat an id one row each. Empty
    tables give an empty result; further columns are ignored.
    """

    def emit(batch: pa.RecordBatch, found: list[dict], index: Index) -> pa.RecordBatch:
        rows = [(i, index.ids[k], s, p) for i, hit in zip(batch.column(0).to_pylist(), found) for k, (s, p) in sorted(hit.items())]
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["id", "item_id", "similarity", "start_word"]
        )

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    parts = [_found(thin, index, only, "id bigint, item_id bigint, similarity double, start_word bigint", emit) for index, only in _blocks(items, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns, whatever their names. Repeated rows go or stay together."""

    def emit(batch: pa.RecordBatch, found: list[dict], index: Index) -> pa.RecordBatch:
        return batch.filter(pa.array([not hit for hit in found], pa.bool_()))

    rows = docs.select(as_struct(docs).alias("row"), F.col(text_col).cast("binary").alias("text"))
    for index, only in _blocks(items, item_col, item_text_col):
        before, rows = rows, _found(rows, index, only, rows.schema, emit)
        release(before)
    return from_struct(rows, "row", docs.columns)
