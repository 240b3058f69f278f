"""Repeated windows of texts: the distributed part that substring and word-window dedup share.

A window is W consecutive symbols of one document. Its anchor is the k symbols in it that come first in an order of all
runs of k symbols, the leftmost of them on a tie, so equal windows have equal anchors. Consecutive windows with one anchor
form a run of at most W - k + 1 windows. In the order, runs of symbols that many documents of a sample hold come last and
the others go by hash, so that windows around a common passage, but not inside it, meet by what is their own. The sample
changes where windows meet, never the result.

1. Each task cuts its texts into runs. Runs of equal content within a batch are represented by the first of them, with
   their number; representatives go to buckets of anchors in packed blocks.
2. In a bucket, equal contents are again represented by the first one. An anchor that occurs once is done; of all other
   anchors every distinct content is asked for, once, with its number of copies.
3. The contents asked for are cut from the texts, joined by id, and each is split by its longer stretches (of ``stretch``
   symbols, found like anchors). Parts are dealt out by stretch. A stretch that occurs once is done; the windows of the
   others get classes from ``Scheme.classes``, and a class of two or more windows is a repeated one. Contents that are
   alone under their anchor have nobody else to meet; those that follow each other in a text go in one piece.
4. The decisions go back to all copies of a content by its digest, in an ordinary join.

All windows are judged; nothing is sampled or capped. The place of a window is (id, sub, position): ``sub`` tells rows
apart that repeat an id, see ``common.distinct_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from polyad.llm.common import materialize, sized

#: Bytes of text per bucket.
BUCKET_BYTES = 16 << 20
#: Buckets in which contents are compared, for each bucket of records; a suffix array takes some hundred bytes per byte.
SOLVE_SPLIT = 8
#: Bytes of contents cut from texts before they are sent.
ASKED_BYTES = 4 << 20
#: Symbols cut at a time; also where runs of longer documents break.
PIECE = 1 << 18
#: Bytes of contents whose windows are classed at a time, as long as no stretch has more, and of one piece of them.
SLICE = 1 << 16
#: Bytes of texts that are cut into runs before their records are sent.
SENT_BYTES = 8 << 20
#: Bytes of texts whose results are sent at a time.
OUT_BYTES = 8 << 20
#: Documents in which common runs of symbols are looked for, the share of them that makes one common, and most common ones kept.
SAMPLE_ROWS, COMMON_SHARE, COMMON = 16_000, 1e-3, 100_000
#: Symbols among which common runs are counted at a time; those that stand once among them aren't sent.
COUNTED = 8 << 20
#: Cells of the table of common runs of symbols, by the first bits of their hashes.
CELL_BITS = 21
RECORD = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("start", "<u4"), ("windows", "<u2"), ("copies", "<u4")])
PART = np.dtype([("stretch", "<u8"), ("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("start", "<u4"), ("offset", "<u2"), ("windows", "<u2"), ("copies", "<u4"), ("joined", "u1")])
SPAN_SCHEMA = "doc bigint, sub bigint, start bigint, windows int, anchor bigint, content bigint, copies bigint, first boolean, alone boolean"
FOUND_SCHEMA = "anchor bigint, content bigint, offset int, n int, to_first boolean"
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Scheme:
    """What a symbol is, how long windows, anchors and stretches are, which windows are equal, and what happens to the first of them."""

    window: int
    anchor: int
    stretch: int
    symbols: Callable[[bytes], np.ndarray]
    #: Distinct contents, and how often each of their windows stands by its content, to the class of each window, one content after the other, and to how often the windows of each class stand.
    classes: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]
    keep_first: bool


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive values, from hashes of powers of two."""
    out, have, power, size = None, 0, x, 1
    while True:
        if k & size:
            if out is None:
                out, have = power, size
            else:
                n = len(x) - have - size + 1
                out = _mixed(out[:n] * _ODD + power[have : have + n])
                have += size
        if have == k:
            return out
        n = len(x) - 2 * size + 1
        power = _mixed(power[:n] * _ODD + power[size : size + n])
        size *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def in_order(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Hashes as places in the order of all runs of symbols: those in a cell of ``common`` come last."""
    return (h >> np.uint64(1)) | (common[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)] << np.uint64(63))


NONE_COMMON = np.zeros(1 << CELL_BITS, np.uint64)


def runs(x: np.ndarray, bounds: np.ndarray, window: int, k: int, common: np.ndarray = NONE_COMMON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run; ``bounds`` are the offsets of documents in ``x``."""
    if len(x) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = in_order(gram_hashes(x, k), common)
    low = sliding_min(h, window - k + 1)
    n = len(low)
    valid = np.ones(n + 1, bool)
    valid[n] = False
    for end in bounds[1:]:
        valid[max(0, end - window + 1) : min(end, n)] = False
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (h[: n - 1] == low[:-1]) | ~valid[: n - 1]
    new &= valid[:n]
    start = np.flatnonzero(new)
    stop = np.append(start[1:], n)
    # A run ends where windows stop being valid.
    bad = np.flatnonzero(~valid)
    stop = np.minimum(stop, bad[np.searchsorted(bad, start)])
    return low[start], start, stop - start


def _pieces(keys: list[tuple[int, int]], texts: Iterable[bytes], scheme: Scheme) -> Iterator[tuple[list[tuple[int, int]], list[int], np.ndarray, np.ndarray]]:
    """(keys, first symbols, symbols, bounds) of documents put together, or of parts of long ones that overlap by W - 1."""
    docs, first, parts, size = [], [], [], 0
    for doc, text in zip(keys, texts):
        x = scheme.symbols(text)
        for at in range(0, max(1, len(x) - scheme.window + 1), PIECE):
            part = x[at : at + PIECE + scheme.window - 1]
            if len(part) < scheme.window:
                continue
            docs.append(doc), first.append(at), parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield docs, first, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                docs, first, parts, size = [], [], [], 0
    if parts:
        yield docs, first, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def cut(keys: list[tuple[int, int]], texts: Iterable[bytes], scheme: Scheme, common: np.ndarray = NONE_COMMON) -> np.ndarray:
    """Records of all runs of the texts; ``keys`` are (id, sub)."""
    out = [np.zeros(0, RECORD)]
    for docs, first, x, bounds in _pieces(keys, texts, scheme):
        anchor, start, count = runs(x, bounds, scheme.window, scheme.anchor, common)
        r, raw, step = np.zeros(len(anchor), RECORD), memoryview(x).cast("B"), x.itemsize
        stop = start + count + scheme.window - 1
        r["content"] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((start * step).tolist(), (stop * step).tolist())), np.uint64, len(start))
        of = np.searchsorted(bounds, start, "right") - 1
        r["anchor"], r["windows"], r["copies"] = anchor, count, 1
        r["doc"], r["sub"] = (np.array(k, np.int64)[of] for k in zip(*docs))
        r["start"] = start - bounds[of] + np.array(first, np.int64)[of]
        out.append(r)
    return np.concatenate(out)


def represent(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first record by place of each anchor and content, with all their copies, and the other records."""
    r = r[np.lexsort((r["start"], r["sub"], r["doc"], r["content"], r["anchor"]))]
    if not len(r):
        return r, r
    new = np.append(True, (r["anchor"][1:] != r["anchor"][:-1]) | (r["content"][1:] != r["content"][:-1]))
    head = np.flatnonzero(new)
    first = r[head]
    first["copies"] = np.minimum(np.add.reduceat(r["copies"].astype(np.int64), head), 2**32 - 1)
    return first, r[~new]


def _buckets(key: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(key * _ODD) % np.uint64(n)).astype(np.int64)


def _packed(r: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One block of bytes per bucket; fields one after the other, which compresses better."""
    order = np.argsort(bucket, kind="stable")
    r, bucket = r[order], bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(r) else []
    parts = np.split(r, at[1:]) if len(r) else []
    return [int(b) for b in bucket[at]] if len(r) else [], [b"".join(np.ascontiguousarray(p[f]).tobytes() for f in r.dtype.names) for p in parts]


def unpacked(block: bytes, dtype: np.dtype) -> np.ndarray:
    out, at = np.zeros(len(block) // dtype.itemsize, dtype), 0
    for f in dtype.names:
        out[f] = np.frombuffer(block, dtype[f], len(out), at)
        at += len(out) * dtype[f].itemsize
    return out


def _spans(r: np.ndarray, first: bool, alone: np.ndarray | bool = False) -> pa.Table:
    return pa.table(
        {
            "doc": pa.array(np.ascontiguousarray(r["doc"])),
            "sub": pa.array(np.ascontiguousarray(r["sub"])),
            "start": pa.array(r["start"].astype(np.int64)),
            "windows": pa.array(r["windows"].astype(np.int32)),
            "anchor": pa.array(np.ascontiguousarray(r["anchor"]).view(np.int64)),
            "content": pa.array(np.ascontiguousarray(r["content"]).view(np.int64)),
            "copies": pa.array(r["copies"].astype(np.int64)),
            "first": pa.array(np.full(len(r), first)),
            "alone": pa.array(np.broadcast_to(alone, len(r))),
        }
    )


def sliced(parts: np.ndarray, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The parts and pieces by stretch, in slices of about SLICE bytes that hold whole stretches; those that occur once are left out."""
    of = np.cumsum(parts["joined"] == 0) - 1
    key = parts["stretch"][parts["joined"] == 0]
    keys, stretch = np.unique(key, return_inverse=True)
    often = np.bincount(stretch[of], parts["copies"], len(keys)) > 1
    order = np.argsort(stretch, kind="stable")
    order = order[often[stretch[order]]]
    heads, counts = np.flatnonzero(parts["joined"] == 0), np.bincount(of)
    mine, size = [], 0
    for k, i in enumerate(order.tolist()):
        if size > SLICE and stretch[i] != stretch[mine[-1]]:
            yield parts[np.concatenate([np.arange(heads[j], heads[j] + counts[j]) for j in mine])], [pieces[j] for j in mine]
            mine, size = [], 0
        mine.append(i)
        size += len(pieces[i])
    if mine:
        yield parts[np.concatenate([np.arange(heads[j], heads[j] + counts[j]) for j in mine])], [pieces[j] for j in mine]


def decide(parts: np.ndarray, pieces: list[bytes], scheme: Scheme) -> tuple[np.ndarray, ...]:
    """Which windows of the parts (PART records) go: FOUND_SCHEMA as columns. A piece is the content of a part and of those joined to it.

    Windows are equal if ``scheme.classes`` puts them into one class, which says how often they stand. What is found for a
    content with ``to_first`` holds for its first copy, the rest for all other ones.
    """
    piece = np.cumsum(parts["joined"] == 0) - 1
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(c, len(number)) for c in pieces], np.int64)
    n = np.array([len(c) for c in number], np.int64) // scheme.symbols(b"").itemsize - scheme.window + 1
    base, mine = np.cumsum(n) - n, parts["windows"].astype(np.int64)
    before = np.cumsum(mine) - mine
    inside = before - before[parts["joined"] == 0][piece]
    at = base[of[piece]] + inside  # of each part's first window among those of all distinct contents
    copies = np.zeros(int(n.sum()) + 1, np.int64)
    np.add.at(copies, at, parts["copies"].astype(np.int64))
    np.add.at(copies, at + mine, -parts["copies"].astype(np.int64))
    cls, stand = scheme.classes(list(number), np.cumsum(copies[:-1]))
    offset = np.arange(mine.sum()) - np.repeat(before, mine)
    which = cls[np.repeat(at, mine) + offset]
    gone = repeated = stand[which] > 1
    if scheme.keep_first:
        doc = np.unique(np.stack([parts["doc"], parts["sub"]], 1), axis=0, return_inverse=True)[1].ravel()
        place = np.repeat(doc.astype(np.int64) << 32 | parts["start"].astype(np.int64), mine) + offset
        least = np.full(len(stand), np.iinfo(np.int64).max)
        np.minimum.at(least, which, place)
        gone = repeated & (place != least[which])
    part = np.repeat(np.arange(len(parts)), mine)
    out = []
    for going, to_first in ((gone, True), (repeated & (parts["copies"] > 1)[part], False)):
        hit = np.flatnonzero(going)
        head = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (part[hit[1:]] != part[hit[:-1]]))) if len(hit) else hit
        p, count = parts[part[hit[head]]], np.diff(np.append(head, len(hit)))
        columns = np.ascontiguousarray(p["anchor"]).view(np.int64), np.ascontiguousarray(p["content"]).view(np.int64)
        out.append((*columns, (p["offset"] + offset[hit[head]]).astype(np.int32), count.astype(np.int32), np.full(len(p), to_first)))
    return tuple(np.concatenate(c) for c in zip(*out))


def common_cells(docs: DataFrame, rows: int, scheme: Scheme) -> np.ndarray:
    """Cells of the runs of symbols, as long as anchors and stretches, that stand often in a bounded sample of documents."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    chosen = docs.filter(F.pmod(F.xxhash64("id", "sub", F.lit(42)), F.lit(1_000_000)) < int(share * 1_000_000))

    def repeats(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in (scheme.anchor, scheme.stretch):
            grams = np.concatenate([np.zeros(0, np.uint64), *(gram_hashes(x, k) for x in held if len(x) >= k)])
            grams.sort()
            head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
            n = np.diff(np.append(head, len(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(grams[head[n > 1]].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(2):
                held.append(scheme.symbols(text.as_py() or b""))
                size += len(held[-1])
                if size > COUNTED:
                    yield from repeats(held)
                    held, size = [], 0
        yield from repeats(held)

    counts = chosen.select("id", "sub", F.col("text").cast("binary").alias("text")).mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") > max(4, int(COMMON_SHARE * min(rows, SAMPLE_ROWS)))).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    cells = NONE_COMMON.copy()
    cells[(often.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)] = 1
    return cells


def repeated_spans(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``docs`` (id, sub, text, copies) to (doc, doc_sub, start, windows): all windows to remove, in runs."""
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    n = 1 + total // BUCKET_BYTES
    cells = docs.sparkSession.sparkContext.broadcast(common_cells(docs, rows, scheme))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(sized(batches, 2, SENT_BYTES)):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            r = cut(keys, (t.as_py() or b"" for t in batch.column(2)), scheme, cells.value)
            sent, others = represent(r)
            names, blocks = _packed(sent, _buckets(sent["anchor"], n))
            if len(others):  # these only pass through, so they go anywhere
                names.append(-1 - int((others["doc"][0] * 31 + k) % n))
                blocks.append(_packed(others, np.zeros(len(others), np.int64))[1][0])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def meet(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.zeros(0, RECORD), *(unpacked(b.as_py(), RECORD) for b in table.column("block"))])
        if table.column("bucket")[0].as_py() < 0:
            return _spans(r, False)
        first, others = represent(r)
        _, of = np.unique(first["anchor"], return_inverse=True)
        asked = (np.bincount(of, first["copies"]) > 1)[of] if len(first) else np.zeros(0, bool)
        alone = (np.bincount(of) == 1)[of] if len(first) else asked
        return pa.concat_tables([_spans(others, False), _spans(first[asked], True, alone[asked])])

    sent = docs.select("id", "sub", F.col("text").cast("binary").alias("text")).mapInArrow(send, "bucket bigint, block binary")
    spans = materialize(sent.groupBy("bucket").applyInArrow(meet, SPAN_SCHEMA), "spans")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked in _requests(batch, scheme):
                yield _asked(*(_joined(*a) if alone else _split(*a, scheme, cells.value) for alone, a in asked.items()), n=n * SOLVE_SPLIT)

    size = scheme.symbols(b"").itemsize

    def solve(table: pa.Table) -> pa.Table:
        records, pieces = [], []
        for block, content in zip(table.column("block"), table.column("content")):
            r = unpacked(block.as_py(), PART)
            records.append(r)
            head = np.flatnonzero(r["joined"] == 0)
            ends = np.cumsum((np.add.reduceat(r["windows"].astype(np.int64), head) + scheme.window - 1) * size).tolist()
            raw = pa.decompress(content.as_py(), ends[-1], "zstd", asbytes=True)
            pieces += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        found = [decide(*x, scheme) for x in sliced(np.concatenate(records), pieces)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, bool)]
        return pa.table(dict(zip((c.split()[0] for c in FOUND_SCHEMA.split(", ")), map(pa.array, columns))))

    wanted = spans.filter("first").groupBy("doc", F.col("sub").alias("doc_sub")).agg(F.sort_array(F.collect_list(F.struct("start", "windows", "anchor", "content", "copies", "alone"))).alias("asked"))
    cut_out = docs.join(wanted, (F.col("id") == F.col("doc")) & (F.col("sub") == F.col("doc_sub"))).select("id", "sub", F.col("text").cast("binary").alias("text"), "asked")
    found = cut_out.mapInArrow(ask, "bucket bigint, block binary, content binary").groupBy("bucket").applyInArrow(solve, FOUND_SCHEMA)
    hit = spans.join(found, ["anchor", "content"]).filter(F.col("first") == F.col("to_first"))
    return hit.select("doc", F.col("sub").alias("doc_sub"), (F.col("start") + F.col("offset")).alias("start"), F.col("n").alias("windows"))


def _requests(batch: pa.RecordBatch, scheme: Scheme) -> Iterator[dict[bool, tuple[np.ndarray, list[np.ndarray]]]]:
    """What is asked for in texts (id, sub, text, asked), in groups of about ASKED_BYTES: PART records and their symbols, apart for contents that are alone under their anchor."""
    rows, parts, held = {True: [], False: []}, {True: [], False: []}, 0

    def group() -> dict[bool, tuple[np.ndarray, list[np.ndarray]]]:
        return {k: (np.array(rows[k], PART), parts[k]) for k in rows if rows[k]}

    for doc, sub, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
        x = scheme.symbols(text.as_py() or b"")
        for q in asked.as_py():
            part = x[q["start"] : q["start"] + q["windows"] + scheme.window - 1]
            rows[q["alone"]].append((0, q["anchor"] & (1 << 64) - 1, q["content"] & (1 << 64) - 1, doc, sub, q["start"], 0, q["windows"], q["copies"], 0))
            parts[q["alone"]].append(part)
            held += part.nbytes
        if held > ASKED_BYTES:
            yield group()
            rows, parts, held = {True: [], False: []}, {True: [], False: []}, 0
    if held:
        yield group()


def _joined(r: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Runs that follow each other in a text become pieces; no other content has their anchors, so they may go anywhere."""
    follows = np.append(False, (r["doc"][1:] == r["doc"][:-1]) & (r["sub"][1:] == r["sub"][:-1]) & (r["start"][1:] == r["start"][:-1] + r["windows"][:-1]))
    r["joined"] = follows & (np.arange(len(r)) % (SLICE >> 8) > 0)
    of = np.cumsum(r["joined"] == 0) - 1
    r["stretch"] = r["anchor"][r["joined"] == 0][of]
    pieces = [[] for _ in range(int(of[-1]) + 1)]
    for i, joined, n, part in zip(of.tolist(), r["joined"].tolist(), r["windows"].tolist(), parts):
        pieces[i].append(part[len(part) - n :] if joined else part)
    return r, [np.concatenate(p).tobytes() for p in pieces]


def _split(r: np.ndarray, parts: list[np.ndarray], scheme: Scheme, common: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each run in parts, by the stretches of its windows."""
    x, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    stretch, start, count = runs(x, bounds, scheme.window, scheme.stretch, common)
    of = np.searchsorted(bounds, start, "right") - 1
    out = r[of]
    offset = start - bounds[of]
    out["stretch"], out["offset"], out["windows"] = stretch, offset, count
    out["start"] += offset.astype(np.uint32)
    raw, size = memoryview(x).cast("B"), x.itemsize
    return out, [bytes(raw[a:b]) for a, b in zip((start * size).tolist(), ((start + count + scheme.window - 1) * size).tolist())]


def _asked(*found: tuple[np.ndarray, list[bytes]], n: int) -> pa.RecordBatch:
    """Parts and their pieces in blocks, one per bucket of stretches."""
    r, pieces = np.concatenate([f[0] for f in found]), [p for f in found for p in f[1]]
    head = r["joined"] == 0
    of = np.cumsum(head) - 1
    bucket = _buckets(r["stretch"][head], n)
    order = np.argsort(bucket, kind="stable")
    keys, at = np.unique(bucket[order], return_index=True)
    records = np.argsort(bucket[of], kind="stable")
    blocks = np.split(r[records], np.flatnonzero(np.diff(bucket[of][records])) + 1)
    contents = [pa.compress(b"".join(pieces[i] for i in mine.tolist()), "zstd", asbytes=True) for mine in np.split(order, at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([_packed(b, np.zeros(len(b), np.int64))[1][0] for b in blocks], pa.binary()), pa.array(contents, pa.binary())], names=["bucket", "block", "content"])


def covered(spans: list[tuple[int, int]], length: int, window: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols under the windows that start in ``spans`` (start, windows), within a document's length."""
    out: list[tuple[int, int]] = []
    for start, count in sorted(spans):
        stop = min(length, start + count + window - 1)
        if start >= stop:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def apply_spans(docs: DataFrame, spans: DataFrame, schema: str, row: Callable[[bytes, list[tuple[int, int]], int], list[tuple]]) -> DataFrame:
    """(id, and what ``row`` makes of each text, the windows to remove and the number of its copies) for all ``docs``."""
    mine = spans.groupBy("doc", "doc_sub").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    # Types are given, since a batch in which no text has a span would have lists of nulls.
    made_of = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, OUT_BYTES):
            ids, out = [], []
            for i, text, spans_, copies in zip(*(batch.column(k) for k in range(4))):
                made = row(text.as_py() or b"", [(s["start"], s["windows"]) for s in spans_.as_py() or ()], copies.as_py())
                ids += [i.as_py()] * len(made)
                out += made
            if ids:
                columns = [ids, *zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made_of)], schema=made_of)

    joined = docs.join(mine, (F.col("id") == F.col("doc")) & (F.col("sub") == F.col("doc_sub")), "left")
    return joined.select("id", F.col("text").cast("binary").alias("text"), "spans", "copies").mapInArrow(run, schema)
