"""Byte-level BPE as a streaming transducer with bounded lookahead, and incremental decoding.

A text goes through in chunks. A scanner cuts pretokens and passes on those that no later character can change. A pretoken
that fits a window is merged at once; a longer run streams through windows. A token in a window is final when it ends at
least ``lookahead`` bytes before the window's end. That number comes from the merge list: whether a token takes part in a
merge to its right depends on the right part being there, which depends on merges of lower rank further right, and so on
along strictly falling ranks, so the longest such chain, in bytes, suffices. Memory is bounded by the window and chunk.
"""

from __future__ import annotations

import codecs
import heapq
import json
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyad.llm.common import as_struct, bound_batches, from_struct, sized, without

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Classes whose runs can be longer than any buffer.
RUNS = tuple(regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"[{SPACE}]+"))
CHUNK = 1 << 16
LONG_RUN = 1 << 12
MEMO_WORDS = 1 << 18
ADDED = ("n_tokens", "ids", "decoded")


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: visible Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """Merges, vocabulary and special strings of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_chars()
        for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"):
            if model.get(k):
                raise ValueError(f"{path}: {k} isn't handled")
        before, after = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or after.get("type") != "ByteLevel":
            raise ValueError(f"{path}: only byte-level BPE without a normalizer is handled")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: this pre_tokenizer isn't handled")
        for t in spec.get("added_tokens", []):
            if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"{path}: added token {t['content']!r} has a flag that isn't handled")
        ids = model["vocab"]
        self.table: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in ids.items()}
        self.first = [0] * 256
        for i, b in self.table.items():
            if len(b) == 1:
                self.first[b[0]] = i
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table |= {i: t.encode() for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [new for _, new in self.merges.values()]  # by rank
        self.lookahead = self._lookahead()
        self.longest = max(map(len, self.table.values()))

    def _lookahead(self) -> int:
        """Bytes to the right of a token that settle whether it is final."""
        reach: dict[int, int] = {}  # by left part: the longest chain over merges seen so far
        inside: dict[int, int] = {}  # by token: the longest chain that could have stopped its right parts from joining
        for (a, b), (_, token) in self.merges.items():
            chain_ = max(reach.get(b, 0), inside.get(b, 0))
            inside[token] = max(inside.get(token, 0), chain_)
            reach[a] = max(reach.get(a, 0), len(self.table[b]) + chain_)
        return max([0, *reach.values(), *inside.values()])

    def merge(self, data: bytes) -> list[int]:
        """The token ids of one piece of bytes: the merge of lowest rank first, leftmost first."""
        ids = [self.first[b] for b in data]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        if n < 64:
            rank, made, never = self.ranks.get, self.made, len(self.made)
            ranks = [rank(pair, never) for pair in zip(ids, ids[1:])]
            while ranks and (m := min(ranks)) < never:
                i = ranks.index(m)
                ids[i : i + 2] = (made[m],)
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((ids[i - 1], ids[i]), never)
                if i < len(ranks):
                    ranks[i] = rank((ids[i], ids[i + 1]), never)
            return ids
        after, before, heap = [*range(1, n), -1], list(range(-1, n - 1)), []
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if a.itemsize != 4:
        raise RuntimeError("no 32-bit array type")
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class _Memo(dict):
    """Packed ids by pretoken; emptied when full."""

    def __init__(self, merges: MergeList, window: int) -> None:
        super().__init__()
        self.merges, self.window = merges, window

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        if len(data) > self.window:
            run = _Run(self.merges, self.window)
            return b"".join([run.feed(data), run.finish()])
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = packed(self.merges.merge(data))
        return out


class _Run:
    """One pretoken of any length, fed in pieces; each call returns the ids that became final."""

    def __init__(self, merges: MergeList, window: int) -> None:
        self.merges, self.window, self.rest = merges, window, b""

    def feed(self, data: bytes) -> bytes:
        out, at, merges = [], 0, self.merges
        data = self.rest + data
        while len(data) - at > self.window:
            piece, end = data[at : at + self.window], 0
            for i in merges.merge(piece):
                n = len(merges.table[i])
                if end + n > self.window - merges.lookahead:
                    break
                end += n
                out.append(i)
            at += end
        self.rest = data[at:]
        return packed(out)

    def finish(self) -> bytes:
        return packed(self.merges.merge(self.rest))


class Encoder:
    """Encodes one text after another: ``feed`` chunks, then ``finish``; both return packed ids."""

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges
        self.window = 2 * merges.lookahead + 4 * merges.longest + 256
        self.memo = _Memo(merges, self.window)
        self.find = regex.compile(PRETOKEN).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        #: A match that ends so many characters before the buffer's end can't change, nor be part of a special string.
        self.hold = max([4, *(len(s) + 1 for s in merges.special)])
        self.tail, self.run, self.kind = "", None, None

    def feed(self, chunk: str) -> bytes:
        return self._scan(self.tail + chunk, False)

    def finish(self, chunk: str = "") -> bytes:
        return self._scan(self.tail + chunk, True)

    def _scan(self, text: str, final: bool) -> bytes:
        out = []
        while self.specials and (m := self.specials.search(text)):
            out += [self._segment(text[: m.start()], True), packed([self.merges.special[m[0]]])]
            text = text[m.end() :]
        out.append(self._segment(text, final))
        return b"".join(out)

    def _segment(self, text: str, final: bool) -> bytes:
        out = []
        if self.run:
            text = self._continue(text, final, out)
            if self.run:
                self.tail = text
                return b"".join(out)
        words = self.find(text)
        if final:
            self.tail = ""
        else:
            rest = 0
            while words and rest < self.hold:
                rest += len(words.pop())
            self.tail = text[len(text) - rest :] if rest else ""
        out += map(self.memo.__getitem__, words)
        if len(self.tail) > LONG_RUN and not final:
            lead = self.tail[0] == " " and len(self.tail) > 1 and not RUNS[3].match(self.tail[1])
            for kind in RUNS:
                m = kind.match(self.tail, int(lead))
                if m and m.end() > len(self.tail) - self.hold:  # one open run
                    self.run, self.kind = _Run(self.merges, self.window), kind
                    if lead:
                        out.append(self.run.feed(b" "))
                    self.tail = self._continue(self.tail[int(lead) :], False, out)
                    break
        return b"".join(out)

    def _continue(self, text: str, final: bool, out: list[bytes]) -> str:
        """Feed the open run from the text's front; what is left of the text."""
        m = self.kind.match(text)
        end, blank = m.end() if m else 0, self.kind is RUNS[3]
        if not final and end > len(text) - self.hold:  # still open
            keep = max(0, min(end, len(text) - self.hold))
            out.append(self.run.feed(text[:keep].encode()))
            return text[keep:]
        if blank and end < len(text):  # the last blank goes with what follows
            end -= 1
        out += [self.run.feed(text[:end].encode()), self.run.finish()]
        self.run = self.kind = None
        return text[end:]

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text, in chunks."""
        if len(text) <= CHUNK:
            return self.finish(text)
        return b"".join([*(self.feed(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)), self.finish()])


class Decoder:
    """Ids to text, piece by piece: between pieces only the bytes of an unfinished character are held."""

    def __init__(self, merges: MergeList) -> None:
        self.table, self.state = merges.table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed_ids: bytes, final: bool = False) -> str:
        a = array("I")
        a.frombytes(packed_ids)
        return self.state.decode(b"".join(map(self.table.__getitem__, a)), final)

    def decode(self, packed_ids: bytes) -> str:
        """The text of a whole sequence; undecodable bytes give replacement characters."""
        step = 4 * CHUNK
        out = "".join(chain((self.feed(packed_ids[i : i + step]) for i in range(0, len(packed_ids), step)), (self.feed(b"", True),)))
        self.state.reset()
        return out


@lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    return Encoder(MergeList(path))


def encode_decode(df: DataFrame, path: str, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """``df`` with ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit) and ``decoded`` string.

    ``path`` is a byte-level BPE file that every executor has. Special strings in a text become their special ids. A null
    text counts as empty; an empty one has no ids; an empty table gives an empty result. Texts of any length are encoded
    whole. Repeated rows stay repeated, each coded alike. Input columns named like the added ones, in any case, are
    replaced; any other names are kept.
    """
    bound_batches(df.sparkSession)
    names = without(df, *ADDED).columns
    rows = df.select(as_struct(df, *ADDED).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        decoder = Decoder(encoder.merges)
        for part in sized(batches, 1, batch_bytes):
            ids = [encoder.encode(t.as_py()) for t in part.column(1)]
            texts = [decoder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["row", *ADDED])

    return from_struct(rows.mapInArrow(run, schema), "row", names, *map(F.col, ADDED))
