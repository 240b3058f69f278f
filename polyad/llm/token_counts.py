"""Token counts through a cache keyed by the digests of normalised content and of the tokenizer.

A text's digest joins stored counts. Texts without one are shuffled by digest, one of each is encoded by the tokenizer's
own library, and the new counts are appended to the cache as Parquet, by tokenizer. Counts then join the rows by digest, so
that texts move at most once and repeated texts are encoded once, in this run and in all later ones.

Where a tokenizer file says that pieces between words are tokenized one by one, the library encodes each different piece
once, as long as a worker remembers it, and a text has the sum over its pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from polyad.llm.common import as_struct, bound_batches, from_struct, materialize, without

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
#: Runs of white space (Unicode's White_Space) that aren't one space already; its first character rules out most places.
BLANK = r"(?U)\s(?:(?<! )|(?=\s))\s*"
#: Characters of the texts that the library encodes at a time; its encodings take some hundred times as many bytes.
GROUP_CHARS = 1 << 16
#: Pieces that the library encodes at a time; it takes twice as long a piece where thousands are put together.
PIECES = 100
#: Characters of the pieces whose counts a worker remembers; some 100 bytes each piece.
MEMO_CHARS = 1 << 22
#: What a tokenizer file has to say for its pieces to be taken one by one: no match of the pattern holds white space or depends
#: on what stands around it, and nothing else sees more than a piece.
PIECE_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: That pattern over lower-case Latin-1, which NFC leaves as it is: letters, numbers, and what is neither nor white space.
_L, _N = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"[{_L}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|[^\t-\r \x85\xa0{_L}{_N}]+")
ADDED = ("n_bytes", "n_tokens", "over_limit")


def tokenizer_digest(path: str) -> str:
    """Names the version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        return piecewise(tok, special) if (special := special_strings(json.load(f))) is not None else lambda texts: _encoded(tok, texts)


def _encoded(tok, texts: list[str]) -> list[int]:
    return [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def special_strings(rules: dict) -> list[str] | None:
    """The strings that a tokenizer file has as tokens of their own, if it tokenizes pieces one by one; else None."""
    model, added = rules["model"], rules.get("added_tokens") or []
    one_by_one = all(rules.get(k) == v for k, v in PIECE_RULES.items()) and model.get("type") == "BPE" and not model.get("dropout")
    return [x["content"] for x in added] if one_by_one and not any(x["normalized"] for x in added) else None


def pieces_of(text: str) -> tuple[list[str], str]:
    """The pieces of a text, and its words that have to be encoded as they are: outside Latin-1 those that aren't ASCII."""
    rest = ""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            words = text.split(" ")
            text, rest = " ".join(x for x in words if x.isascii()), " ".join(x for x in words if not x.isascii())
    return PIECE.findall(text.lower()), rest


def piecewise(tok, special: list[str]) -> Callable[[list[str]], list[int]]:
    """Counts of texts as sums over their pieces. Texts with a special string are encoded whole, and those put together of pieces that hardly repeat."""
    known: dict[str, int] = {}
    held = 0

    def count(texts: list[str]) -> list[int]:
        nonlocal held
        split = [([], x) if any(s in x for s in special) else pieces_of(x) for x in texts]
        new = list(set().union(*(x for x, _ in split)).difference(known))
        if held > MEMO_CHARS >> 4 and 2 * len(new) > sum(len(x) for x, _ in split):
            return _encoded(tok, texts)  # pieces that hardly repeat aren't worth it
        for at in range(0, len(new), PIECES):
            part = new[at : at + PIECES]
            n = Counter(tok.encode(" ".join(part), add_special_tokens=False).word_ids)
            # A piece without any token would shift the numbers of those after it.
            known.update(zip(part, [n[k] for k in range(len(part))] if n.keys() == set(range(len(part))) else _encoded(tok, part), strict=True))
        held += sum(map(len, new))
        rest = iter(_encoded(tok, [x for _, x in split if x]))
        counts = [sum(map(known.__getitem__, x)) + (next(rest) if r else 0) for x, r in split]
        if held > MEMO_CHARS:
            known.clear()
            held = 0
        return counts

    return count


def normalised(text: Column, blank_runs_count: bool) -> Column:
    """The content that decides the count. Where blanks only separate, runs of them become one space."""
    text = F.coalesce(text, F.lit(""))
    return text if blank_runs_count else F.btrim(F.regexp_replace(text, BLANK, " "))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer version; None if there is no cache yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).select(F.col("digest").alias("of"), "n_tokens")
    except AnalysisException:
        return None


def count_tokens(df: DataFrame, path: str, cache: str, text_col: str = "text", limit: int = 2048, blank_runs_count: bool = True) -> DataFrame:
    """``df`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    ``path`` is a tokenizer file that driver and executors have; ``cache`` a folder that they share, made where absent. It
    may be used by several tokenizers and by runs at a time, and outlives the run. Set ``blank_runs_count`` to False for
    tokenizers that turn runs of white space into separators and drop them.
    Null texts count as empty, with no bytes and tokens. Repeated rows stay repeated. An empty table gives an empty
    result. Input columns named like the added ones, in any case, are replaced; any other names are kept.
    """
    spark, version = df.sparkSession, tokenizer_digest(path)
    names = without(df, *ADDED, text_col).columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(as_struct(df, *ADDED, text_col).alias("row"), F.octet_length(text).cast("long").alias("bytes"), normalised(text, blank_runs_count).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    # Repeated texts fall together before the shuffle; a digest that is stored needs no encoding.
    misses = rows.groupBy("digest").agg(F.first("content").alias("content"))
    known = stored(spark, cache, version)
    if known is not None:
        misses = misses.join(known.select("of"), F.col("digest") == F.col("of"), "left_anti")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            counts, group, size = [], [], 0
            for text in batch.column(1):
                group.append(text.as_py())
                size += len(group[-1])
                if size > GROUP_CHARS:
                    counts, group, size = counts + count(group), [], 0
            counts += count(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    bound_batches(spark)
    misses.select("digest", "content").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    base = materialize(rows.select("row", "bytes", "digest"), "token-rows")
    # Two runs that append at a time may store a digest twice, with one count. Counts are written, one per digest of these
    # rows, so that the join below reads two plain tables and the rows of a frequent digest can be split.
    of = stored(spark, cache, version).join(base.select("digest").distinct(), F.col("of") == F.col("digest"), "left_semi")
    counts = materialize(of.groupBy("of").agg(F.max("n_tokens").alias("tokens")), "token-counts")
    return from_struct(base.join(counts, F.col("digest") == F.col("of")), "row", names, F.col("bytes").alias("n_bytes"), F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))
