"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.session import BATCH_BYTES, bound_batches
from polyad.sources.scratch import delete, materialize, new_path, release, scope, shared_dir

__all__ = ["BATCH_BYTES", "NULL_ID", "as_struct", "ascii_blank", "bound_batches", "delete", "distinct_rows", "from_struct", "given_back", "id_back", "id_of", "materialize", "new_path", "read_table", "release", "scope", "shared_dir", "sized", "sub_of", "without"]

#: Null ids take this value inside an operator, so they sort first, and turn null again in its result.
NULL_ID = -(2**63)


def given_back(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back: workers live on, and what one stage left would count in the next."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def sized(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``limit`` bytes of this binary or string column at most; none is empty."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            stop = min(batch.num_rows, max(stop, at + 1))
            yield batch.slice(at, stop - at)
            at = stop


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names clash, in any case, with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def as_struct(df: DataFrame, *leave_out: str) -> Column:
    """The columns of ``df`` but these, in any case, as one struct, so that an operator's own columns can't clash with them."""
    kept = without(df, *leave_out).columns
    return F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).alias("__none"))


def from_struct(df: DataFrame, row: str, names: list[str], *added: Column) -> DataFrame:
    """The columns ``names`` of the struct ``row``, and then the added ones."""
    return df.select(*[F.col(row)[c].alias(c) for c in names], *added)


def id_of(name: str) -> Column:
    """The id as a long, null as ``NULL_ID``."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def ascii_blank() -> str:
    """The six ASCII white-space characters, as the class ``[\\x20\\x09-\\x0D]`` has them."""
    return " \t\n\x0b\x0c\r"


def distinct_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sub, text, copies): one row for the rows of one id and text. ``sub`` is 0, unless ids repeat; then it goes by the text.

    Where no id repeats, which is looked up first, no text moves.
    """
    rows = df.select(id_of(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # Zero, and never null: a literal would be lost as a key of joins by (id, sub) on one side only, and nulls would be
        # filtered below one shuffle of the texts and not below the other, which then couldn't be the same one.
        return rows.select("id", F.coalesce(F.pmod("id", F.lit(1)).cast("long"), F.lit(0).cast("long")).alias("sub"), "text", F.lit(1).cast("long").alias("copies"))
    once = rows.withColumn("digest", F.sha2("text", 256)).groupBy("id", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return materialize(once.select("id", sub_of("text").alias("sub"), "text", "copies"), "distinct-rows")


def sub_of(text: str) -> Column:
    """What tells texts of one id apart: the first 60 bits of the digest."""
    return F.conv(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
