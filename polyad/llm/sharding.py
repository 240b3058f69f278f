"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into blocks by a hash. How many rows of each block go to each shard is drawn at once, on the driver, from
the multivariate hypergeometric distribution that a uniform permutation of all rows would give; the matrix has at most
``MAX_BLOCKS`` rows. Each block permutes its rows by a random key, deals them out by the matrix, and each shard permutes
what it got. A shard is permuted in cells, again by a hash, so that no task ever holds a whole shard.

Every random choice is a hash of the row and a seed, so a task that runs again deals the same rows to the same places.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from polyad.llm.common import as_struct, from_struct, without

#: Mean rows of a block, as long as there are fewer than MAX_BLOCKS of them.
BLOCK_ROWS = 512
MAX_BLOCKS = 65_536
ADDED = ("shard", "slot")


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn without replacement from good + bad; beyond numpy's 10**9 by inversion, exact up to rounding of doubles."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    # Chances relative to the mode's, 14 standard deviations to either side of it; what is left out is below 1e-40.
    total = good + bad
    reach = int(14 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 64
    k = np.arange(mode, min(high, mode + reach), dtype=float)
    up = np.cumprod((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)))
    k = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    down = np.cumprod(k * (bad - n + k) / ((good - k + 1) * (n - k + 1)))
    chances = np.concatenate([down[::-1], [1.0], up])
    return mode - len(down) + int(np.searchsorted(np.cumsum(chances), rng.random() * chances.sum(), "right"))


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows per block and shard with these margins, distributed as under a uniform permutation of all rows."""
    rng, left, out = np.random.default_rng(seed), list(shard_sizes), []
    for size in block_sizes:
        row, rest, total = [], size, sum(left)
        for j, have in enumerate(left):
            total -= have
            row.append(_hypergeometric(rng, have, total, rest))
            rest -= row[-1]
            left[j] -= row[-1]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def uniform_shards(df: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The order over shards and slots is a uniform random permutation, and shard sizes differ by one at most. The random
    keys come from all columns but maps and variants, so rows that tie are equal in all of them, and a task that runs again
    deals the same rows. Nulls hash like any value. Equal rows fall into one block and each gets a slot of its own. An empty
    table gives an empty result. Input columns named shard or slot, in any case, are replaced; any other names are kept.
    """
    spark, names = df.sparkSession, without(df, *ADDED).columns
    hashed = [f.name for f in df.schema if f.name in names and not isinstance(f.dataType, (T.MapType, T.VariantType))]

    def key(salt: int) -> Column:
        return F.xxhash64(F.lit(seed * 4 + salt), *[F.col(f"`{c}`") for c in hashed])

    rows = df.count()
    blocks = max(1, min(MAX_BLOCKS, rows // BLOCK_ROWS))
    cells = max(1, min(MAX_BLOCKS // shards, rows // (shards * BLOCK_ROWS)))
    keyed = df.select(as_struct(df, *ADDED).alias("row"), F.pmod(key(0), F.lit(blocks)).cast("int").alias("block"), key(1).alias("k1"), key(2).alias("k2"), F.pmod(key(3), F.lit(cells)).cast("int").alias("cell"))
    have = sorted((r[0], r[1]) for r in keyed.groupBy("block").count().collect())
    matrix = communication_matrix([n for _, n in have], shard_sizes(rows, shards), random.Random(seed).getrandbits(63))
    plan = spark.createDataFrame([(b, np.cumsum(row)[:-1].tolist()) for (b, _), row in zip(have, matrix)], "of int, cuts array<bigint>")
    local = Window.partitionBy("block").orderBy("k1", "k2")
    dealt = (
        keyed.withColumn("rank", F.row_number().over(local))
        .join(F.broadcast(plan), F.col("block") == F.col("of"))
        .select("row", "k2", "k1", "cell", F.size(F.filter("cuts", lambda c: c < F.col("rank"))).cast("int").alias("shard"))
    )
    sizes = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "cell").orderBy("k2", "k1")
    slotted = dealt.withColumn("rank", F.row_number().over(again)).join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
    return from_struct(slotted, "row", names, F.col("shard"), (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
