"""Exact duplicates by digest, with frequent digests split off.

Misra-Gries counters (``freqItems``) give at most 1/support candidate digests that hold every digest with more than
``support`` of the rows. Their groups are counted exactly, and the verified ones travel as a broadcast of at most
1/support rows, so their rows never move. The other digests, each with a bounded share of the rows, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyad.llm.common import as_struct, ascii_blank, from_struct, id_back, id_of, materialize

#: A digest with more than this share of the rows is split off; 1/SUPPORT bounds the broadcast rows.
SUPPORT = 1e-3


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_blank(), "")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Decision for every row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without ASCII white space. The row with most code points in its original
    text stays, then the one with the smallest id. A null text counts as empty, so null and blank texts form one group;
    a null id sorts before all others. Rows that repeat an id and its text tie: each is counted in ``group_size`` and
    all have the same ``kept``. An empty table gives an empty result; further columns are ignored, whatever their names.
    """
    base = materialize(
        df.select(
            id_of(id_col).alias("id"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        ),
        "exact-base",
    )
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("id").alias("keep"))).alias("best")
    frequent = base.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    rows = base.agg(F.count(F.lit(1)).alias("rows"))
    heavy = materialize(
        base.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("size"), best)
        .join(F.broadcast(rows), F.col("size") > F.col("rows") * F.lit(support))
        .select("digest", "size", "best"),
        "exact-heavy",
    )
    rest = base.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # Aggregated before the shuffle and written, so that the join reads two plain tables and a large group can be split.
    light = materialize(rest.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), best), "exact-light")
    joined = rest.join(light, "digest").select("id", "digest", "size", "best")
    split = base.join(F.broadcast(heavy), "digest").select("id", "digest", "size", "best")
    return (
        joined.unionByName(split)
        .select("id", F.col("best.keep").alias("keep"), "size", "digest")
        .select(
            id_back("id").alias(id_col),
            id_back("keep").alias("keep_id"),
            F.col("size").alias("group_size"),
            (F.col("id") == F.col("keep")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The kept rows with all their columns, whatever their names. Rows that repeat a kept id and text all stay; of rows that repeat an id with other texts, each goes or stays by its own text."""
    found = exact_duplicates(df, id_col, text_col, support)
    dropped = found.filter(~F.col("kept")).select(id_of(id_col).alias("gone"), "text_sha256")
    rows = df.select(as_struct(df).alias("row"), id_of(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    stay = rows.join(dropped, (F.col("id") == F.col("gone")) & (F.col("digest") == F.col("text_sha256")), "left_anti")
    return from_struct(stay, "row", df.columns)
