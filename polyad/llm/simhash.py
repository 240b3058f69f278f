"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector of radius + 1 bits. A table stands for each nonzero vector v; its mask keeps the
bits whose vector has an odd product with v. For any ``radius`` bits some v is even with all of their vectors, so two
fingerprints that differ in those bits alone agree under that mask: every pair within the radius meets in some table.
Equal fingerprints are collapsed first. Small buckets compare their members; a bucket of any larger size links members
that agree once ``radius`` of its free bits are left out, which is exact and makes a fixed number of rows per member.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.llm.common import as_struct, bound_batches, distinct_rows, from_struct, given_back, id_back, id_of, materialize, sub_of
from polyad.operators.components import components
from polyad.operators.numbering import numbered

BITS = 64
#: Buckets up to this size compare all members; larger ones link by left-out bits.
SMALL = 32
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` lower-cased words, joined by one space; of the whole sequence if there are fewer."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id long, fp long): the SimHash of every whole text, as a signed long. Null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", words)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    bound_batches(df.sparkSession)
    return df.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(given_back(run), "id bigint, fp bigint")


def covering_masks(radius: int) -> list[int]:
    """The 2**(radius + 1) - 1 masks; bits take the nonzero vectors in turn."""
    vectors = [1 + b % (2 ** (radius + 1) - 1) for b in range(BITS)]
    return [sum(1 << b for b, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct`` (fp, rep), one row per fingerprint, to edges (u, v) between reps: all pairs of small buckets within the radius, and enough of large ones to connect what is within it."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)])
    keyed = distinct.select("fp", "rep", F.explode(tables).alias("b")).select("b.t", "b.k", "fp", "rep")
    sizes = materialize(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-sizes")
    shared = materialize(keyed.join(sizes, ["t", "k"]), "buckets")
    small = (
        shared.filter(F.col("n") <= SMALL)
        .groupBy("t", "k")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
        .select(
            F.explode(
                F.flatten(
                    F.transform(
                        "m",
                        lambda a, i: F.transform(
                            F.filter(F.slice("m", i + 2, F.size("m")), lambda b: F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= radius),
                            lambda b: F.struct(a["rep"].alias("u"), b["rep"].alias("v")),
                        ),
                    )
                )
            ).alias("e")
        )
        .select("e.u", "e.v")
    )
    # Fingerprints that agree once the same radius free bits are left out: at most 2**radius in a group.
    left_out = [
        (t, signed(~sum(1 << b for b in c) & (1 << BITS) - 1))
        for t, m in enumerate(masks)
        for c in combinations([b for b in range(BITS) if not m >> b & 1], radius)
    ]
    out_of = distinct.sparkSession.createDataFrame(
        [(t, [k for of, k in left_out if of == t]) for t in range(len(masks))], "t int, keeps array<bigint>"
    )
    large = (
        shared.filter(F.col("n") > SMALL)
        .join(F.broadcast(out_of), "t")
        .select("fp", "rep", F.explode("keeps").alias("keep"))
        .groupBy("keep", F.col("fp").bitwiseAND(F.col("keep")).alias("rest"))
        .agg(F.collect_set("rep").alias("reps"))
        .filter(F.size("reps") > 1)
        .select(F.array_min("reps").alias("u"), F.explode("reps").alias("v"))
    )
    return small.unionByName(large).filter("u <> v")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``df``: ``id_col, fingerprint`` (16 hex digits), ``component_id``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest id reachable over
    links. Null, empty and blank texts have the fingerprint zero and are linked like any others. Rows with one id share a
    component only where their fingerprints are linked; a null id sorts before all others. An empty table gives an empty
    result; further columns are ignored.
    """
    fps = materialize(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprints-distinct")
    # Ids may repeat, so nodes are fingerprints; the component's smallest id follows from its members.
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    of = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = materialize(of.groupBy("c").agg(F.min("rep").alias("component_id")), "component-min")
    of = materialize(of.join(least, "c").select("fp", "component_id"), "fingerprint-component")
    return fps.join(of, "fp").select(id_back("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_back("component_id").alias("component_id"))


#: Share of the texts, and least number of them, whose shingles are counted to find common ones; most common ones kept on the driver.
SAMPLE_SHARE, SAMPLE_ROWS = 0.02, 5_000
COMMON = 200_000


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of shingles that many texts (id, text) of a sample hold, and in how many."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(1, texts.count())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x.as_buffer().to_pybytes(), words)).view(np.int64))], names=["t"])

    chosen = texts.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(10_000)) < int(share * 10_000)).select("text")
    often = chosen.mapInArrow(given_back(run), "t bigint").groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(2, int(SMALL * share)))
    rows = often.orderBy(F.desc("n"), "t").limit(COMMON).toArrow()
    t, n = rows.column("t").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(t)
    return t[order], n[order]


def prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(t, id, n, pos): the first shingles of every text (id, text) in one order for all texts, as many as any similar text must share one of.

    Common shingles come last and the others go by hash. Which ones count as common changes the work, never the result.
    """
    common, times = common_shingles(texts, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1)):
                s = np.unique(shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", words))
                if not len(s):
                    continue
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, times[at], 0), kind="stable")]
                first = s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(np.full(k, i.as_py(), np.int64)), pa.array(np.full(k, len(s), np.int32)), pa.array(np.arange(k, dtype=np.int32))], names=["t", "id", "n", "pos"]
                )

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in run(batches):
            kept.append(batch)
            rows += batch.num_rows
            if rows >= 10_000:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, rows = [], 0
        if kept:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    return texts.mapInArrow(given_back(joined), "t bigint, id bigint, n int, pos int")


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether sets that first meet in shingles at these places can be as similar: by their sizes and by what is left of them."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    slack = 1e-9
    return (na >= similarity * nb - slack) & (nb >= similarity * na - slack) & (left * (1 + similarity) >= similarity * (na + nb) - slack)


#: Cells of a set's sketch: how many of its shingles fall into each, up to 255.
CELLS = 256


def maybe_similar_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) but those whose sketches (id, sketch) rule out this similarity: two sets share at most the smaller count of each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CELLS) for c in (batch.column(2), batch.column(3)))
            both = np.minimum(a, b)
            enough = both.sum(axis=1, dtype=np.int64) * (1 + similarity) >= similarity * (a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)) - 1e-6
            keep = enough | (both == 255).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    a, b = (sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(given_back(run), "u bigint, v bigint")


def similar_pairs(pairs: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets (id, shingles) have at least this Jaccard similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = (shingled.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(given_back(run), "u bigint, v bigint")


def fingerprint_pairs(texts: DataFrame, words: int, radius: int) -> DataFrame:
    """Pairs (u, v) of ids of ``texts`` (id, text), unique ids, whose fingerprints are within the radius: enough to connect all that are.

    Equal fingerprints are paired with the smallest id that has them, others by ``links``. The fingerprint zero, which texts without
    shingles have, is left out.
    """
    fps = materialize(fingerprints(texts, "id", "text", words).filter("fp <> 0"), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprints-distinct")
    equal = fps.join(distinct, "fp").filter("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    return links(distinct, radius).select("u", "v").unionByName(equal)


def verified_links(texts: DataFrame, words: int, similarity: float, radius: int = 2) -> DataFrame:
    """Links (u, v) between ids of ``texts`` (id, text), unique ids, whose shingle sets are similar: enough of them to connect all that any such links connect.

    Pairs of fingerprints within the radius come first and are compared exactly. Similar texts may have fingerprints that
    lie farther apart; for these, and only between texts that aren't connected by then: two similar sets share one of their
    first shingles, so documents meet in buckets by those. In crowded buckets one member is compared with all others, as
    long as that halves the members of crowded buckets that aren't all connected; then all pairs of all buckets are compared
    but those that are connected by then.
    """

    def shingle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", words)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingle(batches):
            cells = [np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % CELLS).astype(np.int64), minlength=CELLS) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.minimum(c, 255).astype(np.uint8).tobytes() for c in cells], pa.binary())], names=["id", "sketch"])

    spark = texts.sparkSession
    bound_batches(spark)
    by_shingle = Window.partitionBy("t")
    met = prefixes(texts, words, similarity).withColumn("m", F.count(F.lit(1)).over(by_shingle)).filter("m > 1")
    shared = materialize(met.withColumn("c", F.col("id")), "shingle-buckets")
    sketched = texts.join(shared.select("id").distinct(), "id", "left_semi").mapInArrow(given_back(sketch), "id bigint, sketch binary")
    sketches = materialize(sketched, "shingle-sketches")
    links_ = spark.createDataFrame([], "u bigint, v bigint")
    checked = links_

    def verify(pairs: DataFrame) -> DataFrame:
        nonlocal checked
        near = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(checked, ["u", "v"], "left_anti"), "shingle-pairs")
        checked = checked.unionByName(near)
        near = materialize(maybe_similar_pairs(near, sketches, similarity), "shingle-candidates")
        wanted = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        shingled = texts.join(wanted, "id", "left_semi").mapInArrow(given_back(shingle), "id bigint, shingles binary")
        return materialize(similar_pairs(near, materialize(shingled, "shingle-sets"), similarity), "shingle-links")

    def met_pairs(left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
        return left.alias("a").join(right.alias("b"), "t").filter(apart & _may_be_similar("a", "b", similarity)).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))

    def still_apart() -> DataFrame:
        """The buckets whose members aren't all connected, with the components that the links make."""
        of = materialize(components(links_), "shingle-components")
        now = shared.drop("c").join(of, F.col("id") == F.col("node"), "left").select("t", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
        apart = now.withColumns({"m": F.count(F.lit(1)).over(by_shingle), "lo": F.min("c").over(by_shingle), "hi": F.max("c").over(by_shingle)}).filter("lo <> hi").drop("lo", "hi")
        return materialize(apart, "shingle-buckets")

    links_ = verify(fingerprint_pairs(texts, words, radius))
    shared = still_apart()
    before, salt = None, 0
    while True:
        crowd = shared.filter(F.col("m") > SMALL)
        members = crowd.count()
        if not members or (before is not None and 2 * members > before):
            break
        # The member with the least before its first common shingle, as an original has, then others at random.
        rank = F.struct(F.when(F.lit(salt == 0), F.col("pos") / F.col("n")).otherwise(0.0), F.xxhash64("id", F.lit(salt)), "id")
        hubs = materialize(crowd.groupBy("t").agg(F.min_by(F.struct("id", "n", "pos", "c"), rank).alias("h")).select("t", "h.*"), "shingle-hubs")
        links_ = links_.unionByName(verify(met_pairs(hubs, crowd, F.col("a.c") != F.col("b.c"))))
        shared = still_apart()
        before, salt = members, salt + 1
    return links_.unionByName(verify(met_pairs(shared, shared, (F.col("a.id") < F.col("b.id")) & (F.col("a.c") != F.col("b.c")))))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all its columns, whatever their names.

    Documents are linked when the sets of their word shingles have at least this Jaccard similarity; all such pairs count, and
    groups are their connected components. Fingerprints and covering tables find the close pairs, which are compared exactly;
    an exact filter by shingles finds those that lie beyond the radius. Null and blank texts have no shingles and are all kept. Rows that share an id with
    other texts are documents of their own, in the order of a digest of their texts; rows of one id and one text are one
    document and stay or go together. A null id sorts before all others. An empty table gives an empty result.
    """
    docs = distinct_rows(df, id_col, text_col)
    unique = docs.select("sub", "copies").filter((F.col("sub") != 0) | (F.col("copies") != 1)).isEmpty()
    if unique:
        dropped = components(verified_links(docs.select("id", "text"), words, similarity)).filter("node <> component").select(F.col("node").alias("gone"))
        return _without(df, dropped.distinct(), F.col("id") == F.col("gone"), id_col, text_col)
    # Numbers in the order of id and text stand for the documents.
    nodes = materialize(numbered(docs, "node", "id", "sub"), "numbered")
    found = components(verified_links(nodes.select(F.col("node").alias("id"), "text"), words, similarity)).filter("node <> component").select("node").distinct()
    dropped = nodes.join(found, "node").select(F.col("id").alias("gone"), F.col("sub").alias("gone_sub"))
    return _without(df, dropped, (F.col("id") == F.col("gone")) & (F.col("sub") == F.col("gone_sub")), id_col, text_col)


def _without(df: DataFrame, dropped: DataFrame, same: Column, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(as_struct(df).alias("row"), id_of(id_col).alias("id"), sub_of(text_col).alias("sub"))
    return from_struct(rows.join(dropped, same, "left_anti"), "row", df.columns)
