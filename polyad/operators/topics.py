"""Topics: clusters of embeddings, keywords, assignment and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.vocabulary import STOPWORDS
from polyad.session import bound_batches
from polyad.sources.scratch import materialize

BODY_CHARS = 600


def embed_text(title: Column, body: Column, chars: int = BODY_CHARS) -> Column:
    """What is embedded of an article: its title and the start of its body."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, chars)))


def fit(vectors: DataFrame, k: int, seed: int = 42, outlier_share: float = 0.0) -> DataFrame:
    """Clusters of (id, embedding): (id, topic_id). Of the vectors of each topic, the share farthest from its centre is topic -1."""
    data = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    out = KMeans(k=k, seed=seed, distanceMeasure="cosine", predictionCol="topic_id").fit(data).transform(data).select("id", "topic_id", "embedding")
    if not outlier_share:
        return out.select("id", "topic_id")
    centres = centroids(out.withColumnRenamed("topic_id", "label"))
    near = out.join(F.broadcast(centres), F.col("topic_id") == F.col("label")).withColumn("__d", 1 - cosine(F.col("embedding"), F.col("centroid")))
    bound = near.groupBy("topic_id").agg(F.percentile_approx("__d", 1 - outlier_share).alias("__cut"))
    return near.join(F.broadcast(bound), "topic_id").select("id", F.when(F.col("__d") > F.col("__cut"), -1).otherwise(F.col("topic_id")).alias("topic_id"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def centroids(labelled: DataFrame) -> DataFrame:
    """(label, embedding) to (label, centroid): means by place, aggregated before the shuffle."""
    places = labelled.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return places.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def embed_with(articles: DataFrame, model: Callable) -> DataFrame:
    """(id, embedding) by a model of one's own: it maps an iterator of pandas frames (id, text) to frames (id, embedding)."""
    return articles.select(F.col("article_id").alias("id"), embed_text(F.col("title"), F.col("body")).alias("text")).mapInPandas(model, "id string, embedding array<double>")


def embed_hashed(articles: DataFrame, size: int = 256) -> DataFrame:
    """(id, embedding) without a model: hashed word counts weighted by how few articles have them, of length one. Words that share a place add up."""
    text = embed_text(F.col("title"), F.col("body"))
    words = articles.select(F.col("article_id").alias("id"), F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1).alias("words"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=size).transform(words)
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    return Normalizer(inputCol="tfidf", outputCol="unit").transform(weighted).select("id", vector_to_array("unit").alias("embedding"))


def assign(vectors: DataFrame, centres: DataFrame, outlier_below: float | None = None) -> DataFrame:
    """(id, embedding) to (id, topic_id, score): the nearest centroid by cosine, the smallest label on a tie, -1 under the bound.

    There is one centroid per topic; all of them travel as one array, and each vector takes its best without a shuffle.
    Without centroids there is no result.
    """
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("centres"))
    rated = F.transform("centres", lambda c: F.struct((-cosine(F.col("embedding"), c["centroid"])).alias("s"), c["label"].alias("label")))
    best = vectors.crossJoin(F.broadcast(listed)).filter(F.size("centres") > 0).select("id", F.array_min(rated).alias("b"))
    out = best.select("id", F.col("b.label").alias("topic_id"), (-F.col("b.s")).alias("score"))
    return out if outlier_below is None else out.withColumn("topic_id", F.when(F.col("score") < outlier_below, -1).otherwise(F.col("topic_id")))


#: Cells that terms fall into by hash, to leave out those that too few documents have: one bit each on the driver and in a broadcast.
CELLS = 1 << 27


def _in_common_cells(rows: DataFrame, min_df: int) -> DataFrame:
    """``rows`` (id, topic_id, terms) with the terms whose cell at least ``min_df`` rows have: all terms that as many rows have, and a few others."""
    cell = lambda t: F.pmod(F.xxhash64(t), F.lit(CELLS))
    often = rows.select(F.explode(F.array_distinct(F.transform("terms", cell))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_df)
    words = materialize(often.groupBy((F.col("c") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("c", F.lit(64)).cast("int"))).alias("bits")), "term-cells").toArrow()
    bits = np.zeros(CELLS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    known = rows.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(3).flatten().to_numpy()
            held = (known.value[cells >> 6] >> (cells & 63)) & 1 == 1
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
            offsets = np.append(0, np.append(0, np.cumsum(held))[ends]).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(offsets), batch.column(2).flatten().filter(pa.array(held)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["id", "topic_id", "terms"])

    return rows.withColumn("cells", F.transform("terms", cell)).mapInArrow(keep, rows.schema)


def terms(docs: DataFrame, min_df: int = 5, stopwords: list[str] | None = None) -> DataFrame:
    """(topic_id, term, tf) of words and pairs of words of (id, topic_id, text), without stop words; terms in fewer documents go.

    Most terms stand in one or two documents. They are left out by the counts of hash cells before any term is shuffled;
    what is left is counted exactly. Rows of one id and topic are one document.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(stopwords or STOPWORDS))
    w = docs.select("id", "topic_id", F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    bound_batches(docs.sparkSession)
    kept = _in_common_cells(w.select("id", "topic_id", F.concat("w", pairs).alias("terms")), min_df)
    repeated = materialize(docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("again")), "repeated-ids")
    same = F.col("id").eqNullSafe(F.col("again"))
    # Each occurrence counts as c, and each document once as d, in the task that has its row; documents of several rows are put together first.
    one = lambda c, d: lambda t: F.struct(t.alias("term"), F.lit(c).cast("long").alias("c"), F.lit(d).cast("long").alias("d"))
    once = kept.join(repeated, same, "left_anti").select("topic_id", F.explode(F.concat(F.transform("terms", one(1, 0)), F.transform(F.array_distinct("terms"), one(0, 1)))).alias("e")).select("topic_id", "e.*")
    more = kept.join(repeated, same, "left_semi").select("id", "topic_id", F.explode("terms").alias("term")).groupBy("id", "topic_id", "term").agg(F.count(F.lit(1)).alias("c"))
    each = once.unionByName(more.select("topic_id", "term", "c", F.lit(1).cast("long").alias("d")))
    counts = materialize(each.groupBy("topic_id", "term").agg(F.sum("c").alias("tf"), F.sum("d").alias("df")), "term-counts")
    common = counts.groupBy("term").agg(F.sum("df").alias("df")).filter(F.col("df") >= min_df).select("term")
    return materialize(counts.join(common, "term").select("topic_id", "term", "tf"), "common-terms")


def keywords(term_counts: DataFrame, k: int = 8) -> DataFrame:
    """(topic_id, term, score, rank) by class-based tf-idf: a term's share of its topic times log(1 + mean words per topic / the term's count)."""
    totals = term_counts.groupBy("topic_id").agg(F.sum("tf").alias("words"))
    mean = totals.agg(F.avg("words").alias("mean"))
    overall = term_counts.groupBy("term").agg(F.sum("tf").alias("all"))
    scored = term_counts.join(totals, "topic_id").join(overall, "term").crossJoin(F.broadcast(mean)).withColumn("score", F.col("tf") / F.col("words") * F.log(1 + F.col("mean") / F.col("all")))
    order = Window.partitionBy("topic_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("topic_id", "term", "score", "rank")


def export(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Assignments with the topic's label, ``outlier`` where it has none."""
    return assigned.join(F.broadcast(labels), "topic_id", "left").withColumn("topic_label", F.coalesce("topic_label", F.lit("outlier")))


def report(assigned: DataFrame, words: DataFrame) -> DataFrame:
    """(topic_id, n, pct, keywords) of every topic but -1, largest first."""
    total = assigned.agg(F.count(F.lit(1)).alias("t"))
    top = words.groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " · ").alias("keywords"))
    n = assigned.filter("topic_id <> -1").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(top, "topic_id", "left").crossJoin(F.broadcast(total)).select("topic_id", "n", (100.0 * F.col("n") / F.col("t")).alias("pct"), "keywords").orderBy(F.desc("n"), "topic_id")


def outlier_share(assigned: DataFrame) -> DataFrame:
    return assigned.agg((100.0 * F.count_if(F.col("topic_id") == -1) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("outlier_pct"))


def mapping_template(report_rows: DataFrame) -> DataFrame:
    """(topic_id, keywords, macro_topic, count), the macro topic to be filled in."""
    return report_rows.select("topic_id", "keywords", F.lit("").alias("macro_topic"), F.col("n").alias("count"))


def to_macro(assigned: DataFrame, mapping: DataFrame, default: str = "otro") -> DataFrame:
    """Adds ``macro_topic``; empty entries of the mapping don't count."""
    known = mapping.filter("macro_topic <> ''").select("topic_id", F.col("macro_topic").alias("__m"))
    return assigned.join(F.broadcast(known), "topic_id", "left").withColumn("macro_topic", F.coalesce("__m", F.lit(default))).drop("__m")
