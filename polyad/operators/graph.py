"""Degrees, dyads and views of the signed graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyad.functions.text import sign


def _count(polarity: str) -> Column:
    return F.sum(F.when(F.col("polarity") == polarity, 1).otherwise(0))


def ends(edges: DataFrame, loops_once: bool = False) -> DataFrame:
    """One row per edge and end, from one scan; a loop has two ends, or one with ``loops_once``."""
    both = F.array("from_node_id", "to_node_id")
    return edges.withColumn("node_id", F.explode(F.array_distinct(both) if loops_once else both))


def signed_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its degrees: isolated ones have 0, loops count twice."""
    sums = ends(edges.select("from_node_id", "to_node_id", "polarity")).groupBy("node_id").agg(_count("positive").alias("p"), _count("negative").alias("g"), F.count(F.lit(1)).alias("d"))
    zero = F.lit(0)
    return nodes.select("node_id", "canonical", "node_type").join(sums, "node_id", "left").select("node_id", "canonical", "node_type", F.coalesce("p", zero).alias("pos_degree"), F.coalesce("g", zero).alias("neg_degree"), F.coalesce("d", zero).alias("degree"))


def signed_degree_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have edges, with their degrees: loops count once."""
    sums = ends(edges.select("from_node_id", "to_node_id", "polarity"), loops_once=True).groupBy("node_id").agg(_count("positive").alias("pos_degree"), _count("negative").alias("neg_degree"), F.count(F.lit(1)).alias("degree"))
    return nodes.select("node_id", "canonical", "node_type").join(sums, "node_id")


def with_degree(nodes: DataFrame, edges: DataFrame, loops_once: bool = False) -> DataFrame:
    """``nodes`` with ``degree`` written anew."""
    sums = ends(edges.select("from_node_id", "to_node_id"), loops_once).groupBy("node_id").agg(F.count(F.lit(1)).alias("__d"))
    return nodes.drop("degree").join(sums, "node_id", "left").withColumn("degree", F.coalesce("__d", F.lit(0))).drop("__d")


def edges_by_period(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_node_id", "to_node_id", "period").agg(F.sum(sign(F.col("polarity"))).alias("sign_sum"), F.count(F.lit(1)).alias("n"))


def with_sign(edges: DataFrame) -> DataFrame:
    return edges.withColumn("sign", sign(F.col("polarity")).cast("byte"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) of a column."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))).select("value", "n", (100.0 * F.col("n") / F.col("t")).alias("pct"))


def dyads(edges: DataFrame, min_valenced: int = 3) -> DataFrame:
    """(u, v, sign_sum, m, mean): unordered pairs with their signed edges and mean sign."""
    s = sign(F.col("polarity"))
    return (
        edges.filter((F.col("from_node_id") != F.col("to_node_id")) & F.col("polarity").isin("positive", "negative"))
        .groupBy(F.least("from_node_id", "to_node_id").alias("u"), F.greatest("from_node_id", "to_node_id").alias("v"))
        .agg(F.sum(s).alias("sign_sum"), F.count(F.lit(1)).alias("m"))
        .filter(F.col("m") >= min_valenced)
        .withColumn("mean", F.col("sign_sum") / F.col("m"))
    )


def dyads_net(edges: DataFrame) -> DataFrame:
    """(u, v, pos, neg): positive and negative edges of each unordered pair, loops included."""
    return edges.groupBy(F.least("from_node_id", "to_node_id").alias("u"), F.greatest("from_node_id", "to_node_id").alias("v")).agg(_count("positive").alias("pos"), _count("negative").alias("neg"))


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node_id)."""
    for end in ("from_node_id", "to_node_id"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return edges


def of_type(edges: DataFrame, nodes: DataFrame, node_type: str = "person") -> DataFrame:
    return among(edges, nodes.filter(F.col("node_type") == node_type))


def top_actors(nodes: DataFrame, k: int, generic: list[str]) -> DataFrame:
    """The nodes of highest degree whose name isn't generic."""
    return nodes.filter(~F.lower("canonical").isin(*generic)).orderBy(F.desc("degree"), "node_id").limit(k)


def public_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected nodes with their degrees, as published."""
    return signed_degree(nodes, edges).filter("degree > 0").orderBy(F.desc("degree"), "node_id")


def public_edges(edges: DataFrame) -> DataFrame:
    """Edges without quotes."""
    return with_sign(edges).select("from_node_id", "to_node_id", "article_id", "act_type", "polarity", "sign", "issue", "publish_date", "period")


def public_articles(articles: DataFrame) -> DataFrame:
    """Metadata of the articles, no text."""
    return articles.select("article_id", "source", "publish_date", "year", "period")


def stats(nodes: DataFrame, edges: DataFrame, articles: DataFrame) -> dict:
    """The summary that goes with a public export."""
    years = articles.filter("year > 0").agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    return {
        "n_nodes": nodes.count(),
        "n_edges": edges.count(),
        "n_articles": articles.count(),
        "polarity": {r["value"]: r["n"] for r in distribution(edges, "polarity").collect()},
        "node_type": {r["value"]: r["n"] for r in distribution(nodes, "node_type").collect()},
        "years": [years["a"], years["b"]],
        "top_actors": [[r["canonical"], r["degree"]] for r in nodes.orderBy(F.desc("degree"), "node_id").limit(15).collect()],
    }
