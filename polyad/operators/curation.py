"""Curation: proposed merges of nodes, candidate pairs, and applying merges to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.similarity import token_sort_ratio_col
from polyad.functions.text import normalize, token_count
from polyad.functions.vocabulary import ACRONYMS
from polyad.operators.components import components, roots
from polyad.operators.graph import with_degree


def evidence(nodes: DataFrame, aliases: DataFrame, acronyms: dict[str, str] | None = None, same_type_only: bool = False) -> DataFrame:
    """(node_a, node_b, reason): nodes with equal names, acronyms with their full names, and shared long aliases of one type.

    Each node is linked to the smallest of its group, never all pairs. Equal names link across types unless ``same_type_only``.
    """
    named = nodes.select("node_id", "node_type", normalize(F.col("canonical")).alias("form"))
    keys = ["form", "node_type"] if same_type_only else ["form"]
    first = named.groupBy(*keys).agg(F.min("node_id").alias("node_a"))
    exact = named.join(first, keys).filter("node_id <> node_a").select("node_a", F.col("node_id").alias("node_b"), F.lit("canonical").alias("reason"))
    short = nodes.sparkSession.createDataFrame(list((acronyms or ACRONYMS).items()), "acronym string, full string")
    full = named.groupBy("form").agg(F.min("node_id").alias("node_a"))
    forms = named.select("form", "node_id").unionByName(aliases.select(F.col("surface_norm").alias("form"), "node_id")).distinct()
    wide = F.broadcast(short).join(full, F.col("full") == F.col("form")).select("acronym", "node_a")
    acronym = forms.join(F.broadcast(wide), F.col("form") == F.col("acronym")).filter("node_id <> node_a").select("node_a", F.col("node_id").alias("node_b"), F.lit("acronym").alias("reason"))
    typed = aliases.select("node_id", F.col("surface_norm").alias("form")).filter(F.length("form") >= 8).filter(token_count(F.col("form")) >= 2).join(nodes.select("node_id", "node_type"), "node_id").distinct()
    least = typed.groupBy("form", "node_type").agg(F.min("node_id").alias("node_a"))
    shared = typed.join(least, ["form", "node_type"]).filter("node_id <> node_a").select("node_a", F.col("node_id").alias("node_b"), F.lit("alias").alias("reason"))
    return exact.unionByName(acronym).unionByName(shared)


def groups(pairs: DataFrame) -> DataFrame:
    """(node_a, node_b) of names to (node_id, component): the smallest name reachable."""
    rows = pairs.select("node_a", "node_b")
    ends = rows.select(F.explode(F.array("node_a", "node_b")).alias("node_id")).distinct()
    found = components(rows.select(F.xxhash64("node_a").alias("u"), F.xxhash64("node_b").alias("v")))
    of = ends.join(found, F.xxhash64("node_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", F.xxhash64("node_id")))
    return of.withColumn("component", F.min("node_id").over(Window.partitionBy("component"))).select("node_id", "component")


def propose(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, merge_into, canonical, type): each group's members go into the one of highest degree, the smallest id on a tie."""
    of = groups(pairs).join(nodes.select("node_id", "canonical", "node_type", "degree"), "node_id")
    best = of.groupBy("component").agg(F.min_by(F.struct("node_id", "canonical", "node_type"), F.struct(-F.col("degree"), F.col("node_id"))).alias("s"))
    return of.join(best, "component").filter(F.col("node_id") != F.col("s.node_id")).select("node_id", F.col("s.node_id").alias("merge_into"), F.col("s.canonical").alias("canonical"), F.col("s.node_type").alias("type"))


def by_reason(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top_aliases(nodes: DataFrame, aliases: DataFrame, k: int = 8, top: int = 150) -> DataFrame:
    """(node_id, surface_form, rank): the most frequent aliases of the nodes of highest degree."""
    kept = nodes.orderBy(F.desc("degree"), "node_id").limit(top).select("node_id")
    order = Window.partitionBy("node_id").orderBy(F.desc("n_occurrences"), "surface_form")
    return aliases.join(F.broadcast(kept), "node_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("node_id", "surface_form", "rank")


def candidate_pairs(nodes: DataFrame, top: int = 150, threshold: int = 85) -> DataFrame:
    """Pairs of one type among the nodes of highest degree whose names are similar: (a, b, type, ratio)."""
    kept = nodes.orderBy(F.desc("degree"), "node_id").limit(top).select("node_id", F.lower("canonical").alias("name"), "node_type")
    a, b = (kept.select(F.col("node_id").alias(x), F.col("name").alias(f"name_{x}"), "node_type") for x in "ab")
    pairs = a.join(b, "node_type").filter(F.col("a") < F.col("b"))
    return pairs.withColumn("ratio", token_sort_ratio_col(F.col("name_a"), F.col("name_b"))).filter(F.col("ratio") >= threshold).select("a", "b", F.col("node_type").alias("type"), "ratio")


def merge_map(curations: DataFrame, min_ratio: int = 60, short: int = 5) -> tuple[DataFrame, DataFrame]:
    """(node_id, root) of the merges to apply, and of those held back.

    Chains are followed to their ends first. A merge is held back if both names, as curated, are longer than ``short`` and
    not alike; an end without a curated name counts as short.
    """
    ends = roots(curations.filter("merge_into IS NOT NULL AND merge_into <> node_id").select(F.col("node_id").alias("node"), F.col("merge_into").alias("into")))
    names = curations.groupBy("node_id").agg(F.max_by(F.coalesce("canonical", F.lit("")), F.coalesce("canonical", F.lit(""))).alias("name"))
    both = ends.join(names.withColumnsRenamed({"node_id": "node", "name": "name_a"}), "node", "left").join(names.withColumnsRenamed({"node_id": "root", "name": "name_b"}), "root", "left").fillna("", ["name_a", "name_b"])
    ratio = F.when(F.least(F.length("name_a"), F.length("name_b")) > short, token_sort_ratio_col(F.lower("name_a"), F.lower("name_b"))).otherwise(100)
    rated = both.withColumn("ratio", ratio)
    pick = lambda cond: rated.filter(cond).select(F.col("node").alias("node_id"), "root")
    return pick(F.col("ratio") >= min_ratio), pick(F.col("ratio") < min_ratio)


def apply_merges(tables: dict[str, DataFrame], merges: DataFrame, curations: DataFrame) -> dict[str, DataFrame]:
    """nodes, aliases, mentions and edges after the merges (node_id, root) and the curated names and types.

    Edges become unique again by ends, article, act and run, the smallest edge_id stays; loops go. Aliases that the surviving
    node has already go. Mentions add up, degrees are counted anew, and generic names get confidence 0.3.
    """
    to = merges.select(F.col("node_id").alias("__id"), F.col("root").alias("__root"))

    def moved(df: DataFrame, col: str) -> DataFrame:
        return df.join(to, df[col] == to["__id"], "left").withColumn(col, F.coalesce("__root", col)).drop("__id", "__root")

    edges = moved(moved(tables["edges"], "from_node_id"), "to_node_id").filter("from_node_id <> to_node_id")
    first = Window.partitionBy("from_node_id", "to_node_id", "article_id", "act_type", "run_id").orderBy("edge_id")
    edges = edges.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")
    own = tables["aliases"].withColumn("__own", F.col("node_id"))
    order = Window.partitionBy("node_id", "surface_norm").orderBy(F.col("__own") != F.col("node_id"), "__own")
    aliases = moved(own, "node_id").withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__own")
    mentions = moved(tables["mentions"], "node_id")
    nodes = tables["nodes"]
    gained = nodes.join(to, nodes["node_id"] == to["__id"]).groupBy("__root").agg(F.sum("n_mentions").alias("__more"))
    kept = nodes.join(to.select(F.col("__id").alias("node_id")), "node_id", "left_anti").join(gained, F.col("node_id") == F.col("__root"), "left").withColumn("n_mentions", (F.col("n_mentions") + F.coalesce("__more", F.lit(0))).cast("int")).drop("__more", "__root")
    named = curations.join(to, curations["node_id"] == to["__id"], "left_anti").select("node_id", F.col("canonical").alias("__c"), F.col("type").alias("__t"), F.coalesce("is_generic", F.lit(False)).alias("__g")).dropDuplicates(["node_id"])
    touched = F.col("__c").isNotNull()
    kept = kept.join(named, "node_id", "left").withColumns({"canonical": F.coalesce("__c", "canonical"), "node_type": F.coalesce("__t", "node_type"), "curated": touched | F.coalesce("curated", F.lit(False)), "confidence": F.when(touched, F.when(F.col("__g"), 0.3).otherwise(1.0)).otherwise(F.col("confidence"))}).drop("__c", "__t", "__g")
    return {"nodes": with_degree(kept, edges), "aliases": aliases, "mentions": mentions, "edges": edges}
