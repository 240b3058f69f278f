"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.sources.scratch import materialize, release


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step, after which ``edges`` are deleted. Minima are written first, so that the join that follows reads two plain shuffles and hot nodes can be split."""
    if large:
        around = _both_ways(edges)
        least = materialize(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-min")
        out = around.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "star-min")
        out = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    done = materialize(out.filter(F.col("u") != F.col("v")).distinct(), "star")
    release(least, edges)
    return done


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of longs to (node, component) for every node of an edge; component is the smallest node reachable.

    Loops and repeated edges don't matter; edges with a null end are left out. No edges give an empty result.
    """
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct(), "star")
    while True:
        edges = _star(_star(edges, True), False)
        # Done when every node that points somewhere points at one node, and that one nowhere.
        twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        on = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if twice.unionByName(on).isEmpty():
            break
    # Each node but the roots points at its root now.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def components_of_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, component) for long keys that are linked by shared names: each key to the smallest key of its name."""
    least = materialize(rows.groupBy(name).agg(F.min(key).alias("__least")), "name-min")
    found = components(rows.join(least, name).select(F.col(key).alias("u"), F.col("__least").alias("v")))
    return rows.select(key).distinct().join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("component"))


def roots(pairs: DataFrame) -> DataFrame:
    """(node, into) of strings, one row per node, to (node, root), all walks one step at a time.

    A node without a row of its own is a root. Nodes on a cycle, and those that lead to one, stop where the walk from them
    first comes back to a node it has seen.
    """
    pairs = materialize(pairs.select("node", "into").filter("node <> into"), "roots")
    hops = materialize(pairs.withColumn("seen", F.array("node")).withColumn("done", F.lit(False)), "roots")
    while True:
        step = hops.alias("h").join(pairs.select(F.col("node").alias("n"), F.col("into").alias("to")), F.col("h.into") == F.col("n"), "left")
        stop = F.col("done") | F.col("n").isNull() | F.array_contains("seen", F.col("into"))
        hops = materialize(step.select("node", F.when(stop, F.col("into")).otherwise(F.col("to")).alias("into"), F.when(stop, F.col("seen")).otherwise(F.concat("seen", F.array("into"))).alias("seen"), stop.alias("done")), "roots")
        if hops.filter(~F.col("done")).isEmpty():
            return hops.select("node", F.col("into").alias("root"))
