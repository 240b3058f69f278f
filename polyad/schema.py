"""Table schemas of the signed graph, their vocabularies, and checks of the constraints Spark doesn't enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vocabularies of the domain.
ACT_TYPES = ("endorses", "attacks", "allies_with", "calls_on", "distances_from", "questions", "negotiates_with", "competes_with", "accuses")
POLARITIES = ("positive", "negative", "neutral")
NODE_TYPES = ("person", "party", "institution", "coalition", "movement", "org")
CONFIDENCES = (1.0, 0.7, 0.4)
#: Acts without a polarity; they make no signed edge.
UNSIGNED_ACTS = ("co_occurs",)


TABLES: dict[str, str] = {
    "runs": "run_id string, kind string, model string, genome_id string, genome_hash string, prompt_id string, prompt_hash string, params string, n_items int, created_at timestamp, notes string",
    "articles": "article_id string, title string, body string, body_tokens int, source string, publish_date date, year int, period string",
    "nodes": "node_id string, canonical string, node_type string, role string, n_mentions int, n_articles int, degree int, first_seen date, last_seen date, curated boolean, confidence double",
    "aliases": "alias_id bigint, node_id string, surface_form string, surface_norm string, source string, n_occurrences int",
    "mentions": "mention_id bigint, node_id string, article_id string, run_id string, surface_form string, char_start int, char_end int, ner_score double, resolved_by string, match_score double",
    "edges": "edge_id bigint, from_node_id string, to_node_id string, article_id string, run_id string, act_type string, polarity string, issue string, evidence_quote string, confidence double, publish_date date, period string",
}
UNIQUE = {
    "runs": [["run_id"]],
    "articles": [["article_id"]],
    "nodes": [["node_id"]],
    "aliases": [["alias_id"], ["surface_norm"]],
    "mentions": [["mention_id"]],
    "edges": [["edge_id"], ["from_node_id", "to_node_id", "article_id", "act_type", "run_id"]],
}
FOREIGN = {
    "aliases": [("node_id", "nodes", "node_id")],
    "mentions": [("node_id", "nodes", "node_id"), ("article_id", "articles", "article_id"), ("run_id", "runs", "run_id")],
    "edges": [("from_node_id", "nodes", "node_id"), ("to_node_id", "nodes", "node_id"), ("article_id", "articles", "article_id"), ("run_id", "runs", "run_id")],
}
NOT_NULL = {"nodes": ["canonical", "node_type"], "aliases": ["node_id", "surface_form", "surface_norm"], "mentions": ["node_id", "article_id"], "edges": ["from_node_id", "to_node_id", "article_id", "act_type", "polarity"]}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], s) for name, s in TABLES.items()}


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations as (tab, rule, violations), one row for each constraint whose tables are given."""
    checks = []
    for name, df in tables.items():
        for cols in UNIQUE.get(name, []):
            if set(cols) <= set(df.columns):
                extra = df.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
                checks.append(extra.select(F.lit(name).alias("tab"), F.lit("unique " + ",".join(cols)).alias("rule"), "violations"))
        for col in NOT_NULL.get(name, []):
            if col in df.columns:
                checks.append(df.agg(F.count_if(F.col(col).isNull()).alias("violations")).select(F.lit(name).alias("tab"), F.lit(f"not null {col}").alias("rule"), "violations"))
        for col, other, key in FOREIGN.get(name, []):
            if other in tables and col in df.columns:
                lost = df.filter(F.col(col).isNotNull()).join(tables[other].select(F.col(key).alias(col)), col, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
                checks.append(lost.select(F.lit(name).alias("tab"), F.lit(f"foreign {col}").alias("rule"), "violations"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
