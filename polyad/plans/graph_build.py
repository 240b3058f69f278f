"""The plans that make the graph's tables: from a resolution and samples, and from relations loaded later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.text import normalize, period, token_count, try_date
from polyad.operators import mentions as ment
from polyad.operators import relations as rel
from polyad.operators.graph import with_degree
from polyad.operators.numbering import numbered
from polyad.operators.resolution import alias_table
from polyad.schema import TABLES
from polyad.sources.lake import first_of

NER_RUN, EDGE_RUN, LOADED_RUN = "ner", "re-sample", "re"


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, in its order and types; those that are missing are null."""
    fields = [x.split() for x in TABLES[table].split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def articles(samples: list[DataFrame]) -> DataFrame:
    """Samples (article_id, title, body, source, publish_date, year) as one table; of an article in several, the first one's row."""
    rows = first_of(samples, "article_id").withColumn("publish_date", try_date(F.col("publish_date")))
    half = F.when(F.col("year").isNotNull(), F.concat(F.col("year").cast("int").cast("string"), F.when(F.month("publish_date") <= 6, "-H1").otherwise("-H2")))
    return _shaped(rows.withColumns({"body_tokens": token_count(F.col("body")), "period": half}), "articles")


def runs(spark, rows: list[dict]) -> DataFrame:
    """Rows of the run table; what isn't given is null."""
    names = [x.split()[0] for x in TABLES["runs"].split(", ")]
    types = [n for n in names if n not in ("n_items", "created_at")]
    made = spark.createDataFrame([[r.get(n) for n in types] + [r.get("n_items")] for r in rows], ", ".join(f"{n} string" for n in types) + ", n_items int")
    return _shaped(made.withColumn("created_at", F.current_timestamp()), "runs")


def linked_mentions(entities: DataFrame, assign: DataFrame, aliases: DataFrame, known: DataFrame, run_id: str = NER_RUN) -> DataFrame:
    """Tagged entities (article_id, entities as JSON) of known articles as mentions of nodes: by surface, else by normalised form."""
    rows = ment.explode_entities(entities.join(known.select("article_id"), "article_id", "left_semi"))
    forms = aliases.select(F.col("surface_norm").alias("form"), "node_id")
    found = rel.resolve_mentions_to_nodes(rows, assign, forms).select(
        "node_id", "article_id", F.lit(run_id).alias("run_id"), F.col("text").alias("surface_form"), F.get("char_span", 0).alias("char_start"), F.get("char_span", 1).alias("char_end"), F.col("score").alias("ner_score"), F.lit("exact").alias("resolved_by")
    )
    return _shaped(numbered(found, "mention_id", "article_id", "char_start", "surface_form", "node_id", "ner_score"), "mentions")


def build(resolved: DataFrame, assign: DataFrame, samples: list[DataFrame], entities: DataFrame, run_rows: list[dict], relations: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six tables from a resolution (nodes, and surface to node), samples of articles, tagged entities and, if given, relations.

    A form that several nodes have belongs to the smallest id. Relations link by form; those whose ends aren't two known
    nodes, or whose article isn't known, are left out, and so are repeats. Degrees count a node's edges.
    """
    spark = resolved.sparkSession
    arts = articles(samples)
    alias = numbered(alias_table(resolved), "alias_id", "node_id", "surface_norm").withColumn("source", F.lit("ner"))
    edges = spark.createDataFrame([], TABLES["edges"])
    if relations is not None:
        forms = alias.select(F.col("surface_norm").alias("form"), "node_id")
        known = arts.select("article_id", F.lit(None).cast("date").alias("publish_date"))
        linked = rel.link(relations.withColumnRenamed("publish_date", "own_date") if "publish_date" in relations.columns else relations, forms, known, any_polarity=True)
        edges = rel.edges(linked, EDGE_RUN, ["ord"], ("from_node_id", "to_node_id", "article_id", "act_type"))
        edges = edges.withColumn("period", F.lit(None).cast("string"))
        edges = _shaped(numbered(edges, "edge_id", "from_node_id", "to_node_id", "article_id", "act_type"), "edges")
    nodes = resolved.select("node_id", "canonical", F.col("type").alias("node_type"), F.col("n").alias("n_mentions")).withColumns({"n_articles": F.lit(0), "curated": F.lit(False), "confidence": F.lit(1.0)})
    return {
        "runs": runs(spark, run_rows),
        "articles": arts,
        "nodes": _shaped(with_degree(nodes, edges, loops_once=True), "nodes"),
        "aliases": _shaped(alias, "aliases"),
        "mentions": linked_mentions(entities, assign, alias, arts),
        "edges": edges,
    }


def load_edges(tables: dict[str, DataFrame], relations: list[DataFrame], run: dict, keep_all: bool = False) -> dict[str, DataFrame]:
    """The tables with all edges replaced by those of ``relations``, the run's row replaced, and degrees counted anew.

    Relations link by aliases, then by canonical names; dates and years come from the articles. Acts without a polarity are
    left out unless ``keep_all``. The result is to be put in place as a whole, see ``lake.replace_tables``.
    """
    rows = relations[0]
    for more in relations[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    words = rel.alias_dictionary(tables["aliases"], tables["nodes"])
    linked = rel.link(rel.signed_acts(rows, keep_all), words, tables["articles"].select("article_id", "publish_date"))
    run_id = run.get("run_id", LOADED_RUN)
    edges = numbered(rel.edges(linked, run_id, ["ord"]), "edge_id", "from_node_id", "to_node_id", "article_id", "act_type")
    kept = tables["runs"].filter(F.col("run_id") != run_id).unionByName(runs(rows.sparkSession, [{"run_id": run_id} | run]))
    return tables | {"edges": _shaped(edges, "edges"), "runs": kept, "nodes": _shaped(with_degree(tables["nodes"], edges), "nodes")}
