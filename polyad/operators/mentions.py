"""Mentions: chunks, an offline tagger, merging, and counts over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.text import bounded_alternation, char_span, python_strip, tokens, word_chunks
from polyad.functions.vocabulary import MENTION_LABELS
from polyad.schema import NODE_TYPES

ENTITIES = "array<struct<text:string,type:string,score:double,char_span:array<int>>>"


def chunks(articles: DataFrame, max_words: int = 300, overlap: int = 30) -> DataFrame:
    """(article_id, chunk, word_offset)."""
    split = articles.select("article_id", "body", tokens(F.col("body")).alias("words"))
    return split.select("article_id", F.explode(word_chunks(F.col("body"), F.col("words"), max_words, overlap)).alias("c")).select("article_id", "c.chunk", "c.word_offset")


def tag(articles: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Mentions by a dictionary of label to names: (article_id, ord, text, label, score). A stand-in for a model; see ``tag_with``."""
    parts = []
    for label, forms in names.items():
        hits = F.regexp_extract_all("body", F.lit("(?i)" + bounded_alternation(forms)), F.lit(1))
        parts.append(articles.select("article_id", F.posexplode(hits).alias("ord", "text"), F.lit(label).alias("label"), F.lit(1.0).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tag_with(articles: DataFrame, model: Callable) -> DataFrame:
    """Mentions by a model: ``model`` maps an iterator of pandas frames (article_id, body) to frames (article_id, ord, text, label, score)."""
    return articles.select("article_id", "body").mapInPandas(model, "article_id string, ord int, text string, label string, score double")


def merge(raw: DataFrame, bodies: DataFrame) -> DataFrame:
    """One mention per article, lower-cased text and type: the one of highest score, the earliest on a tie, with its place in the body.

    ``raw`` is (article_id, ord, text, label, score); blank texts are left out and unknown labels are types of their own.
    """
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in MENTION_LABELS.items() for x in kv])[F.col("label")], F.col("label"))
    rows = raw.withColumns({"text": python_strip(F.col("text")), "type": kind, "score": F.round("score", 3)}).filter("text <> ''")
    best = rows.groupBy("article_id", F.lower("text").alias("key"), "type").agg(F.max_by("text", F.struct("score", -F.col("ord"))).alias("text"), F.max("score").alias("score"))
    return best.join(bodies.select("article_id", "body"), "article_id").select("article_id", "text", "type", "score", char_span(F.col("body"), F.col("text")).alias("char_span"))


def entities_json(mentions: DataFrame) -> DataFrame:
    """(article_id, entities): the mentions of each article as JSON text."""
    span = F.when(F.col("char_span").isNotNull(), F.array("char_span.start", "char_span.end"))
    return mentions.groupBy("article_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("text", "type", "score", span.alias("char_span"))))).alias("entities"))


def explode_entities(shards: DataFrame) -> DataFrame:
    """JSON entities back to rows; what isn't JSON gives none."""
    return shards.select("article_id", F.explode(F.from_json("entities", ENTITIES)).alias("e")).select("article_id", "e.*")


def actors_per_article(mentions: DataFrame, at_least: int = 2) -> DataFrame:
    """(article_id, actors): the distinct actor names of each article, sorted, where there are enough."""
    return mentions.filter(F.col("type").isin(*NODE_TYPES)).groupBy("article_id").agg(F.sort_array(F.collect_set("text")).alias("actors")).filter(F.size("actors") >= at_least)


def majority_type(mentions: DataFrame) -> DataFrame:
    """(surface, type, freq): the most frequent type of each surface, the first by name on a tie, and how often the surface occurs."""
    n = mentions.groupBy(F.col("text").alias("surface"), "type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("surface").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"), F.sum("n").alias("freq"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sets of mentions (article_id, text, type) against each other: mean Jaccard similarity per article, and mentions lost and gained."""
    sides = [m.select("article_id", "text", "type", F.lit(name == "a").alias("in_a"), F.lit(name == "b").alias("in_b")) for name, m in (("a", left), ("b", right))]
    return parity_of(sides[0].unionByName(sides[1]))


def parity_of(rows: DataFrame) -> DataFrame:
    """``parity`` of mentions (article_id, text, type, in_a, in_b) that say which sets they are in, read once.

    A mention is one string, which starts with the sets that a row has it in: sets of strings are compared by hash, those of
    structs each with each.
    """
    kind = F.coalesce(F.concat(F.length("type").cast("string"), F.lit(":"), F.col("type")), F.lit("-"))
    name = F.coalesce(F.concat(F.lit("="), F.lower("text")), F.lit(""))
    sets = F.when(F.col("in_a") & F.col("in_b"), "2").when(F.col("in_a"), "a").otherwise("b")
    seen = rows.filter("in_a OR in_b").groupBy("article_id").agg(F.collect_set(F.concat(sets, kind, name)).alias("seen"))
    only = lambda other: F.array_distinct(F.transform(F.filter("seen", lambda x: F.substring(x, 1, 1) != other), lambda x: F.substring(x, 2, 2**31 - 1)))
    n = seen.select(only("b").alias("a"), only("a").alias("b")).select(F.size("a").alias("a"), F.size("b").alias("b"), F.size(F.array_intersect("a", "b")).alias("both"))
    return n.agg(
        F.count(F.lit(1)).alias("articles"),
        F.avg(F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("mean_jaccard"),
        F.sum(F.col("a") - F.col("both")).alias("lost"),
        F.sum(F.col("b") - F.col("both")).alias("gained"),
    )


def compare(left: DataFrame, right: DataFrame, articles: DataFrame) -> DataFrame:
    """Totals of two sets of mentions over the articles: (system, mentions, mean_per_article, empty_articles, vocabulary, only_here)."""
    parts = []
    for name, mine, other in (("a", left, right), ("b", right, left)):
        per = articles.select("article_id").join(mine.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")), "article_id", "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_per_article"), F.count_if(F.col("n").isNull()).alias("empty_articles")
        )
        words = mine.select(F.lower("text").alias("w")).distinct()
        only = words.join(other.select(F.lower("text").alias("w")).distinct(), "w", "left_anti").agg(F.count(F.lit(1)).alias("only_here"))
        parts.append(per.crossJoin(words.agg(F.count(F.lit(1)).alias("vocabulary"))).crossJoin(only).select(F.lit(name).alias("system"), "mentions", "mean_per_article", "empty_articles", "vocabulary", "only_here"))
    return parts[0].unionByName(parts[1])


def of_articles(mentions: DataFrame, sample: DataFrame) -> DataFrame:
    """The mentions in the articles of a sample."""
    return mentions.join(sample.select("article_id").distinct(), "article_id", "left_semi")


def type_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(system, type, n) of two sets of mentions."""
    sides = [m.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("system"), "type", "n") for name, m in (("a", left), ("b", right))]
    return sides[0].unionByName(sides[1])


def roll_up(entities: DataFrame) -> DataFrame:
    """Entities (article_id, ord, canonical, type, surface_forms) to one row per group that shares surface forms: (canonical, type, surface_forms, n_articles).

    Groups are the components over shared forms, so the order of articles doesn't matter; the longest canonical name stands
    for a group, the first by name on a tie.
    """
    from polyad.operators.components import components_of_names

    rows = entities.withColumn("eid", F.xxhash64("article_id", "ord", "canonical")).withColumn("forms", F.array_distinct(F.concat(F.transform("surface_forms", lambda x: F.trim(x)), F.array(F.trim("canonical")))))
    of = components_of_names(rows.select("eid", F.explode("forms").alias("name")), "eid", "name")
    return rows.join(of, "eid").groupBy("component").agg(
        F.min_by(F.trim("canonical"), F.struct(-F.length(F.trim("canonical")), F.trim("canonical"))).alias("canonical"),
        F.min_by("type", F.struct("article_id", "ord")).alias("type"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("surface_forms"),
        F.count(F.lit(1)).alias("n_articles"),
    ).drop("component")


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the first in this order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")
