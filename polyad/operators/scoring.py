"""Scores of extracted relations against gold data, and agreement of annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.functions.similarity import may_reach, token_sort_ratio_col
from polyad.functions.text import f_beta, normalize, ratio

LEVELS = ("undirected", "directed", "act_type", "polarity")


def levels(rows: DataFrame) -> DataFrame:
    """Relations (article_id, a, b, act_type, polarity) as keys of four nested levels, without loops: (level, article_id, key)."""
    act, pol = F.coalesce("act_type", F.lit("")), F.coalesce("polarity", F.lit(""))
    keys = (F.array(F.least("a", "b"), F.greatest("a", "b")), F.array("a", "b"), F.array(F.col("a"), F.col("b"), act), F.array(F.col("a"), F.col("b"), act, pol))
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), k.alias("key")) for n, k in zip(LEVELS, keys)])).alias("x")
    return rows.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b AND a <> '' AND b <> ''").select("article_id", made).select("x.level", "article_id", "x.key").distinct()


def score(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(level, tp, fp, fn, p, r, f05) over the articles that have gold relations."""
    known = gold.select("article_id").distinct()
    p = levels(predicted.join(known, "article_id", "left_semi")).withColumn("p", F.lit(1))
    g = levels(gold).withColumn("g", F.lit(1))
    both = p.join(g, ["level", "article_id", "key"], "full_outer")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = both.groupBy("level").agg(count(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), count(F.col("g").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn"))
    rated = sums.withColumns({"p": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rated.withColumn("f05", f_beta(F.col("p"), F.col("r")))


def to_unions(predicted: DataFrame, unions: DataFrame, cutoff: int = 88) -> DataFrame:
    """Predicted relations with the gold codes ``a`` and ``b`` of their ends: by similar names within the article's ``unions`` (article_id, code, name)."""
    named = unions.withColumn("form", normalize(F.col("name"))).filter("form <> ''")
    raw = predicted.select("article_id", F.explode(F.array("from_entity", "to_entity")).alias("raw")).distinct().withColumn("name", normalize(F.col("raw")))
    pairs = raw.join(named.select("article_id", "code", "form"), "article_id").filter(may_reach(F.col("name"), F.col("form"), cutoff))
    best = pairs.withColumn("ratio", token_sort_ratio_col(F.col("name"), F.col("form"))).filter(F.col("ratio") >= cutoff).groupBy("article_id", "raw").agg(F.min_by("code", F.struct(-F.col("ratio"), "code")).alias("code"))
    a, b = (best.select("article_id", F.col("raw").alias(e), F.col("code").alias(c)) for e, c in (("from_entity", "a"), ("to_entity", "b")))
    return predicted.join(a, ["article_id", "from_entity"], "left").join(b, ["article_id", "to_entity"], "left")


def kappa(labels: DataFrame) -> DataFrame:
    """Cohen's kappa of columns ``x`` and ``y``: one row (n, agreement, expected, kappa)."""
    pairs = labels.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    n = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    xs, ys = (pairs.groupBy(F.col(c).alias("k")).agg(F.sum("c").alias(f"n{c}")) for c in "xy")
    chance = xs.join(ys, "k").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("e"))
    out = n.crossJoin(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("agreement"), (F.col("e") / (F.col("n") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("agreement") - F.col("expected")) / (1 - F.col("expected"))).otherwise(1.0))


def proxies(relations: DataFrame, articles: DataFrame) -> DataFrame:
    """One row (articles, relations, per_article, pct_without): what can be told without gold data."""
    n = articles.select("article_id").join(relations.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")), "article_id", "left")
    return n.agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum("n"), F.lit(0)).alias("relations"), F.avg(F.coalesce("n", F.lit(0))).alias("per_article"), (100.0 * F.count_if(F.col("n").isNull()) / F.count(F.lit(1))).alias("pct_without"))
