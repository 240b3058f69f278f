"""Filters, samples and counts over the article lake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.text import alternation, bounded_alternation, md5_rank, tokens
from polyad.operators.numbering import numbered
from polyad.sources.scratch import materialize


def load(lake: DataFrame, years: tuple[int, int] | None = None, topics: list[str] | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Articles of a range of years and of some topics; a reproducible sample of ``limit`` of them."""
    if topics and "tema_local" not in lake.columns:
        raise ValueError("topics need a column tema_local, which only the labelled lake has; filter by actors and lexicon instead")
    if years:
        lake = lake.filter(F.col("year").between(*years))
    if topics:
        lake = lake.filter(F.col("tema_local").isin(topics))
    return sample(lake, limit, seed) if limit is not None else lake


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in the seeded hash order; a smaller sample is part of a larger one."""
    return df.orderBy(F.md5(F.concat("article_id", F.lit(str(seed)))), "article_id").limit(n)


def counts_by_year(lake: DataFrame) -> DataFrame:
    return lake.groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def top_values(lake: DataFrame, k: int = 50) -> DataFrame:
    """The most frequent topics, or sources where there are no topics."""
    dim = "tema_local" if "tema_local" in lake.columns else "source"
    return lake.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), dim).limit(k)


def gazetteer(rows: DataFrame, columns: tuple[str, ...] = ("from_node_label", "to_node_label"), top: int = 300, min_len: int = 4) -> DataFrame:
    """The most frequent names in the columns, lower-cased and trimmed: (name, n)."""
    names = rows.select(F.explode(F.array(*columns)).alias("label")).filter(F.col("label").isNotNull() & (F.length(F.trim("label")) >= min_len))
    return names.groupBy(F.lower(F.trim("label")).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(top)


def _text(null_title: str) -> Column:
    """Title and body; a null title makes it null (``drop``) or counts as empty (``empty``)."""
    title = F.coalesce("title", F.lit("")) if null_title == "empty" else F.col("title")
    return F.lower(F.concat(title, F.lit(" "), F.col("body")))


def _distinct_hits(names: list[str], null_title: str, word_boundary: bool) -> Column:
    rx = (bounded_alternation if word_boundary else alternation)(names)
    return F.array_distinct(F.regexp_extract_all(_text(null_title), F.lit(rx), F.lit(1)))


def political(
    lake: DataFrame, actors: list[str], lexicon: list[str] | None = None, years: tuple[int, int] | None = None, min_actors: int = 2, min_terms: int = 3, limit: int | None = None, seed: int = 42, null_title: str = "drop", word_boundary: bool = False
) -> DataFrame:
    """Articles that name enough actors or, with a lexicon, enough of its terms: adds matched_actors and matched_lexicon.

    Without ``word_boundary`` names match inside words. Articles that hold none of the names are dropped by a plain match
    before any are listed.
    """
    if years:
        lake = lake.filter(F.col("year").between(*years))
    if min(min_actors, min_terms if lexicon else min_actors) > 0:
        rx = (bounded_alternation if word_boundary else alternation)([*actors, *(lexicon or [])])
        lake = lake.filter(_text(null_title).rlike(rx))
    found = lake.withColumn("matched_actors", _distinct_hits(actors, null_title, word_boundary))
    enough = F.size("matched_actors") >= min_actors
    if lexicon:
        found = found.withColumn("matched_lexicon", _distinct_hits(lexicon, null_title, word_boundary))
        enough = enough | (F.size("matched_lexicon") >= min_terms)
    found = found.filter(enough)
    return sample(found, limit, seed) if limit is not None else found


def political_volume(lake: DataFrame, actors: list[str], lexicon: list[str], min_actors: int = 2, min_terms: int = 3) -> DataFrame:
    """(year, total, pol): articles with a body, and how many are political; null titles count as empty.

    Names are listed only where a plain match finds one.
    """
    hit = (F.size(_distinct_hits(actors, "empty", False)) >= min_actors) | (F.size(_distinct_hits(lexicon, "empty", False)) >= min_terms)
    if min(min_actors, min_terms) > 0:
        hit = F.when(_text("empty").rlike(alternation([*actors, *lexicon])), hit).otherwise(False)
    rows = lake.filter(F.col("body").isNotNull() & (F.length(F.trim("body")) > 0))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(hit, 1).otherwise(0)).alias("pol")).orderBy("year")


def top_up(pool: DataFrame, taken: DataFrame, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """Of each year its quota (year, need) of articles not taken yet, in the seeded hash order."""
    fresh = pool.join(taken.select("article_id").distinct(), "article_id", "left_anti")
    rank = md5_rank(F.concat("article_id", F.lit(str(seed))))
    # A year can hold a large part of all rows, so parts of it are cut to the largest quota first.
    most = quotas.agg(F.coalesce(F.max("need"), F.lit(0))).first()[0]
    parts = Window.partitionBy("year", "__part").orderBy(rank, "article_id")
    cut = fresh.withColumn("__part", F.pmod(F.xxhash64("article_id"), F.lit(256))).withColumn("__rn", F.row_number().over(parts)).filter(F.col("__rn") <= most).drop("__rn", "__part")
    order = Window.partitionBy("year").orderBy(rank, "article_id")
    return cut.withColumn("__rn", F.row_number().over(order)).join(F.broadcast(quotas), "year").filter(F.col("__rn") <= F.col("need")).drop("__rn", "need")


def with_json_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as JSON text, null as ``[]``."""
    return df.withColumns({c: F.coalesce(F.to_json(c), F.lit("[]")) for c in columns if c in df.columns})


def stratified_split(df: DataFrame, strata: list[str], key: str, shares: tuple[float, float] = (0.6, 0.2), seed: int = 42) -> DataFrame:
    """Adds ``split``: train, dev and test within each stratum, in the seeded hash order."""
    rows = numbered(df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))), "__i", *strata, "__h", key)
    sizes = rows.groupBy(*[F.col(c).alias(f"__of_{c}") for c in strata]).agg(F.min("__i").alias("__start"), F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    at = (F.col("__i") - F.col("__start")) / F.col("__n")
    out = rows.join(sizes, same).withColumn("split", F.when(at < shares[0], "train").when(at < sum(shares), "dev").otherwise("test"))
    return out.select(*df.columns, "split")


def near_duplicate_bodies(articles: DataFrame, threshold: float = 0.95, words: int = 5) -> DataFrame:
    """(a, b, similarity): pairs a < b of articles whose sets of word shingles have at least this Jaccard similarity.

    Two such sets share one of the few rarest shingles of each (prefix filter), so only those are joined; shingles that occur
    once are left out of the join. Bodies are compared in lower case; shorter ones are one shingle. Dedup exact copies first.
    """
    w = tokens(F.lower("body"))
    # Shifted copies of the words side by side; a lambda that refers to the words would split the body anew for each shingle.
    side = F.arrays_zip(*[F.slice(w, k + 1, F.greatest(F.size(w) - (words - 1), F.lit(0))).alias(f"w{k}") for k in range(words)])
    grams = F.when(F.size(w) >= words, F.transform(side, lambda x: F.xxhash64(F.concat_ws(" ", *[x[f"w{k}"] for k in range(words)])))).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
    base = materialize(articles.select("article_id", F.array_distinct(grams).alias("s")), "shingles").filter("size(s) > 0").withColumn("n", F.size("s"))
    each = base.select("article_id", "n", F.explode("s").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(often, "t").groupBy("article_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("r"))
    prefix = ranked.select("article_id", "n", F.explode(F.slice("r", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("x")).filter("x.df > 1").select("article_id", "n", "x.t")
    a, b = (prefix.select(F.col("article_id").alias(k), F.col("n").alias(f"n{k}"), "t") for k in "ab")
    near = (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    pairs = a.join(b, "t").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    sets = [base.select(F.col("article_id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(sets[0], "a").join(sets[1], "b").withColumn("similarity", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")
