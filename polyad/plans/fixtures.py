"""Domain tables made from the generated ones, in Spark and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.text import period
from polyad.schema import ACT_TYPES, NODE_TYPES
from polyad.sources.lake import dedup_articles, has_body, news_articles

ACTORS = ["thatin", "ononst", "inoran", "hehely", "orantion", "attion", "ention", "retion", "ciónue", "belich"]
TERMS = ["thtion", "ertion", "thanea", "eriner", "ontion", "antion", "hetion", "ciónas", "enlich", "edtion"]
ACTS = [*ACT_TYPES, "co_occurs"]
TITLES = ["Senador ", "ex ministra ", "la diputada ", "", "EL ", ""]
NAMES = ["María José Pérez", "Maria Jose Perez", "maría josé pérez", "Alberto Espina", "Alberto Espinoza", "Teodoro Ribera", "Teodoro Ribiera", "Gabriel Boric Font", "UDI", "Unión Demócrata Independiente"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def sql_pick(values: list[str], i: str) -> str:
    return "list_extract([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"], CAST({i} AS BIGINT) + 1)"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles of the production corpus, with bad and missing dates, years and titles."""
    d = F.col("doc_id")
    date = F.date_add(F.lit("2014-01-01").cast("date"), (d % 4380).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("n"), d.cast("string")).alias("id"),
        F.when(d % 50 != 7, F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.col("text").alias("body"),
        "source",
        F.lit("cl").alias("country"),
        F.when(d % 37 == 0, "2019").when(d % 41 != 0, date.cast("string")).alias("publish_date"),
        F.when(d % 11 != 0, F.year(date).cast("string")).alias("year"),
    )


NEWS_SQL = """news AS (
  SELECT 'n' || doc_id AS id, CASE WHEN doc_id % 50 <> 7 THEN split_part(text, chr(10), 1) END AS title, text AS body, source, 'cl' AS country,
         CASE WHEN doc_id % 37 = 0 THEN '2019' WHEN doc_id % 41 <> 0 THEN CAST(DATE '2014-01-01' + CAST(doc_id % 4380 AS INTEGER) AS VARCHAR) END AS publish_date,
         CASE WHEN doc_id % 11 <> 0 THEN CAST(year(DATE '2014-01-01' + CAST(doc_id % 4380 AS INTEGER)) AS VARCHAR) END AS year
  FROM documents)"""
DATED_SQL = "CASE WHEN regexp_matches(publish_date, '^\\d{4}-\\d{1,2}-\\d{1,2}') THEN TRY_CAST(publish_date AS DATE) END"
ARTICLES_SQL = (
    NEWS_SQL
    + f""", articles AS (
  SELECT * FROM (
    SELECT md5(body) AS article_id, id AS src_id, source, {DATED_SQL} AS publish_date,
           CAST(coalesce(TRY_CAST(year AS INTEGER), year({DATED_SQL}), 0) AS INTEGER) AS year, title, body
    FROM news WHERE body IS NOT NULL AND length(trim(body)) > 0)
  QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY src_id) = 1)"""
)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_articles(has_body(news_articles(news(spark, sf_dir))), "src_id", "publish_date")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_name").alias("canonical"), pick(list(NODE_TYPES), F.col("s_nationkey") % 6).alias("node_type")
    )


NODES_SQL = f"nodes AS (SELECT 'S' || s_suppkey AS node_id, s_name AS canonical, {sql_pick(list(NODE_TYPES), 's_nationkey % 6')} AS node_type FROM supplier)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed edges between consecutive suppliers of an order; loops included."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    dates = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("publish_date"))
    node = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    return (
        lines.withColumn("nxt", F.lead("l_suppkey").over(w))
        .filter("nxt IS NOT NULL")
        .join(dates, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            node("l_suppkey").alias("from_node_id"),
            node("nxt").alias("to_node_id"),
            F.md5(F.col("l_orderkey").cast("string")).alias("article_id"),
            F.lit("run").alias("run_id"),
            pick(list(ACT_TYPES), F.col("l_linenumber") % 9).alias("act_type"),
            F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral").alias("polarity"),
            "publish_date",
            period(F.col("publish_date")).alias("period"),
        )
    )


EDGES_SQL = f"""edges AS (
  SELECT 'S' || l_suppkey AS from_node_id, 'S' || nxt AS to_node_id, md5(CAST(l_orderkey AS VARCHAR)) AS article_id, 'run' AS run_id,
         {sql_pick(list(ACT_TYPES), 'l_linenumber % 9')} AS act_type,
         CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS polarity,
         CAST(o_orderdate AS DATE) AS publish_date, CAST(year(o_orderdate) AS VARCHAR) AS period
  FROM (SELECT *, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey WHERE nxt IS NOT NULL)"""
SIGN_SQL = "CASE polarity WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted relations of documents, good and bad: (article_id, ord, ends, act_type, polarity, issue, evidence_quote)."""
    d = F.col("doc_id")
    name = lambda i: pick(NAMES, i % len(NAMES))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), (d % 4).cast("int"))).alias("ord"))
    k = d + F.col("ord")
    quote = F.substring("text", F.col("ord") + 1, (d % 23).cast("int"))
    return rows.select(
        F.concat(F.lit("d"), d.cast("string")).alias("article_id"),
        "ord",
        name(d).alias("from_entity"),
        F.when(k % 29 != 3, name(d * 3 + F.col("ord") + 1)).alias("to_entity"),
        F.when(k % 17 != 5, pick(ACTS, k % 10)).alias("act_type"),
        pick(["positive", "negative", "neutral", "mixed", "negative"], k % 5).alias("polarity"),
        F.lit("issue").alias("issue"),
        F.when(k % 7 == 0, F.concat(F.lit("zz"), quote)).otherwise(quote).alias("evidence_quote"),
    )


RELATIONS_SQL = f"""relations AS (
  SELECT 'd' || doc_id AS article_id, CAST(ord AS INTEGER) AS ord, {sql_pick(NAMES, 'doc_id % 10')} AS from_entity,
         CASE WHEN (doc_id + ord) % 29 <> 3 THEN {sql_pick(NAMES, '(doc_id * 3 + ord + 1) % 10')} END AS to_entity,
         CASE WHEN (doc_id + ord) % 17 <> 5 THEN {sql_pick(ACTS, '(doc_id + ord) % 10')} END AS act_type,
         {sql_pick(['positive', 'negative', 'neutral', 'mixed', 'negative'], '(doc_id + ord) % 5')} AS polarity, 'issue' AS issue,
         CASE WHEN (doc_id + ord) % 7 = 0 THEN 'zz' ELSE '' END || substring(text, CAST(ord AS INTEGER) + 1, CAST(doc_id % 23 AS INTEGER)) AS evidence_quote
  FROM documents, LATERAL (SELECT unnest(range(0, doc_id % 4 + 1)) AS ord)), bodies AS (SELECT 'd' || doc_id AS article_id, text AS body FROM documents)"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("article_id"), F.col("text").alias("body"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of documents: words as surfaces, some typed differently from time to time."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}]{6,}"), F.lit(0))).alias("ord", "text"))
    return w.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("article_id"),
        "ord",
        "text",
        pick(["persona", "organización", "partido político", "lugar"], (F.length("text") + F.col("doc_id") % 2) % 4).alias("label"),
        ((F.col("ord") * 7 + F.col("doc_id")) % 10 / 10.0).alias("score"),
    )


MENTIONS_SQL = f"""mentions AS (
  SELECT 'd' || doc_id AS article_id, CAST(ord AS INTEGER) AS ord, text, {sql_pick(['persona', 'organización', 'partido político', 'lugar'], '(length(text) + doc_id % 2) % 4')} AS label,
         (ord * 7 + doc_id) % 10 / 10.0 AS score
  FROM (SELECT doc_id, unnest(w) AS text, unnest(range(0, len(w))) AS ord FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}]{{6,}}') AS w FROM documents)))"""


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with titles, accents and cases of their own: (surface, type, freq)."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(pick(TITLES, p % 6), F.when(p % 3 == 0, F.upper("p_name")).otherwise(F.initcap("p_name")), F.lit(" "), F.substring(F.md5(p.cast("string")), 1, 5)).alias("surface"),
        pick(["person", "org", "unknown"], p % 3).alias("type"),
        (p % 13 + 1).alias("freq"),
    )


SURFACES_SQL = f"""surfaces AS (
  SELECT {sql_pick(TITLES, 'p_partkey % 6')} || CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') END || ' ' || substring(md5(CAST(p_partkey AS VARCHAR)), 1, 5) AS surface,
         {sql_pick(['person', 'org', 'unknown'], 'p_partkey % 3')} AS type, p_partkey % 13 + 1 AS freq FROM part)"""
NORM_SQL = "trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))"


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias forms of nodes, some shared by several: (node_id, surface_form, surface_norm, n_occurrences)."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("node_id"),
        pick(NAMES, k % 10).alias("surface_form"),
        pick(["maria jose perez", "maria jose perez", "maria jose perez", "alberto espina", "alberto espinoza", "teodoro ribera", "teodoro ribiera", "gabriel boric font", "udi", "union democrata independiente"], k % 10).alias("surface_norm"),
        (k * 7 % 31).cast("int").alias("n_occurrences"),
    )


ALIASES_SQL = f"""aliases AS (
  SELECT 'S' || s_suppkey AS node_id, {sql_pick(NAMES, 's_suppkey % 10')} AS surface_form,
         {sql_pick(["maria jose perez", "maria jose perez", "maria jose perez", "alberto espina", "alberto espinoza", "teodoro ribera", "teodoro ribiera", "gabriel boric font", "udi", "union democrata independiente"], 's_suppkey % 10')} AS surface_norm,
         CAST(s_suppkey * 7 % 31 AS INTEGER) AS n_occurrences FROM supplier)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolution: suppliers as nodes (node_id, canonical, type, aliases, n), their words and names as aliases, some shared."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("node_id"),
        F.col("s_name").alias("canonical"),
        pick(list(NODE_TYPES), F.col("s_nationkey") % 6).alias("type"),
        F.array(pick(ACTORS, k % 10), pick(NAMES, k % 10), F.concat(F.lit("Alias "), k.cast("string"))).alias("aliases"),
        (k % 17).cast("int").alias("n"),
    )


FORMS_SQL = f"""forms AS (
  SELECT {NORM_SQL.format('a')} AS form, min(node_id) AS node_id FROM (
    SELECT 'S' || s_suppkey AS node_id, unnest([{sql_pick(ACTORS, 's_suppkey % 10')}, {sql_pick(NAMES, 's_suppkey % 10')}, 'Alias ' || s_suppkey]) AS a FROM supplier) GROUP BY 1)"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, node_id) of a resolution: capitalised stand-ins."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(k <= 10).select(pick(TERMS, k % 10).alias("surface"), F.concat(F.lit("S"), k.cast("string")).alias("node_id"))


ASSIGN_SQL = f"assign AS (SELECT {sql_pick(TERMS, 's_suppkey % 10')} AS text, 'S' || s_suppkey AS node_id FROM supplier WHERE s_suppkey <= 10)"


def samples(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two samples of articles that overlap, keyed by document; the second one has other titles."""
    d = F.col("doc_id")
    date = F.date_add(F.lit("2014-01-01").cast("date"), (d % 4380).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), d.cast("string")).alias("article_id"), F.col("text").alias("body"), "source", F.when(d % 41 != 0, date.cast("string")).alias("publish_date"), F.when(d % 11 != 0, F.year(date)).alias("year"), "doc_id"
    )
    return [rows.filter(d % 3 != 0).withColumn("title", F.lit("first")).drop("doc_id"), rows.filter(d % 2 == 0).withColumn("title", F.lit("second")).drop("doc_id")]


SAMPLES_SQL = """arts AS (
  SELECT 'd' || doc_id AS article_id, CASE WHEN doc_id % 3 <> 0 THEN 'first' ELSE 'second' END AS title, text AS body, source,
         CASE WHEN doc_id % 41 <> 0 THEN DATE '2014-01-01' + CAST(doc_id % 4380 AS INTEGER) END AS publish_date,
         CASE WHEN doc_id % 11 <> 0 THEN CAST(year(DATE '2014-01-01' + CAST(doc_id % 4380 AS INTEGER)) AS INTEGER) END AS year
  FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, entities as JSON) of all documents, with a place where the rank is even."""
    e = F.struct("text", F.col("label").alias("type"), "score", F.when(F.col("ord") % 2 == 0, F.array("ord", F.col("ord") + F.length("text"))).alias("char_span"))
    return mentions(spark, sf_dir).groupBy("article_id").agg(F.to_json(F.collect_list(e)).alias("entities"))
