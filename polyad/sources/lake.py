"""Sources and sinks of the article lake."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.text import try_date
from polyad.operators import graph
from polyad.operators.numbering import numbered
from polyad.schema import TABLES


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """CSV with a header; rows that don't fit are left out. Give ``schema`` and ``multiline=False`` where the files are large: both else cost a whole extra read or a split."""
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("mode", "DROPMALFORMED")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, *paths: str, tolerant: bool = False, glob: str | None = None) -> DataFrame:
    """Parquet files or folders; hive partitions become columns. ``tolerant`` skips corrupt files."""
    reader = spark.read.option("mergeSchema", "true" if len(paths) > 1 else "false").option("ignoreCorruptFiles", str(tolerant).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(*paths)


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def _year(*candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit(0)).cast("int")


def labelled_articles(rows: DataFrame) -> DataFrame:
    """Articles of the labelled corpus, which has one row per pair of actors. Bad dates give year 0."""
    date = try_date(F.col("publish_date"))
    return rows.select(F.md5("body").alias("article_id"), "news_index", date.alias("publish_date"), _year(F.year(date)).alias("year"), "title", "body", "tema_local")


def news_articles(rows: DataFrame) -> DataFrame:
    """Articles of the production corpus; its year column goes before the date's."""
    date = try_date(F.col("publish_date"))
    return rows.select(F.md5("body").alias("article_id"), F.col("id").alias("src_id"), "source", date.alias("publish_date"), _year(F.col("year").try_cast("int"), F.year(date)).alias("year"), "title", "body")


def has_body(df: DataFrame) -> DataFrame:
    """Rows with more than spaces in their body; only spaces are trimmed."""
    return df.filter(F.col("body").isNotNull() & (F.length(F.trim("body")) > 0))


def dedup_articles(df: DataFrame, *tiebreak: str | Column) -> DataFrame:
    """One row per body, by its digest; the first by ``tiebreak``."""
    first = Window.partitionBy("article_id").orderBy(*tiebreak)
    return df.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")


def write_lake(df: DataFrame, root: str, rows_per_file: int = 0) -> dict:
    """Write by year, in place of what is there."""
    writer = df.write.mode("overwrite").partitionBy("year")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(root)
    return {"n_articles": df.sparkSession.read.parquet(root).count(), "out_root": root}


def build_labelled_lake(spark: SparkSession, csv: str, root: str, schema: str | None = None) -> dict:
    return write_lake(dedup_articles(has_body(labelled_articles(read_csv(spark, csv, schema))), "news_index", "publish_date"), root)


def build_news_lake(spark: SparkSession, source: str, root: str) -> dict:
    return write_lake(dedup_articles(has_body(news_articles(read_parquet(spark, source))), "src_id", "publish_date"), root)


def write_shards(df: DataFrame, root: str, rows_per_file: int = 2000) -> None:
    """Append by year, in files of at most ``rows_per_file`` rows."""
    df.write.mode("append").partitionBy("year").option("maxRecordsPerFile", rows_per_file).parquet(root)


def pending(df: DataFrame, done: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def shard(df: DataFrame, k: int, of: int, *order: str) -> DataFrame:
    """Every ``of``-th row in this order, from the ``k``-th on. ``hash_shard`` does without a sort."""
    return numbered(df, "__i", *order).filter(F.col("__i") % of == k).drop("__i")


def hash_shard(df: DataFrame, k: int, of: int, key: str) -> DataFrame:
    """A stable share of the rows by key, without a shuffle."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(of)) == k)


def split_lines(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """Contiguous parts of equal size, the last one shorter: adds ``part`` from 0."""
    per = max(1, -(-df.count() // parts))
    return numbered(df, "__i", *order).withColumn("part", F.floor(F.col("__i") / per).cast("int")).drop("__i")


def request_lines(prompts: DataFrame, system: str, max_output_tokens: int = 8192, temperature: float = 0.0) -> DataFrame:
    """(key, prompt) to one JSON request per line, in ``value``."""
    return prompts.select(
        F.to_json(
            F.struct(
                F.col("key"),
                F.struct(
                    F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("prompt").alias("text"))).alias("parts"))).alias("contents"),
                    F.struct(F.array(F.struct(F.lit(system).alias("text"))).alias("parts")).alias("system_instruction"),
                    F.struct(F.lit(temperature).alias("temperature"), F.lit(max_output_tokens).alias("max_output_tokens")).alias("generation_config"),
                ).alias("request"),
            )
        ).alias("value")
    )


def response_lines(lines: DataFrame) -> DataFrame:
    """JSON result lines to (key, text); the text is empty where a result has none."""
    return lines.select(
        F.get_json_object("value", "$.key").alias("key"),
        F.coalesce(F.get_json_object("value", "$.response.candidates[0].content.parts[0].text"), F.lit("")).alias("text"),
    )


def write_json_list(spark: SparkSession, values: list, path: str) -> None:
    """A small driver-side list as a JSON file, on whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(values, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def read_json_list(spark: SparkSession, path: str) -> list:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def first_of(parts: list[DataFrame], key: str, last: bool = False) -> DataFrame:
    """Parts put together, one row per key: from the first part that has it, or the last one; of several there, the least by text."""
    ranked = union_all(p.withColumn("__part", F.lit(-i if last else i)) for i, p in enumerate(parts))
    plain = [c for c in ranked.columns if c != "__part"]
    order = Window.partitionBy(key).orderBy("__part", F.xxhash64(*plain))
    return ranked.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__part")


def union_distinct(parts: Iterable[DataFrame]) -> DataFrame:
    """The distinct rows of all parts."""
    return union_all(parts).distinct()


def round_robin(df: DataFrame, workers: int) -> DataFrame:
    """Rows dealt out in turn to as many partitions, of sizes that differ by little."""
    return df.repartition(workers)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in this order; no task keeps more than ``n``."""
    return df.orderBy(*order).limit(n)


def insert_into(df: DataFrame, table: str) -> None:
    """Append to a table that is there, by column name; columns that ``df`` lacks are null, and others are refused."""
    spark = df.sparkSession
    fields = spark.table(table).schema.fields
    extra = set(df.columns) - {f.name for f in fields}
    if extra:
        raise ValueError(f"{table} has no columns {sorted(extra)}")
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.insertInto(table)


def replace_table(df: DataFrame, path: str) -> int:
    """Write beside ``path``, count, and put it in its place.

    The old table is moved aside, not deleted, until the new one is there, and comes back if that fails; after a crash in
    between ``recover_table`` brings it back.
    """
    spark = df.sparkSession
    recover_table(spark, path)
    df.write.mode("overwrite").parquet(path + ".staging")
    n = spark.read.parquet(path + ".staging").count()
    fs, (new, old, aside) = _paths(spark, path + ".staging", path, path + ".old")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"can't move {path}.staging to {path}")
    fs.delete(aside, True)
    return n


def _paths(spark: SparkSession, *paths: str) -> tuple:
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark._jsc.hadoopConfiguration()), made


def recover_table(spark: SparkSession, path: str) -> bool:
    """Bring back a table that a crash left aside; whether there was one."""
    fs, (at, aside) = _paths(spark, path, path + ".old")
    if not fs.exists(aside):
        return False
    if fs.exists(at):
        return fs.delete(aside, True) and False
    return fs.rename(aside, at)


def replace_tables(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Replace several tables under ``root`` after all of them have been written; the number of rows of each."""
    staged = {}
    for name, df in tables.items():
        path = f"{root}/{name}.next"
        df.write.mode("overwrite").parquet(path)
        staged[name] = df.sparkSession.read.parquet(path)
    done = {name: replace_table(df, f"{root}/{name}") for name, df in staged.items()}
    for name, df in staged.items():
        fs, (path,) = _paths(df.sparkSession, f"{root}/{name}.next")
        fs.delete(path, True)
    return done


def export_tables(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Each table as Parquet under ``root``; the number of rows of each."""
    return {name: replace_table(df, f"{root}/{name}") for name, df in tables.items()}


def init_database(spark: SparkSession, name: str) -> list[str]:
    """Drop and create the graph's tables, empty, in a database of this name."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    spark.sql(f"CREATE DATABASE `{name}`")
    for table, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE `{name}`.`{table}` ({ddl}) USING parquet")
    return table_names(spark, name)


def export_public(nodes: DataFrame, edges: DataFrame, articles: DataFrame, root: str) -> dict:
    """The public tables under ``root``, without quotes and texts, and their summary as ``stats.json``."""
    counts = export_tables({"nodes": graph.public_nodes(nodes, edges), "edges": graph.public_edges(edges), "articles_meta": graph.public_articles(articles)}, root)
    summary = graph.stats(graph.with_degree(nodes, edges), edges, articles) | {"exported": counts}
    line = nodes.sparkSession.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{root}/stats.json")
    return summary


def table_names(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not (database and t.isTemporary))


def cached_by_count(df: DataFrame, path: str) -> DataFrame:
    """What is stored at ``path`` if it has as many rows as ``df``, else ``df``, stored there now."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path)
        if stored.count() == df.count():
            return stored
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
