"""Incremental ingest of articles with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from polyad.sources.lake import dedup_articles, has_body, news_articles


def read_news(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of the production corpus as a stream of articles."""
    return has_body(news_articles(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)))


def into_lake(articles: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Append articles that the lake doesn't have. A batch that runs again adds nothing, since its articles are there by then."""

    def load(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = dedup_articles(batch, "src_id", "publish_date")
        try:
            # An article's year follows from its row, so its copies are in the lake's folders of these years.
            years = [r["year"] for r in fresh.select("year").distinct().collect()]
            there = spark.read.parquet(root).filter(F.col("year").isin(*years)).select("article_id")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = fresh.join(there, "article_id", "left_anti")
        fresh.write.mode("append").partitionBy("year").parquet(root)

    return articles.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days", *keys: str) -> DataFrame:
    """(window_start, keys, n) of a stream; rows later than ``late`` don't count."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each micro-batch of what is there now."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
