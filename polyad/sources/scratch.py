"""A folder that driver and executors share, for what cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders made where the session names none, by application.
_made: dict[str, str] = {}
#: Folders that scopes have opened, the innermost last.
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a new folder of a local session, or one below the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _made:
            local = master.startswith("local[") or master == "local"
            _made[app] = tempfile.mkdtemp(prefix="polyad-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        at = _made[app]
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_scopes[-1] if _scopes else shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, so nothing that reads it may be left by then."""
    path = new_path(spark, "scope")
    _scopes.append(path)
    try:
        yield
    finally:
        _scopes.remove(path)
        delete(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    # What reads the table needs none of the shuffles that made it, so Spark deletes them when the write has ended.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            delete(df.sparkSession, path)
