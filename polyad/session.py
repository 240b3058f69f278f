"""Session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch where the session sets no bound: rows here hold whole texts.
BATCH_BYTES = 4 << 20

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}


def session(app: str = "polyad", **settings: str) -> SparkSession:
    """The running session, or a new one with these settings; ``settings`` go on top, with ``__`` for a dot."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own; ``session`` sets the same one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(2**31 - 1), str(2**63 - 1)):
        spark.conf.set(key, str(BATCH_BYTES))
