"""Session settings that the plans of this package assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quern", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC timestamps; ``conf`` may override.

    Pass settings with underscores for dots: ``spark_sql_shuffle_partitions="2000"``.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, however long the texts are; plans made from now on use them."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
