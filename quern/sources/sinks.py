"""Sinks: databases, collections, indexing of chunks, exact-size samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..providers import Embedder


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def create_database(spark: SparkSession, name: str, recreate: bool = False) -> None:
    if recreate:
        spark.sql(f"DROP DATABASE IF EXISTS {_quoted(name)} CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}")


def checked(rows: DataFrame, dimension: int) -> DataFrame:
    """``rows``; the job that writes them fails on a vector of another length."""
    size = F.size("vector")
    wrong = F.raise_error(F.concat(F.lit(f"vector length is not {dimension}: "), size.cast("string"))).cast("array<float>")
    return rows.withColumn("vector", F.when(F.col("vector").isNotNull() & (size == dimension), F.col("vector")).otherwise(wrong))


def create_collection(rows: DataFrame, name: str, dimension: int) -> None:
    """Write a collection, replacing one of that name."""
    checked(rows, dimension).write.mode("overwrite").saveAsTable(name)


def create_if_missing(rows: DataFrame, name: str, dimension: int) -> None:
    """Write a collection only if there is none of that name."""
    checked(rows, dimension).write.mode("ignore").saveAsTable(name)


def insert(rows: DataFrame, name: str, dimension: int) -> int:
    """Append to a collection; the number of rows written."""
    seen = Observation()
    checked(rows, dimension).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").saveAsTable(name)
    return seen.get["n"]


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds ``id``: 1, 2, ... in the given order, by range partitions and their sizes.

    Only the sizes of partitions are summed in one place, so no task sees all rows.
    """
    parts = rows.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(*order)
    ranked = parts.withColumn("_rank", F.row_number().over(within))
    sizes = parts.groupBy("_part").count()
    bases = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))
    return ranked.join(bases, "_part").withColumn("id", F.col("_base") + F.col("_rank")).drop("_part", "_rank", "_base")


def index_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """id, vector and text of chunks (doc_id, chunk_index, text), ids 1..n in their order."""
    return numbered(chunks, "doc_id", "chunk_index").select("id", embedder.column(F.col("text")).cast("array<float>").alias("vector"), "text")


def exact_sample(rows: DataFrame, group: str, key: str, every: int = 1000, seed: int = 42, parts: int = 32) -> DataFrame:
    """From each group max(1, n // every) rows, chosen by the MD5 of the seed and ``key``.

    The group's size decides how many rows it gives, so the sample is exact and
    not Bernoulli; a row's rank depends on the seed and its key alone.  A group
    is first cut to its wanted number in ``parts`` parts, so that one of very many
    rows is not sorted in one task; null is a group of its own.
    """
    sizes = rows.groupBy(group).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / every)).alias("_take")).withColumnRenamed(group, "_group")
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    ranked = rows.join(sizes, rows[group].eqNullSafe(F.col("_group"))).withColumn("_mark", mark).withColumn("_part", F.pmod(F.xxhash64("_mark"), F.lit(parts)))
    for by in (["_group", "_part"], ["_group"]):
        ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_mark", key))).where("_n <= _take")
    return ranked.drop("_n", "_take", "_group", "_mark", "_part")
