"""Fusing ranked lists: reciprocal ranks, best scores, and where hits came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import ranked


def stacked(lists: dict[str, DataFrame]) -> DataFrame:
    """All hits with their list's name as ``source``."""
    return reduce(DataFrame.unionByName, (hits.withColumn("source", F.lit(name)) for name, hits in lists.items()))


def reciprocal_rank(hits: DataFrame, k: int | None = None, constant: int = 60) -> DataFrame:
    """Each node's sum of 1 / (constant + rank) over the lists it is in (query_id, node_id, rank from 1)."""
    score = F.round(F.sum(1.0 / (constant + F.col("rank"))), 9)
    return ranked(hits.groupBy("query_id", "node_id").agg(score.alias("score")), k)


def best_score(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Each node once, with its highest score; of equal ones the first source and rank."""
    order = Window.partitionBy("query_id", "node_id").orderBy(F.desc("score"), "source", "rank")
    best = hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "rank")
    return ranked(best, k)


def provenance(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Each node once, with its highest score and the sorted names of its sources."""
    merged = hits.groupBy("query_id", "node_id").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return ranked(merged, k)
