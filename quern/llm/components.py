"""Connected components: stars are contracted in rounds until what is left fits one bounded task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


#: So many links at most are resolved by one task.
ONE_TASK = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, component) of all links that reach this task, by union-find."""
    pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not pairs:
        return
    u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(place[: len(u)].tolist(), place[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)  # names are sorted, so the root is the least
    found = names[[find(i) for i in range(len(root))]]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found)], names=["u", "component"])


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each u, written out: a plain join side that Spark can replicate."""
    return Stored(pairs.groupBy("u").agg(F.min("v").alias("least")), "stars").df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, component) for every u in ``edges`` (u, v): the least id that links reach.

    Up to ONE_TASK links are resolved by one task.  Beyond that, each round
    links every node's larger neighbours, then its smaller ones, to its least
    neighbour; the rounds grow with the logarithm of the graph.  Sums are taken
    before each shuffle and a node of very many links is a skewed join side, so
    no task holds all links of a node.
    """
    now = Stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.df.count() <= ONE_TASK:
        return now.df.coalesce(1).mapInArrow(_forest, "u long, component long")
    for _ in range(most_rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).where("u <> v").distinct()
        big = Stored(large, "large")
        least = _least(big.df)
        small = big.df.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        nxt = Stored(small.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "edges")
        # A forest of stars (no v is some u) no longer changes.
        if nxt.df.select("v").distinct().join(nxt.df.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and nxt.df.groupBy("u").count().where("count > 1").isEmpty():
            roots = nxt.df.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
            return nxt.df.select("u", F.col("v").alias("component")).unionByName(roots)
        now.drop()
        now = nxt
    raise RuntimeError("components did not settle")
