"""Mixing sources to target weights by a Pfair schedule of blocks.

Each source is cut into blocks of equal size.  In the ideal mixture all sources
flow at once, each at its exact weight; when one has no block left, the others
share its weight from then on.  Block j (from 1) of a source may run from the
slot in which the ideal mixture starts it, floor((j - 1) / w) for a source of
weight w before any has run out, and must have run by the slot in which the
ideal mixture ends it, ceil(j / w).  Earliest deadline first meets all these
deadlines, so every source stays within one block of its ideal at every slot,
and no slot stays free.  Weights are rational numbers and are never rounded.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, plain_names

#: Rows of one part, over which the rows of a source are numbered, so that a hot source is no single task.
PART_ROWS = 50_000


def deal(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """Source and block (from 0) of slot 0, 1, ...; needs memory for the sources only.

    In virtual time v a source of weight w has ideally had min(n, w v) of its n
    blocks, so slots and virtual time are tied by a line for each set of sources
    that are left.
    """
    names = sorted(s for s, n in blocks.items() if n)
    exact = {s: Fraction(weights[s]) for s in names}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    rate, most = [int(exact[s] * scale) for s in names], [blocks[s] for s in names]
    order = sorted(range(len(names)), key=lambda i: Fraction(most[i], rate[i]))  # as they run out
    lines, gone, left = [], 0, sum(rate)
    for i in order:
        lines.append((gone, left, most[i], rate[i]))  # until virtual time most / rate
        gone, left = gone + most[i], left - rate[i]
    line = [0] * len(names)

    def window(i: int, j: int) -> tuple[int, int]:
        """First slot of block j (from 1) and the slot by which it must have run."""
        def at(v: int) -> tuple[int, int, int]:
            while line[i] < len(lines) - 1 and v * lines[line[i]][3] > lines[line[i]][2] * rate[i]:
                line[i] += 1
            return lines[line[i]][0], lines[line[i]][1] * v, rate[i]

        gone, a, b = at(j - 1)
        release = gone + a // b
        gone, a, b = at(j)
        return release, gone - (-a // b)

    waiting, ready = [(*window(i, 1), i, 1) for i in range(len(names))], []
    heapq.heapify(waiting)
    for slot in range(sum(most)):
        while waiting and waiting[0][0] <= slot:
            _, deadline, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, j))
        deadline, i, j = heapq.heappop(ready)
        assert slot < deadline, "earliest deadline first meets all deadlines of full use"
        yield names[i], j - 1
        if j < most[i]:
            heapq.heappush(waiting, (*window(i, j + 1), i, j + 1))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slot of every block of the sources (source, blocks, weight) that reach this task, in batches."""
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("source", "blocks", "weight")), strict=True)]
    order = deal({s: n for s, n, _ in rows}, {s: w for s, _, w in rows})
    del rows
    slot = 0
    while held := list(islice(order, 1 << 14)):
        sources, numbers = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(sources), pa.array(numbers, pa.int64()), pa.array(range(slot, slot + len(held)), pa.int64())], names=["source", "source_block", "slot"])
        slot += len(held)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``before``: the size of all rows of the same source ahead, by doc_id.

    Each source is spread by a hash over 256 parts, and one more for every
    PART_ROWS rows of the table; parts are summed first, so that the running sum of a hot source
    is taken in many tasks.
    """
    parts = 256 + rows.count() // PART_ROWS
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)).cast("int"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    bases = Stored(sums.select("source", "part", F.coalesce(F.sum("sum").over(by_part), F.lit(0)).alias("base")), "bases").df
    within = Window.partitionBy("source", "part").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(bases, ["source", "part"]).withColumn("before", F.col("base") + F.col("inside"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 65536, temper: float = 0.5) -> DataFrame:
    """A row per row of ``docs``: doc_id, source, source_block, position, slot.

    A document stands in the block of its source in which its first character
    falls (a block holds ``block`` characters, counted over the source's
    documents), at ``position``; ``slot`` is the block's place in the mixture.
    ``weights`` gives each source's target share; a source without one, or
    every source if it is None, gets its count of characters to the power
    ``temper``, so that small sources are met early and often.  No row is
    dropped or repeated.  A null source is the source ''; a null or empty text
    has size 1; a text longer than a block stands in the one where it starts;
    repeated doc_ids are ordered by a hash of the text (rows equal in both stand
    one after the other), null doc_ids first; sources of equal deadline run in
    the order of their names; an empty table gives an empty result; other
    columns are ignored.  One task deals the blocks and holds the sources, of
    which there may be any number; larger blocks make its work less.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.greatest(F.length(text), F.lit(1)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))
    spark, rows = docs.sparkSession, Stored(rows, "sizes").df
    totals = rows.groupBy("source").agg(F.sum("size").alias("total"))
    weight = F.pow("total", F.lit(float(temper)))
    if weights:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, given double")
        totals, weight = totals.join(given, "source", "left"), F.coalesce("given", weight)
    targets = Stored(totals.select("source", F.ceil(F.col("total") / int(block)).cast("long").alias("blocks"), weight.alias("weight")), "targets").df
    if not targets.where("not (weight > 0 and weight < double('infinity'))").isEmpty():
        raise ValueError("target weights must be positive")
    slots = Stored(targets.coalesce(1).mapInArrow(_dealt, "source string, source_block long, slot long"), "slots").df
    rows = numbered(rows).withColumn("source_block", F.expr(f"before div {int(block)}"))
    rows = rows.join(slots, ["source", "source_block"])
    return rows.select("doc_id", "source", "source_block", F.expr(f"before % {int(block)}").alias("position"), "slot")


def mix(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``docs``, sorted by their place in the schedule; an empty table stays empty.

    Written as files, the rows lie in mixture order from the first file to the
    last.  Rows that share a doc_id stand at the earliest of their places.
    """
    rows, name = plain_names(docs)
    places = schedule(docs, **options).groupBy("doc_id").agg(F.min(F.struct("slot", "position")).alias("place")).withColumnRenamed("doc_id", "of")
    key = F.col(name["doc_id"]).cast("long")
    placed = rows.join(places, key.eqNullSafe(F.col("of"))).orderBy("place", key, F.xxhash64(F.col(name["text"]).cast("string")))
    return placed.drop("of", "place").toDF(*docs.columns)
