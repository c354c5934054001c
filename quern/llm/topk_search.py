"""Exact top-k inner-product search with a KD-tree per shard.

A coarse KD-tree, split at medians of a bounded sample, deals all vectors over
cells, and a cell with more rows than a shard holds over several shards by hash.
Each shard builds a KD-tree by median splits of its widest dimension and keeps
the tight bounding box of every node.  The inner product of a query with any
point of a box is at most the sum over dimensions of the larger of q * low and
q * high; nodes are taken best bound first until the best bound left is below
the k-th score.  A query first searches its home shard; its k-th score there
goes with it to those other shards only whose cell's tight box, taken over all
rows, can reach it.  Scores are whole numbers, so results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

#: Rows of a leaf, vectors of a shard, and queries searched at once.
LEAF, SHARD_ROWS, BLOCK = 256, 32768, 256
#: Expected rows and numbers of the sample that places the cells' splits, sampled rows a cell, and numbers of all boxes.
SAMPLE_ROWS, SAMPLE_NUMBERS, CELL_SAMPLE, BOX_NUMBERS = 32768, 1 << 21, 16, 1 << 20
_FOUND = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and ``v``, the components as floor(scale * x); unusable vectors are left out.

    A vector takes part if it is not null and holds neither null nor a
    non-finite component.
    """
    x = F.col(vector)
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return rows.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class KDTree:
    """Nodes in arrays: children, bounding boxes and row ranges of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.order = np.arange(len(ids))
        self.child: list[tuple[int, int] | None] = []
        self.range: list[tuple[int, int]] = []
        low, high = [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = rows[self.order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            node = len(self.range)
            self.range.append((a, b))
            self.child.append(None)
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                pair = self.child[parent] or (0, 0)
                self.child[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            axis = int(np.argmax(hi - lo)) if own.shape[1] else 0
            if b - a > LEAF and own.shape[1] and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                stack += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.rows = ids[self.order], rows[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest possible score of each query in each node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, -vec_id) of up to k rows; ``floor`` is a score that k rows elsewhere reach."""
        best: list[tuple[int, int]] = []
        limit = floor
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if limit is not None and -bound < limit:
                break
            pair = self.child[node]
            if pair:
                for c in pair:
                    if limit is None or bounds[c] >= limit:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            a, b = self.range[node]
            scores = self.rows[a:b] @ query
            at = np.flatnonzero(scores >= limit) if limit is not None else np.arange(b - a)
            for s, i in zip(scores[at].tolist(), self.ids[a:b][at].tolist(), strict=True):
                if i == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (int(s), -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (int(s), -i))
            if len(best) == k:
                limit = best[0][0] if floor is None else max(floor, best[0][0])
        return best


class Cells:
    """A coarse tree over sampled rows; its leaves are the cells that all rows are dealt over."""

    def __init__(self, rows: np.ndarray, most: int):
        rows = rows.astype(np.float64)
        self.axis, self.cut, self.child = [0], [0.0], [(0, 0)]
        heap, leaves = [(-len(rows), 0, np.arange(len(rows)))], 1
        while heap and leaves < most:
            _, node, own = heapq.heappop(heap)
            x = rows[own]
            spread = x.max(axis=0, initial=-np.inf) - x.min(axis=0, initial=np.inf)
            if not spread.size or not spread.max() > 0:
                continue
            axis = int(spread.argmax())
            v = x[:, axis]
            cut = np.partition(v, len(v) // 2)[len(v) // 2]
            if cut == v.min():
                cut = v[v > cut].min()
            pair = (len(self.axis), len(self.axis) + 1)
            self.axis[node], self.cut[node], self.child[node] = axis, float(cut), pair
            self.axis += [0, 0]
            self.cut += [0.0, 0.0]
            self.child += [(pair[0],) * 2, (pair[1],) * 2]
            for c, part in zip(pair, (own[v < cut], own[v >= cut]), strict=True):
                heapq.heappush(heap, (-len(part), c, part))
            leaves += 1

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(rows), np.int32)
        if len(self.axis) == 1:
            return at
        axis, cut, child = np.array(self.axis), np.array(self.cut), np.array(self.child, np.int32)
        while True:
            below = child[at, (rows[np.arange(len(rows)), axis[at]].astype(np.float64) >= cut[at]).astype(int)]
            if (below == at).all():
                return at
            at = below


def _in_cells(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells.of(_matrix(batch.column("v"), len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("hash"), pa.array(at, pa.int32())], names=["vec_id", "v", "hash", "cell"])

    return run


_BOX = "cell int, size long, low array<long>, high array<long>"


def _box_rows(held: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    columns = [list(held), [n for n, _, _ in held.values()], [low for _, low, _ in held.values()], [high for _, _, high in held.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cell", "size", "low", "high"])


def _boxes(vectors: DataFrame) -> DataFrame:
    """Rows and tight box of each cell: one row a cell from each task, then their union."""

    def merged(held: dict, cell: int, size: int, low: np.ndarray, high: np.ndarray) -> None:
        n, lo, hi = held.get(cell, (0, low, high))
        held[cell] = (n + size, np.minimum(lo, low), np.maximum(hi, high))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows, at = _matrix(batch.column("v"), len(batch)), batch.column("cell").to_numpy()
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                some = rows[order[a:b]]
                merged(held, int(at[order[a]]), int(b - a), some.min(axis=0), some.max(axis=0))
        yield _box_rows(held)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            low, high = _matrix(batch.column("low"), len(batch)), _matrix(batch.column("high"), len(batch))
            for cell, size, lo, hi in zip(batch.column("cell").to_pylist(), batch.column("size").to_pylist(), low, high, strict=True):
                merged(held, cell, size, lo, hi)
        yield _box_rows(held)

    return vectors.mapInArrow(own, _BOX).repartition("cell").mapInArrow(union, _BOX)


def _reachable(cells: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Rows (vec_id, v, home, floor) with the cells whose box can reach the floor; rounding errs towards keeping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = low.T.astype(np.float64), high.T.astype(np.float64)
        far = np.maximum(np.abs(lo), np.abs(hi))
        for whole in batches:
            for a in range(0, len(whole), BLOCK):
                batch = whole.slice(a, BLOCK)
                q = _matrix(batch.column("v"), len(batch)).astype(np.float64)
                floor = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()])
                bound = np.maximum(q, 0) @ hi + np.minimum(q, 0) @ lo + 1e-9 * (np.abs(q) @ far)
                row, at = np.nonzero(bound >= floor[:, None])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells[at], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "home", "floor")), found], names=["vec_id", "v", "home", "floor", "cells"])

    return run


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _search(k: int):
    """Rows of one shard after another: first its vectors, then queries (id, v, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, tree = None, [], [], None

        def ready() -> KDTree | None:
            if not ids:
                return None
            own = np.concatenate(rows)
            # Sums of products below 2**53 are exact as doubles, which multiply faster.
            most = int(np.abs(own).max(initial=0))
            return KDTree(np.concatenate(ids), own.astype(np.float64) if most < 1 << 22 and own.shape[1] < 1 << 8 else own)

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            asks = batch.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(shards)], strict=True):
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, tree = shards[a], None
                    ids.clear()
                    rows.clear()
                v, own = _matrix(part.column("v"), b - a), part.column("vec_id").to_numpy()
                if not asks[a]:
                    ids.append(own)
                    rows.append(v)
                    tree = None
                    continue
                tree = tree or ready()
                if tree is None:
                    continue
                floors = part.column("floor").to_pylist()
                for lo in range(0, b - a, BLOCK):
                    some = v[lo : lo + BLOCK]
                    exact = some.astype(np.float64) if tree.rows.dtype == np.float64 and np.abs(some).max(initial=0) < 1 << 22 else some
                    held = tree if exact.dtype == tree.rows.dtype else KDTree(tree.ids, tree.rows.astype(np.int64))
                    bounds = held.bounds(exact)
                    out = [(int(q), -i, s) for q, x, y, f in zip(own[lo : lo + BLOCK], exact, bounds, floors[lo : lo + BLOCK], strict=True) for s, i in held.search(int(q), x, y, k, f)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["query_id", "vec_id", "score"])

    return run


def _in_shards(vectors: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """Vectors, then queries, of each shard through its tree."""
    both = vectors.select("shard", F.lit(False).alias("ask"), "vec_id", "v", F.lit(None).cast("long").alias("floor")).unionByName(queries.select("shard", F.lit(True).alias("ask"), "vec_id", "v", "floor"))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "ask").mapInArrow(_search(k), _FOUND)


@dataclass
class Boxes:
    """Cells with their tight boxes, the shards of each (cell, first, parts), and how many shards there are."""

    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shards: DataFrame
    count: int


def _dealt(vectors: DataFrame, total: int, width: int) -> tuple[DataFrame, Boxes]:
    """All vectors with their cell, stored, and the cells' boxes.

    The sample is the rows below a hash that leaves a bounded number of them; it
    sets only where cells end.  Boxes and sizes are over all rows.  Cells are at
    most as many as the sample and the room for boxes allow, whatever the input.
    """
    few = max(CELL_SAMPLE, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(width, 1)))
    most = max(1, min(-(-total // SHARD_ROWS), few // CELL_SAMPLE, BOX_NUMBERS // max(width, 1)))
    unit = F.col("hash") / 2.0**64 + 0.5
    sample = vectors.where(unit * total <= few).select("v").toArrow()
    rows = np.array(sample.column("v").to_pylist(), np.int64).reshape(len(sample), width)
    placed = Stored(vectors.mapInArrow(_in_cells(Cells(rows, most)), "vec_id long, v array<long>, hash long, cell int"), "cells").df
    held = sorted(_boxes(placed).collect(), key=lambda r: r["cell"])
    parts = [-(-r["size"] // SHARD_ROWS) for r in held]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    shards = vectors.sparkSession.createDataFrame([(r["cell"], f, p) for r, f, p in zip(held, first, parts, strict=False)], "cell int, first int, parts int")
    low, high = (np.array([r[c] for r in held], np.int64).reshape(len(held), width) for c in ("low", "high"))
    return placed, Boxes(np.array([r["cell"] for r in held], np.int32), low, high, shards, first[-1])


def top_k(rows: DataFrame, asked: Column, k: int = 5, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best of all other rows for each row where ``asked`` holds.

    Columns: query_id, rank (from 1), vec_id, score (integer inner product of
    floor(scale * x)); ties go to the smaller vec_id.  Vectors that are null or
    hold null or non-finite components take no part, nor do vectors whose
    length is not that of most (they have no inner product with the others);
    vec_id must be unique: of repeated ones the least vector counts.  With fewer
    than k other rows a query gets all of them; an empty table gives no row.
    Other columns are ignored.  Queries are read in blocks; a shard's task holds
    its own vectors and one block.  Equal vectors, however many, share a cell
    whose rows are dealt over several shards.  Scores must fit 64 bits.
    """
    vectors = whole_vectors(rows, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors = Stored(vectors.withColumn("hash", F.xxhash64("vec_id")), "vectors").df
    sizes = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    total, width = (sizes[0]["count"], sizes[0]["n"]) if sizes else (0, 0)
    vectors = vectors.where(F.size("v") == width)
    boxes, sharded = None, vectors.withColumn("shard", F.lit(0))
    if total > SHARD_ROWS:
        placed, boxes = _dealt(vectors, total, width)
        sharded = placed.join(F.broadcast(boxes.shards), "cell").withColumn("shard", (F.col("first") + F.pmod("hash", F.col("parts"))).cast("int"))
    shards = boxes.count if boxes else 1
    queries = sharded.where(asked)
    home = Stored(_in_shards(sharded, queries.withColumn("floor", F.lit(None).cast("long")), k, shards), "home").df
    found = home
    if boxes:
        kth = home.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), "floor")
        floors = queries.select("vec_id", "v", F.col("shard").alias("home")).join(kth, "vec_id", "left").select("vec_id", "v", "home", "floor")
        near = floors.mapInArrow(_reachable(boxes.cells, boxes.low, boxes.high), "vec_id long, v array<long>, home int, floor long, cells array<int>")
        near = near.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(boxes.shards), "cell")
        away = near.withColumn("shard", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))).where("shard <> home")
        found = found.unionByName(_in_shards(sharded, away, k, shards))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
