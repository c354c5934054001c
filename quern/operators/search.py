"""Vector top-k: many queries against many nodes, filtered, routed and by levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, dot

#: Scores are compared after rounding, so that the order of a sum does not decide a rank.
DIGITS = 6
#: Numbers of all queries' vectors that may go to every task (32 MB).
MOST_NUMBERS = 1 << 22
#: Numbers of a block of queries, which a task holds, and of a block of nodes, which passes by it; products held at once.
ASKED_NUMBERS, NODE_NUMBERS, PRODUCTS = 1 << 18, 1 << 19, 1 << 19


def ranked(hits: DataFrame, k: int | None, by: str = "query_id", node: str = "node_id") -> DataFrame:
    """Adds ``rank`` (from 1) by falling score, ties by node; only the first ``k`` if it is given.

    Spark limits each partition to ``k`` rows of a query before the shuffle.
    """
    order = Window.partitionBy(by).orderBy(F.desc("score"), node)
    out = hits.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k is not None else out


def top_k(nodes: DataFrame, queries: DataFrame, k: int = 5, measure: Callable[[Column, Column], Column] = cosine) -> DataFrame:
    """query_id, node_id, score, rank of the ``k`` best nodes (node_id, vector) for each query (query_id, query).

    Every query is compared with every node.  Queries whose vectors take up to
    MOST_NUMBERS numbers (counted first) go to all tasks as one matrix, which is
    multiplied with slices of nodes; more are dealt over blocks.  Each task passes
    on its own ``k`` best of a query.  Under cosine a zero vector scores 0;
    vectors that are null, hold null or have another length than the other side's
    take no part.
    """
    nodes, queries = nodes.select("node_id", "vector"), queries.select("query_id", "query")
    if measure in (cosine, dot):
        asked = queries.where("query is not null").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query")).alias("d")).first()
        if asked["n"] * (asked["d"] or 0) <= MOST_NUMBERS:
            return ranked(_multiplied(nodes, queries, k, measure is cosine), k)
        found = _best(nodes.withColumn("_all", F.lit(0)), queries.withColumn("_all", F.lit(0)), "_all", k, measure is cosine, True)
        return ranked(found.where("score is not null"), k)
    score = F.round(measure(F.col("vector"), F.col("query")), DIGITS)
    # Null scores come last in a ranking; a filter before it would compute each product once more.
    return ranked(nodes.join(queries).select("query_id", "node_id", score.alias("score")), k).where("score is not null")


def _matrix(vectors: pa.Array, scale: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of whole vectors by their length: places and matrix, scaled to length one on request."""
    out = {}
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    for size in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
        v = flat.to_numpy(zero_copy_only=False).reshape(len(at), size)
        whole = ~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(at), size).any(axis=1)
        at, v = at[whole], v[whole]
        if scale:
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm != 0)
        out[size] = (at, v)
    return out


class _Kept:
    """The ``k`` best nodes of each of ``n`` queries among the slices of nodes seen, ties to the first node.

    A product is compared with the query's k-th best so far and only looked at
    more closely if it may reach it; what is held is bounded by the queries.
    """

    def __init__(self, n: int, k: int):
        self.k, self.bound, self.most = k, np.full(n, np.inf), max(PRODUCTS, 4 * n * k)
        self.rows, self.keys, self.ids, self.count = [], [], [], 0

    def add(self, lo: int, key: np.ndarray, ids: pa.Array) -> None:
        """Keys (negated scores, null as infinity) of the queries from ``lo`` on and the nodes ``ids``."""
        bound = self.bound[lo : lo + len(key)]
        if self.k < key.shape[1] and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(key, self.k - 1, axis=1)[:, self.k - 1])
        rows, cols = np.nonzero(key <= (bound + 10.0**-DIGITS)[:, None])  # more than rounding may move
        if len(rows):
            self.rows.append(rows + lo)
            self.keys.append(np.round(key[rows, cols], DIGITS))
            self.ids.append(ids.take(pa.array(cols)))
            self.count += len(rows)
        if self.count > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Queries' places, keys and nodes of what is kept; None without any."""
        if not self.count:
            return None
        rows, keys, ids = np.concatenate(self.rows), np.concatenate(self.keys), pa.concat_arrays(self.ids)
        place = np.empty(len(ids), int)
        place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, keys, rows))
        nth = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        last = order[nth == self.k - 1]
        self.bound[rows[last]] = keys[last]
        order = order[nth < self.k]
        out = rows[order], keys[order], ids.take(pa.array(order))
        self.rows, self.keys, self.ids = [[x] for x in out]
        self.count = len(order)
        return out

    def batches(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        found = self.cut()
        if found:
            rows, keys, ids = found
            score = pa.array(np.where(keys == -np.inf, np.nan, -keys) + 0.0, mask=keys == np.inf)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), ids, score], names=["query_id", "node_id", "score"])


def _slices(vectors: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows, of NODE_NUMBERS / 4 numbers at most if vectors are of one length."""
    step = max(1, (NODE_NUMBERS >> 2) // max(1, pc.max(pc.list_value_length(vectors)).as_py() or 1))
    for lo in range(0, len(vectors), step):
        yield lo, min(step, len(vectors) - lo)


def _seen(kept: _Kept, held: dict[int, tuple[np.ndarray, np.ndarray]], ids: pa.Array, vectors: pa.Array, scale: bool) -> None:
    """Slices of nodes compared with the queries ``held``; vectors of no common length take no part."""
    for lo, n in _slices(vectors):
        for size, (at, v) in _matrix(vectors.slice(lo, n), scale).items():
            places, matrix = held.get(size, (np.zeros(0, int), None))
            if not len(places) or not len(at):
                continue
            key, step = ids.slice(lo, n).take(pa.array(at)), max(1, PRODUCTS // len(v))
            for q in range(0, len(places), step):
                found = -(matrix[q : q + step] @ v.T)
                kept.add(q, np.where(np.isnan(found), -np.inf, found), key)


def _multiplied(nodes: DataFrame, queries: DataFrame, k: int, scale: bool) -> DataFrame:
    """The ``k`` best nodes of each query in each task, by products of matrices."""
    asked = queries.where("query is not null").toArrow()  # at most MOST_NUMBERS numbers
    ids = asked.column("query_id").combine_chunks() if asked.num_rows else asked.column("query_id")
    held = _matrix(asked.column("query").combine_chunks(), scale) if asked.num_rows else {}
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("node_id", nodes.schema["node_id"].dataType), T.StructField("score", T.DoubleType())])
    shared = nodes.sparkSession.sparkContext.broadcast((pa.table({"query_id": ids}), held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value
        names = own.column("query_id").combine_chunks()
        kept = {size: _Kept(len(at), k) for size, (at, _) in rows.items()}
        for batch in batches:
            for size, group in rows.items():
                _seen(kept[size], {size: group}, batch.column("node_id"), batch.column("vector"), scale)
        for size, (at, _) in rows.items():
            yield from kept[size].batches(names.take(pa.array(at)))

    return nodes.where("vector is not null").mapInArrow(run, kinds)


def _paired(nodes: DataFrame, queries: DataFrame, label: str, each: Callable[[], Callable], kinds: T.StructType) -> DataFrame:
    """Rows that ``each`` makes of all pairs of nodes and queries with one label, in blocks.

    A label's queries and nodes are dealt over blocks of bounded size; each block
    of queries meets each block of nodes in one task, which holds the queries and
    lets the nodes pass.  ``each()`` is called for a pair of blocks and gives a
    function of (query_id, query) and one of (node_id, vector) that yields rows, or with
    None what is left at the end.
    """
    def counted(rows: DataFrame, vector: str, numbers: int, name: str) -> DataFrame:
        width = F.greatest(F.coalesce(F.max(F.size(vector)), F.lit(1)), F.lit(1))
        return rows.groupBy(F.col(label).alias(name)).agg(F.ceil(F.count(F.lit(1)) * width / numbers).cast("int").alias(f"{name}_n"))

    by_nodes, by_asked = counted(nodes, "vector", NODE_NUMBERS, "_node"), counted(queries, "query", ASKED_NUMBERS, "_asked")
    sizes = by_nodes.join(by_asked, F.col("_node") == F.col("_asked")).select(F.col("_node").alias("_label"), "_node_n", "_asked_n")  # a row for each label

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(sizes), F.col(label) == F.col("_label"))
        return placed.withColumn(own, F.pmod("_at", f"{own}_n").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1)))

    keys = ["_label", "_asked", "_node"]
    left = dealt(queries, "_asked", "_node").select(*keys, F.lit(False).alias("_side"), "query_id", F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"), F.col("query").alias("v"))
    right = dealt(nodes, "_node", "_asked").select(*keys, F.lit(True).alias("_side"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "node_id", F.col("vector").alias("v"))
    rows = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, step = None, [], None
        for batch in batches:
            codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in (*keys, "_side")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                key = tuple(part.column(c)[0].as_py() for c in keys)
                if key != now:
                    if step:
                        yield from step(None, None)
                    now, asked, step = key, [], None
                if not part.column("_side")[0].as_py():
                    asked.append(pa.table([part.column("query_id"), part.column("v")], names=["query_id", "v"]))
                    continue
                if not step:
                    held = pa.concat_tables(asked).combine_chunks()
                    step = each()(held.column("query_id").combine_chunks(), held.column("v").combine_chunks())
                yield from step(part.column("node_id"), part.column("v"))
        if step:
            yield from step(None, None)

    return rows.mapInArrow(run, kinds)


def _best(nodes: DataFrame, queries: DataFrame, label: str, k: int, scale: bool, zeros: bool) -> DataFrame:
    """The ``k`` best nodes of each query in each pair of blocks with one label.

    Vectors that have no product score null; with ``scale``, zero vectors do too, unless ``zeros``.
    """
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("node_id", nodes.schema["node_id"].dataType), T.StructField("score", T.DoubleType())])

    def each():
        def held(names: pa.Array, vectors: pa.Array):
            kept, own = _Kept(len(names), k), _matrix(vectors, scale)

            def step(ids: pa.Array | None, seen: pa.Array | None) -> Iterator[pa.RecordBatch]:
                if ids is None:
                    yield from kept.batches(names)
                    return
                for lo, n in _slices(seen):
                    groups, key = _matrix(seen.slice(lo, n), scale), ids.slice(lo, n)
                    for q in range(0, len(names), wide := max(1, PRODUCTS // n)):
                        found = np.full((min(wide, len(names) - q), n), np.inf)
                        for size, (at, v) in groups.items():
                            places, matrix = own.get(size, (np.zeros(0, int), np.zeros((0, size))))
                            mine = (places >= q) & (places < q + wide)
                            rows, m = places[mine] - q, matrix[mine]
                            if not len(rows) or not len(at):
                                continue
                            got = -(m @ v.T)
                            got[np.isnan(got)] = -np.inf
                            if scale and not zeros:
                                got[np.ix_(~m.any(axis=1), np.isfinite(v).all(axis=1))] = np.inf
                                got[np.ix_(np.isfinite(m).all(axis=1), ~v.any(axis=1))] = np.inf
                            if got.shape == found.shape:
                                found = got
                            else:
                                found[np.ix_(rows, at)] = got
                        kept.add(q, found, key)

            return step

        return held

    return _paired(nodes.select("node_id", "vector", label), queries.select("query_id", "query", label), label, each, kinds)


def nearest(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, node_id, score of the node (node_id, vector) nearest to each query (query_id, query), rows of queries each.

    Nodes of up to MOST_NUMBERS numbers (counted first) go to all tasks and the
    queries pass by them; more are dealt over blocks.  Pairs without a cosine
    take no part; a repeated query_id gives several rows.
    """
    nodes, queries = nodes.select("node_id", "vector"), queries.select("query_id", "query")
    size = nodes.where("vector is not null").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if size["n"] * (size["d"] or 0) > MOST_NUMBERS:
        found = _best(nodes.withColumn("_all", F.lit(0)), queries.withColumn("_all", F.lit(0)), "_all", 1, True, False)
        return ranked(found.where("score is not null"), 1).drop("rank")
    told = nodes.where("vector is not null").sort("node_id").toArrow()  # at most MOST_NUMBERS numbers
    ids = told.column("node_id").combine_chunks() if told.num_rows else told.column("node_id")
    held = _matrix(told.column("vector").combine_chunks(), True) if told.num_rows else {}
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("node_id", nodes.schema["node_id"].dataType), T.StructField("score", T.DoubleType())])
    shared = nodes.sparkSession.sparkContext.broadcast((pa.table({"node_id": ids}), {d: (at[live], v[live]) for d, (at, v) in held.items() for live in [v.any(axis=1)]}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value
        names = own.column("node_id").combine_chunks()
        for batch in batches:
            for lo, n in _slices(batch.column("query")):
                for d, (at, v) in _matrix(batch.column("query").slice(lo, n), True).items():
                    places, matrix = rows.get(d, (np.zeros(0, int), None))
                    at, v = at[live := v.any(axis=1)], v[live]
                    step = max(1, PRODUCTS // max(1, len(places)))
                    for q in range(0, len(at), step) if len(places) else ():
                        score = np.round(v[q : q + step] @ matrix.T, DIGITS)
                        best = np.where(np.isnan(score), np.inf, score).argmax(axis=1)  # the first of equal ones
                        found = score[np.arange(len(best)), best] + 0.0
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at[q : q + step] + lo)), names.take(pa.array(places[best])), pa.array(found)], names=["query_id", "node_id", "score"])

    return queries.where("query is not null").mapInArrow(run, kinds)


def metrics(nodes: DataFrame, queries: DataFrame, label: str) -> DataFrame:
    """query_id, node_id, cosine, dot, negated_distance (6, 6 and 5 digits) of all pairs with one label, a row for each.

    Nodes are (node_id, vector, label), queries (query_id, query, label).  As of
    the Column functions, a cosine is null where a vector is zero, and all three
    where one is null, holds null or has another length.
    """
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("node_id", nodes.schema["node_id"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("cosine", "dot", "negated_distance"))])

    def each():
        def held(names: pa.Array, vectors: pa.Array):
            own = _matrix(vectors, False)

            def step(ids: pa.Array | None, seen: pa.Array | None) -> Iterator[pa.RecordBatch]:
                for lo, n in _slices(seen) if ids is not None else ():
                    groups, key = _matrix(seen.slice(lo, n), False), ids.slice(lo, n)
                    wide = max(1, (PRODUCTS >> 2) // n)
                    for q in range(0, len(names), wide):
                        most = min(wide, len(names) - q)
                        out, known = np.zeros((3, most, n)), np.zeros((2, most, n), bool)
                        for size, (at, v) in groups.items():
                            places, matrix = own.get(size, (np.zeros(0, int), np.zeros((0, size))))
                            mine = (places >= q) & (places < q + wide)
                            rows, m = places[mine] - q, matrix[mine]
                            if not size or not len(rows) or not len(at):
                                if not size:  # the sum of nothing is 0
                                    known[(1, *np.ix_(rows, at))] = True
                                continue
                            square, other = (m * m).sum(axis=1)[:, None], (v * v).sum(axis=1)[None, :]
                            dots = m @ v.T
                            lengths = np.sqrt(square) * np.sqrt(other)
                            whole = square + other
                            far = whole - 2 * dots
                            i, j = np.nonzero(~(far > 0.01 * whole))  # near copies: the difference itself
                            for a in range(0, len(i), near := max(1, PRODUCTS // size)):
                                d = m[i[a : a + near]] - v[j[a : a + near]]
                                far[i[a : a + near], j[a : a + near]] = (d * d).sum(axis=1)
                            place = np.ix_(rows, at)
                            with np.errstate(invalid="ignore"):
                                out[(0, *place)] = np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths != 0)
                                out[(1, *place)], out[(2, *place)] = dots, -np.sqrt(far)
                            known[(0, *place)], known[(1, *place)] = lengths != 0, True
                        digits = (DIGITS, DIGITS, DIGITS - 1)
                        columns = [pa.array((np.round(x, d) + 0.0).ravel(), mask=~y.ravel()) for x, y, d in zip(out, (known[0], known[1], known[1]), digits, strict=True)]
                        who = pa.array(np.repeat(np.arange(q, q + most), n))
                        yield pa.RecordBatch.from_arrays([names.take(who), key.take(pa.array(np.tile(np.arange(n), most))), *columns], names=[f.name for f in kinds])

            return step

        return held

    return _paired(nodes.select("node_id", "vector", label), queries.select("query_id", "query", label), label, each, kinds)


def top_one(nodes: DataFrame, vector: Column, k: int = 5, measure: Callable[[Column, Column], Column] = cosine) -> DataFrame:
    """The ``k`` best nodes for one vector, without a shuffle of the nodes (take-ordered)."""
    score = F.round(measure(F.col("vector"), vector), DIGITS)
    return nodes.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "node_id").limit(k)


def filtered(nodes: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Nodes that meet all conditions: equal values, and for a list all of its members in an array column."""
    for name, value in conditions.items():
        for v in value if isinstance(value, (list, tuple)) else [None]:
            nodes = nodes.where(F.array_contains(name, v) if v is not None else F.col(name) == F.lit(value))
    return nodes


def routed(nodes: DataFrame, queries: DataFrame, routes: DataFrame, label: str, k: int = 5) -> DataFrame:
    """Top-k among the nodes whose label is in the query's route (query_id, label); unknown labels count for nothing."""
    wanted = routes.select("query_id", F.trim(label).alias(label) if dict(routes.dtypes)[label] == "string" else label).distinct()
    return ranked(_best(nodes, queries.select("query_id", "query").join(wanted, "query_id"), label, k, True, False), k)


def memberships(nodes: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """(node_id, label, similarity) for every label (label, centre) as near as ``least``; labels are few."""
    near = nodes.select("node_id", "vector").join(labels.select("label", "centre")).withColumn("similarity", F.round(cosine(F.col("vector"), F.col("centre")), DIGITS))
    return near.where(F.col("similarity") >= least).select("node_id", "label", "similarity")


def multi_routed(nodes: DataFrame, members: DataFrame, queries: DataFrame, routes: DataFrame | None, k: int = 5, text: str | None = None) -> DataFrame:
    """Top-k over nodes that share a label with the query's route (all labels if it has none), each text once."""
    if routes is not None:
        told = queries.select("query_id").join(routes, "query_id", "left")
        every = told.where("label is null").select("query_id").join(members.select("label").distinct())
        pairs = told.where("label is not null").unionByName(every).join(members.select("node_id", "label"), "label").select("query_id", "node_id").distinct()
        pairs = pairs.join(queries, "query_id").join(nodes, "node_id")
    else:
        pairs = nodes.join(members.select("node_id"), "node_id", "left_semi").join(queries)
    scored = pairs.withColumn("score", F.round(cosine(F.col("vector"), F.col("query")), DIGITS))
    if text:
        first = Window.partitionBy("query_id", text).orderBy(F.desc("score"), "node_id")
        scored = scored.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return ranked(scored.select("query_id", "node_id", "score"), k)


def cascade(levels: list[tuple[DataFrame, int]], queries: DataFrame) -> list[DataFrame]:
    """Top-k level by level, each among the children of the hits above.

    A level is (node_id, parent_id, vector) and its k; the first has no parents to meet.
    """
    out: list[DataFrame] = []
    for nodes, k in levels:
        if out:
            above = out[-1].select("query_id", F.col("node_id").alias("parent_id"))
            pairs, by = queries.join(above, "query_id"), "parent_id"
        else:
            nodes, pairs, by = nodes.withColumn("_all", F.lit(0)), queries.withColumn("_all", F.lit(0)), "_all"
        out.append(ranked(_best(nodes, pairs, by, k, True, False), k))
    return out


def hit_line(fields: str, *values: Column, digits: int = 4) -> Column:
    """A hit (rank, score) as a line: its rank, the named fields by a printf pattern, and the score."""
    return F.format_string(f"%d. {fields}, score %.{digits}f", F.col("rank"), *values, F.col("score"))


def with_payload(hits: DataFrame, payload: DataFrame) -> DataFrame:
    """Hits with what their nodes stand for: the parent card, the window, the original text (node_id, ...)."""
    return hits.join(payload, "node_id")
