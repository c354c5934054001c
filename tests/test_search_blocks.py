"""Searches and metrics by blocks: against brute force over odd vectors, with many blocks a label."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import search

NODES = "node_id long, vector array<float>, label int"
ASKED = "query_id long, query array<float>, label int"


def _rows(n, seed):
    rng = random.Random(seed)
    odd = ([0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0], [math.nan, 1.0, 0.0])
    rows = []
    for i in range(n):
        vector = odd[i // 7 % len(odd)] if i % 7 == 0 else [float(rng.randint(-3, 3)) for _ in range(3)]
        rows.append((i, vector, None if i % 13 == 0 else i % 2))
    return rows


def _cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a + b:
        return None
    size = math.hypot(*a) * math.hypot(*b)
    return None if size == 0 else round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) + 0.0


def _order(score):
    return (1, 0.0) if score is None else (0, -math.inf if math.isnan(score) else -score)


def _top(nodes, asked, k):
    want = {}
    for q, v, route in asked:
        found = sorted(((*_order(s := _cosine(v, w)), n, s) for n, w, label in nodes if label is not None and label in route))[:k]
        want |= {(q, i + 1): (x[2], x[3]) for i, x in enumerate(found)}
    return want


def _same(found, want):
    got = {(r.query_id, r.rank): (r.node_id, r.score) for r in found}
    assert len(found) == len(got) and got.keys() == want.keys()
    for key, (node, score) in want.items():
        assert got[key][0] == node and repr(got[key][1]) == repr(score), key


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(search, "NODE_NUMBERS", 60)
    monkeypatch.setattr(search, "ASKED_NUMBERS", 15)


def _plain(plan):
    """No product of a pair of rows is left to the plan's own expressions."""
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in text and "aggregate(" not in text.lower().replace("aggregate [", "")


def test_cascade_by_blocks(spark, small_blocks):
    nodes, asked = _rows(200, 1), _rows(40, 2)
    top = [(i, [float(i == 0), float(i == 1), 0.5]) for i in range(2)]
    leaves = spark.createDataFrame(nodes, NODES).withColumnRenamed("label", "parent_id")
    levels = [(spark.createDataFrame(top, "node_id int, vector array<float>"), 1), (leaves, 5)]
    first, last = search.cascade(levels, spark.createDataFrame(asked, ASKED).drop("label"))
    _plain(last)
    above = _top([(i, v, 0) for i, v in top], [(q, v, {0}) for q, v, _ in asked], 1)
    _same(first.collect(), above)
    _same(last.collect(), _top(nodes, [(q, v, {above[q, 1][0]}) for q, v, _ in asked], 5))


def test_routed_by_blocks(spark, small_blocks):
    nodes, asked = _rows(200, 3), _rows(40, 4)
    routes = [(q, x) for q, _, label in asked for x in ((label,) if q % 3 else (0, 1, 1, 9))]
    found = search.routed(spark.createDataFrame(nodes, NODES), spark.createDataFrame(asked, ASKED).drop("label"), spark.createDataFrame(routes, "query_id long, label int"), "label")
    _plain(found)
    _same(found.collect(), _top(nodes, [(q, v, {x for p, x in routes if p == q}) for q, v, _ in asked], 5))


def test_generated_labels_by_blocks(spark, small_blocks):
    nodes, asked = _rows(120, 5), _rows(30, 6)
    routes = [(q, " 1 " if q % 2 else "0") for q, _, _ in asked]
    held = spark.createDataFrame(nodes, NODES).withColumn("label", F.col("label").cast("string"))
    found = search.routed(held, spark.createDataFrame(asked, ASKED).drop("label"), spark.createDataFrame(routes, "query_id long, label string"), "label", k=3)
    _plain(found)
    _same(found.collect(), _top(nodes, [(q, v, {q % 2}) for q, v, _ in asked], 3))


def test_metrics_by_blocks(spark, small_blocks):
    nodes, asked = _rows(120, 7), _rows(30, 8)
    found = search.metrics(spark.createDataFrame(nodes, NODES), spark.createDataFrame(asked, ASKED), "label").collect()
    pairs = {(r.query_id, r.node_id): r for r in found}
    assert len(pairs) == len(found) == sum(a[2] is not None and a[2] == b[2] for a in asked for b in nodes)
    by_id, of = {i: v for i, v, _ in nodes}, {i: v for i, v, _ in asked}
    for (q, n), r in pairs.items():
        a, b = of[q], by_id[n]
        assert repr(r.cosine) == repr(_cosine(a, b))
        if a is None or b is None or len(a) != len(b) or None in a + b:
            assert r.dot is None and r.negated_distance is None
        else:
            assert repr(r.dot) == repr(round(sum(x * y for x, y in zip(a, b, strict=True)), 6) + 0.0)
            assert repr(r.negated_distance) == repr(round(-math.dist(a, b), 5) + 0.0)


def test_top_k_of_many_copies_by_slices(spark, monkeypatch):
    monkeypatch.setattr(search, "NODE_NUMBERS", 60)
    nodes = [(i, [float(i % 3), 1.0], 0) for i in range(500)]
    asked = [(1, [1.0, 1.0], 0), (2, [0.0, 2.0], 0), (3, [0.0, 0.0], 0)]
    want = {(q, i + 1): x for q, v, _ in asked for i, x in enumerate(sorted((-(_cosine(v, w) or 0.0), n) for n, w, _ in nodes)[:7])}
    for most in (search.MOST_NUMBERS, 1):  # as one matrix, and by blocks
        monkeypatch.setattr(search, "MOST_NUMBERS", most)
        found = search.top_k(spark.createDataFrame(nodes, NODES), spark.createDataFrame(asked, ASKED), 7)
        assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.query_id, r.rank): (-r.score + 0.0, r.node_id) for r in found.collect()} == {k: (s + 0.0, n) for k, (s, n) in want.items()}
