"""Paths by one chain of joins against a search by hand."""

import random

from quern.operators import graph


def _paths(edges, domain, a, b, longest):
    out, todo = [], [(a, [a], [], [])]
    while todo:
        at, nodes, labels, places = todo.pop()
        for d, o, s, label, t in edges:
            if d == domain and s == at and t is not None and t not in nodes and len(labels) < longest:
                own = (t, [*nodes, t], [*labels, label], [*places, o])
                out.append(own) if t == b else todo.append(own)
    return sorted((len(p), p, n, labels) for _, n, labels, p in out)


def test_paths_in_one_chain(spark):
    rng = random.Random(5)
    ends = [("d" if i % 4 else "e", i, f"n{rng.randint(0, 6)}", None if i % 9 == 0 else f"l{i % 3}", f"n{rng.randint(0, 6)}") for i in range(26)]
    edges = spark.createDataFrame(ends, "domain_id string, ordinal int, source string, label string, target string")
    asked = [("d", f"n{i}", f"n{j}") for i in range(4) for j in range(7)] + [("e", "n1", "n2"), ("x", "n1", "n2")]
    found = graph.paths(edges, spark.createDataFrame(asked, "domain_id string, source string, target string"), most=None, longest=4)
    got = {}
    for r in found.collect():
        got.setdefault((r.domain_id, r.source, r.target), []).append((r["rank"], list(r.nodes), list(r.labels)))
    want = {}
    for key in asked:
        if paths := _paths(ends, *key, 4):
            want[key] = [(i + 1, n, labels) for i, (_, _, n, labels) in enumerate(paths)]
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == want
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 4
