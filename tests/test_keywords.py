"""Keywords against brute force, with terms beyond the table of frequent ones and repeated ids."""

import math
import random
from collections import Counter

import pytest

from quern.operators import prepare


@pytest.mark.parametrize("most", [1 << 17, 6, 1])
@pytest.mark.parametrize("odd", [False, True])
def test_keywords(spark, monkeypatch, most, odd):
    monkeypatch.setattr(prepare, "MOST_TERMS", most)
    rng = random.Random(most)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.08))}" for _ in range(rng.randint(1, 40)))) for i in range(60)] + [(60, ""), (61, None), (62, "w1"), (63, "w1 w1 w2")]
    if odd:
        rows += [(3, "w1 w9 w9 w200"), (None, "w5 w5"), (None, "w5 w7"), (3, None)]
    held = {}
    for i, text in rows:
        held.setdefault(i, Counter()).update((text or "").split())
    df = Counter(t for c in held.values() for t in c)
    want = []
    for i, c in held.items():
        best = sorted(((-round(tf * math.log((len(rows) + 1) / (df[t] + 1)), 6), t) for t, tf in c.items()))[:5]
        want += [(str(i), r + 1, t, -w + 0.0) for r, (w, t) in enumerate(best)]
    found = prepare.keywords(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r["rank"], r.term, r.weight + 0.0) for r in found.collect()) == sorted(want)
