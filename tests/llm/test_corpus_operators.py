"""Exact dedup, n-gram join, mixing, packing and top-k search against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import components as cc
from quern.llm import exact_dedup, mixing, ngram_join, packing, topk_search
from quern.llm.queries import PACKING_VOCABULARY, vocabulary
from quern.llm.shingles import shingle_sets


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "name": F.lit("x"), "rep": F.lit(0), "kept": F.lit(True), "size": F.lit(0)})


def words(r, n, of=500):
    return [f"w{r.randrange(of)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, a common passage, short and odd texts, one very long text."""
    r = random.Random(1)
    passage = words(r, 70)
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO words", "a b c d", "a b c d e", "a b c d e f", "ä ö ü ß é a", "X" * 200_000]
    for _ in range(40):
        base = words(r, r.choice([8, 12, 20, 60, 200, 700]))
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            near = list(base)
            for _ in range(max(1, len(near) // r.choice([15, 40, 120]))):
                near[r.randrange(len(near))] = f"w{r.randrange(500)}"
            texts.append(" ".join(near))
    for _ in range(30):
        texts.append(" ".join(words(r, r.randrange(10, 90)) + passage + words(r, r.randrange(20))))
    texts += [r.choice(texts) for _ in range(60)] + [texts[20]] * 40
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_exact_groups(spark, corpus):
    by = defaultdict(list)
    for i, t in corpus:
        by[t or ""].append(i)
    rows = exact_dedup.exact_groups(documents(spark, corpus)).collect()
    assert len(rows) == len(corpus)
    texts = dict(corpus)
    for x in rows:
        group = by[texts[x.doc_id] or ""]
        assert (x.keep_id, x.group_size, x.kept) == (max(group), len(group), x.doc_id == max(group))
        assert x.text_sha256 == hashlib.sha256((texts[x.doc_id] or "").encode()).hexdigest()
    docs = documents(spark, corpus)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(map(max, by.values()))
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_one_of_identical_rows_is_kept(spark):
    rows = [(1, "same"), (1, "same"), (2, "other"), (None, "other"), (None, "null"), (None, "null"), (3, None), (4, ""), (5, "two texts"), (5, "of one id")]
    found = [(x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_groups(documents(spark, rows).withColumn("row", F.lit(0))).collect()]
    want = [(1, 1, 2, True), (1, 1, 2, False), (2, 2, 2, True), (None, 2, 2, False), (None, None, 2, True), (None, None, 2, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (5, 5, 1, True)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_stages_keep_rows_by_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "alone and clean with some words"), (None, "shared by two rows here"), (4, "shared by two rows here"), (7, "the same row twice over"), (7, "the same row twice over"), (9, long), (9, "copied text under two ids"), (8, "copied text under two ids"), (9, "copied text under two ids"), (None, "null twice in a row here"), (None, "null twice in a row here")]
    docs = documents(spark, rows).withColumn("_row", F.lit(5))
    want = [(None, "alone and clean with some words"), (4, "shared by two rows here"), (7, "the same row twice over"), (9, long), (9, "copied text under two ids"), (None, "null twice in a row here")]
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(want, key=str)
    near = long.replace("w59", "other")
    more = documents(spark, [*rows, (None, near), (12, near)])
    want[4] = (8, "copied text under two ids")  # of near copies the least doc_id stays
    assert sorted(((x.doc_id, x.text) for x in ngram_join.drop_near_copies(more).collect()), key=str) == sorted(want, key=str)


def test_clashing_chunk_names_are_told_apart(spark, monkeypatch):
    rows = [(1, 11, "s1", b"N", b"a"), (1, 12, "s2", b"N", b"b"), (3, 13, "s1", b"N", b"a"), (4, 14, "s4", b"", b"")]
    made = spark.createDataFrame([(i, row, sha, bytearray(name * 8), bytearray(digest * 36)) for i, row, sha, name, digest in rows], "doc_id long, row long, text_sha256 string, recipe binary, digests binary")
    clashes = exact_dedup.chunk_names(made).where("least <> most")
    assert clashes.count() == 1
    recipes = {x.row: bytes(x.recipe) for x in exact_dedup._renamed(made, clashes).collect()}
    assert recipes[11] == recipes[13] != recipes[12] and recipes[14] == b""


def test_chunks_follow_content():
    r = np.random.default_rng(0)
    raw = r.integers(0, 256, 200_000).astype(np.uint8)

    def pieces(data):
        ends = exact_dedup.chunk_ends(exact_dedup.cut_points(data), 0, len(data))
        assert ends[-1] == len(data) and all(b - a <= exact_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
        return {data[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    a, b = pieces(raw), pieces(np.concatenate([raw[:50], raw]))
    assert len(a & b) > 0.9 * len(a)


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def classes_of(sets):
    parent, posts = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in posts[s])
        for s in sets[i]:
            posts[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("stars", [False, True])
def test_near_duplicates(spark, corpus, stars, monkeypatch):
    if stars:
        monkeypatch.setattr(cc, "ONE_TASK", 0)
    sets = sets_of(corpus)
    want = classes_of(sets)
    docs = documents(spark, corpus)
    rows = ngram_join.near_duplicates(docs).collect()
    assert len(rows) == len(corpus)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == {i: (len(sets[i]), want[i]) for i in sets}
    if not stars:
        kept = ngram_join.drop_near_copies(docs)
        assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(want.values())
        assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_similar_sets_share_a_signature(seed):
    r = np.random.default_rng(seed)
    heat = r.integers(0, 5, 1 << ngram_join.COUNT_BITS).astype(np.uint8)
    for n in [3, 4, 5, 7, 11, 15, 16, 21, 63, 64, 85, 255, 256, 900, 5000]:
        for _ in range(20):
            union = np.unique(r.integers(0, 1 << 63, n + 4).astype(np.uint64))[:n]
            both = -(-3 * n // 4)
            extra = n - both
            cut = r.integers(0, extra + 1)
            pick = r.permutation(n)
            a, b = np.sort(np.delete(union, pick[:cut])), np.sort(np.delete(union, pick[cut:extra]))
            (x, p), (y, q) = ngram_join.signatures(a, heat), ngram_join.signatures(b, heat)
            if len(a) == len(b) == both and n == both:
                continue  # equal sets are one class
            early, late = dict(zip(x.tolist(), p.tolist(), strict=True)), dict(zip(y.tolist(), q.tolist(), strict=True))
            assert any(early[k] + late[k] <= ngram_join.SLACK for k in early.keys() & late.keys())
            assert ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    w, x = " ".join(f"w{i}" for i in range(40)), " ".join(f"x{i}" for i in range(40))
    rows = [(1, w), (1, x), (2, w + " q"), (3, x + " q"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "only null ids here now"), (5, "")]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert found == sorted([(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (None, 2, 7), (7, 2, 7), (None, 1, None), (5, 0, 5)], key=str)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(12)
    for n, m in ((5, 6), (60, 70), (127, 130), (1000, 1300)):
        for _ in range(20):
            a, b = (np.unique(r.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
            b[: n // 2] = a[: n // 2]
            b = np.unique(b)
            bound, folded = ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b)), ngram_join._folded([ngram_join.sketch(a), ngram_join.sketch(b)])
            assert bound == np.bitwise_count(folded[0] ^ folded[1]).sum() and bound <= len(np.setxor1d(a, b))


def test_shingles_match_words():
    rows = ["A b c d e F", "a B c d e f", "a b c d", "", "x", "é a b c d", "a\x1cb c d e f"]
    raw = "".join(rows).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in rows)])
    found = shingle_sets(np.frombuffer(raw, np.uint8), offsets)
    want = sets_of(list(enumerate(rows)))
    assert [len(s) for s in found] == [len(want[i]) for i in range(len(rows))]
    assert (found[0] == found[1]).all() and len(np.intersect1d(found[0], found[5])) == 0


def test_components(spark, monkeypatch):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(90)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert {x.u: x.component for x in cc.components(df).collect()} == want
    monkeypatch.setattr(cc, "ONE_TASK", 0)
    assert {x.u: x.component for x in cc.components(df).collect()} == want


@pytest.mark.parametrize("case", ["equal", "tiny", "mixed"])
def test_deal_stays_within_a_block_of_the_target(case):
    r = random.Random(8)
    weights, blocks = {
        "equal": ({f"s{i:02}": 1.0 for i in range(20)}, {f"s{i:02}": 1000 for i in range(20)}),
        "tiny": ({"a": 0.9999, "b": 0.0001}, {"a": 30000, "b": 40}),
        "mixed": ({f"s{i}": r.random() ** 3 + 1e-5 for i in range(12)}, {f"s{i}": r.randrange(1, 900) for i in range(12)}),
    }[case]
    done, ideal, exact = Counter(), dict.fromkeys(blocks, Fraction(0)), {s: Fraction(w) for s, w in weights.items()}
    for slot, (s, j) in enumerate(mixing.deal(blocks, weights)):
        assert j == done[s]
        done[s] += 1
        time = Fraction(1)
        while time:  # one slot of the ideal mixture, in which sources may run out
            left = [x for x in blocks if ideal[x] < blocks[x]]
            total = sum(exact[x] for x in left)
            step = min(time, *((blocks[x] - ideal[x]) * total / exact[x] for x in left))
            for x in left:
                ideal[x] += step * exact[x] / total
            time -= step
        if slot % 7 == 0 or case == "mixed":
            assert all(abs(done[x] - ideal[x]) < 1 for x in blocks)
        if case != "mixed" and slot == 12000:
            break
    else:
        assert done == blocks


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randrange(0, 300) or None, r.choice(["a", "a", "a", "b", None])) for i in range(600)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string").withColumns({"size": F.lit(0), "slot": F.lit("x"), "_place": F.lit(1)})
    found = mixing.schedule(docs, {"a": 1.0, "b": 2.0, "": 1.0}, block=500).collect()
    assert len(found) == 601
    by, size = defaultdict(set), Counter()
    for i, t, s in [*rows, rows[0]]:
        size[s or ""] += max(1, len(t or ""))
    for x in found:
        assert 0 <= x.position < 500 and x.slot >= 0
        by[x.slot].add((x.source, x.source_block))
    assert all(len(v) == 1 for v in by.values())
    blocks = {s: -(-n // 500) for s, n in size.items()}
    assert all(max(x.source_block for x in found if x.source == s) < n for s, n in blocks.items())
    first = sorted(by)[:40]
    assert abs(sum(next(iter(by[s]))[0] == "b" for s in first) - 20) <= 1
    mixed = mixing.mix(docs, block=500)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert mixing.schedule(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_very_many_sources(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "'text' as text", "concat('s', id) as source")
    slots = sorted(r.slot for r in mixing.schedule(docs).select("slot").collect())
    assert slots == list(range(12_000))
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"s1": -1.0})


def test_level_array_minimises_the_sum_of_squares():
    r = random.Random(5)
    levels, window = packing.LevelArray(16), 16
    for _ in range(400):
        size = r.randint(1, 15)
        n = levels.count.copy()

        def after(level, n=n, size=size):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < window:
                m[level + size] += 1
            return int((m[1:window] ** 2).sum())

        options = [0, *(h for h in range(1, window - size + 1) if n[h])]
        assert after(levels.choose(size)) == min(map(after, options))
        levels.place(size, None)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    file = vocabulary(PACKING_VOCABULARY)
    plain = Tokenizer.from_file(file)
    rows = [*corpus, (9001, "ΑΣ Σίσυφος I'LL é <|endoftext|> a\x1cb 12,3. 日本語!!"), (9002, "word " * 9000)]
    texts = dict(rows)
    found = packing.pack(documents(spark, rows).coalesce(2), file, window=256).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for x in found:
        by[x.doc_id].append(x)
        sequences[x.sequence_id].append(x)
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], np.uint32), 0
        for x in sorted(by[i], key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at and x.length > 0
            at += x.length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(documents(spark, rows).limit(0), file).count() == 0
    special = documents(spark, [(1, "x <|endoftext|> y"), (1, "x<|endoftext|>y")])
    assert [r.doc_tokens for r in packing.pack(special, file).orderBy("doc_tokens").collect()] == [4, 4]
    assert min(r.doc_tokens for r in packing.pack(special, file, special_as_text=True).collect()) > 4


@pytest.mark.parametrize("shard_rows", [1 << 15, 60])
def test_top_k(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk_search, "LEAF", 8)
    r = np.random.default_rng(6)
    v = r.normal(0, 0.3, (300, 6)).round(2)
    v[40:60] = v[40]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1050, [2e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(0), "v": F.lit(1), "shard": F.lit(2)})
    whole = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i is not None and i not in (1000, 1001, 1002, 1003)}
    want = {}
    for q in whole:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q))[:5]
            want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    found = topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in found} == want and len(found) == len(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).count() == 2


@pytest.fixture(scope="module")
def clustered():
    """2,000 vectors in 20 clusters far apart, a third of all one vector."""
    r = np.random.default_rng(8)
    v = r.normal(0, 1, (20, 6)).repeat(100, axis=0) * 4 + r.normal(0, 0.05, (2000, 6))
    v[r.random(2000) < 0.33] = v[0]
    return v[r.permutation(2000)]


def test_top_k_of_clusters_and_a_hot_vector(spark, clustered, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 100)
    sent, own = [], topk_search._in_shards
    monkeypatch.setattr(topk_search, "_in_shards", lambda vectors, queries, k, shards: sent.append((queries.count(), vectors.groupBy("shard").count().agg(F.max("count")).head()[0], shards)) or own(vectors, queries, k, shards))
    df = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(clustered)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * clustered).astype(np.int64)
    want = set()
    for q in range(0, 2000, 50):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want
    (asked, largest, shards), (away, _, _) = sent
    assert asked == 40 and shards >= 20 and largest < 200
    assert away < 40 * (shards - 1) / 2  # boxes that cannot reach the k-th score are not asked


def test_cells_take_all_rows():
    r = np.random.default_rng(9)
    rows = r.integers(-9, 9, (2000, 4))
    cells = topk_search.Cells(rows, 12)
    assert len(set(cells.of(rows).tolist())) == 12 and np.bincount(cells.of(rows)).max() < 500
    assert topk_search.Cells(rows[:0], 5).of(rows).tolist() == [0] * 2000
    assert set(topk_search.Cells(np.ones((50, 4)), 5).of(rows).tolist()) == {0}
    assert topk_search.Cells(np.zeros((3, 0)), 5).of(np.zeros((2, 0))).tolist() == [0, 0]


def test_kd_tree_boxes_hold_their_rows():
    r = np.random.default_rng(7)
    tree = topk_search.KDTree(np.arange(3000), r.integers(-99, 99, (3000, 5)))
    assert sorted(tree.ids) == list(range(3000))
    for node, (a, b) in enumerate(tree.range):
        assert (tree.rows[a:b].min(axis=0) == tree.low[node]).all() and (tree.rows[a:b].max(axis=0) == tree.high[node]).all()
        if tree.child[node]:
            left, right = (tree.range[c] for c in tree.child[node])
            assert left[0] == a and left[1] == right[0] and right[1] == b
