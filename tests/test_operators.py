"""Rules that the tables do not exercise, on crafted rows."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions.text import clean, clean_slides
from quern.operators import bm25, chunking, context, fusion, graph, prepare, refine, search
from quern.plans import flows
from quern.providers import HashedWords, PandasEmbedder, Scripted, WordOverlap, messages
from quern.sources import readers, sinks
from quern.streaming import ingest


def one(df):
    return df.collect()[0][0]


def column(spark, expression, **values):
    return one(spark.createDataFrame([tuple(values.values())], list(values)).select(expression))


def test_clean(spark):
    text = "﻿ ﬁne​\x07 \r\n\r\n\n  Ｂ \r c "
    assert column(spark, clean(F.col("t")), t=text) == "fine\nB\nc"
    assert column(spark, clean(F.col("t"), F.col("s")), t="Title: x\n# **Head**\n---\n[Speaker Notes]: say", s=".PPTX") == "Head\nsay"
    assert "#" not in column(spark, clean_slides(F.col("t")), t="a # b # c ### d #")


def test_fixed_chunks_reassemble(spark):
    r = random.Random(3)
    docs = [(i, "".join(r.choice("añ😀 x") for _ in range(n))) for i, n in enumerate([0, 1, 49, 50, 51, 499, 500, 501, 950, 951, 1000])]
    rows = chunking.fixed(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    for doc, text in docs:
        own = [x for x in rows if x.doc_id == doc]
        assert bool(own) == bool(text)
        assert all(text[x.chunk_start : x.chunk_end] == x.text for x in own)
        assert "".join(x.text[50 if x.chunk_index else 0 :] for x in own) == text
    assert [(x.chunk_start, x.chunk_end) for x in rows if x.doc_id == 10] == [(0, 500), (450, 950), (900, 1000)]
    with pytest.raises(ValueError, match="overlap"):
        chunking.fixed(spark.createDataFrame(docs, "doc_id long, text string"), 10, 10)


def test_recursive_chunks_join_to_the_text(spark):
    text = "One two three. Four five!\n\nSix; seven, eight nine ten " * 30 + "x" * 50
    rows = chunking.recursive(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), 12).orderBy("chunk_index").collect()
    assert "".join(r.text for r in rows) == text
    assert all(chunking.default_tokens(r.text) <= 12 for r in rows)


def test_structured(spark):
    schema = "doc_id long, text string, suffix string, title string, sections array<string>"
    long = ["s" * 700, "t" * 700, "u" * 700]
    docs = [(1, None, ".pptx", "T", long), (2, "a\n1. b" + "x" * 1500 + "\n2. c", ".pdf", None, None), (3, "h1,h2\n\n1,2\n3,4\n", ".csv", None, None), (4, "plain", ".md", None, None), (5, None, ".ppt", "T", ["a", "", "b"])]
    rows = {(r.doc_id, r.chunk_index): r.text for r in chunking.structured(spark.createDataFrame(docs, schema)).collect()}
    assert rows[1, 0] == "T\n" + long[0] + "\n" + long[1] and rows[1, 1] == "T\n" + long[2]
    assert [rows[2, i][:2] for i in range(3)] == ["a", "1.", "2."]
    assert rows[3, 0] == "h1,h2\n1,2" and rows[3, 1] == "h1,h2\n3,4"
    assert rows[4, 0] == "plain" and rows[5, 0] == "a\nb"


def test_answer_chunks(spark):
    assert column(spark, chunking.from_answer(F.col("t")), t=" a\n===CHUNK===\n\n===CHUNK===b ") == ["a", "b"]
    assert column(spark, chunking.from_answer(F.col("t"), 2), t="abc===CHUNK===d") == ["ab", "c", "d"]


def test_cards_and_levels(spark):
    card = spark.createDataFrame([("p", "child", [("k", "v"), ("a", "b")])], "parent_id string, child_text string, card_fields array<struct<key: string, value: string>>")
    assert chunking.parent_cards(card, "[c]").collect()[0].parent_text == "[c]child\nk: v\na: b"
    tree = spark.createDataFrame([(0, "Z", "d", [("S", "sd", [("t", "c", "x"), ("u", "c", "y")])])], "zone_no int, zone string, zone_desc string, shelves array<struct<shelf: string, shelf_desc: string, books: array<struct<title: string, call_no: string, text: string>>>>")
    zones, shelves, items = chunking.levels(tree)
    assert zones.collect()[0].text == "Z:d" and shelves.collect()[0].text == "Z/S:sd"
    assert [r.item_id for r in items.orderBy("item_id").collect()] == ["z0_s0_b0", "z0_s0_b1"]


def test_rrf_and_merges(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.5, "x"), (1, "b", 2, 0.4, "x"), (1, "a", 1, 0.7, "y"), (1, "c", 2, 0.4, "y")], "query_id int, node_id string, rank int, score double, source string")
    rows = fusion.reciprocal_rank(hits).orderBy("rank").collect()
    assert rows[0].node_id == "a" and rows[0].score == pytest.approx(2 / 61, abs=1e-9)
    best = {r.node_id: (r.score, r.source) for r in fusion.best_score(hits).collect()}
    assert best == {"a": (0.7, "y"), "b": (0.4, "x"), "c": (0.4, "y")}
    assert {r.node_id: r.sources for r in fusion.provenance(hits).collect()}["a"] == "x,y"


def test_semantic_unique_is_greedy(spark):
    vectors = [(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.8, [0.9, 0.3]), (1, "c", 0.7, [0.6, 0.8]), (1, "d", 0.6, [0.58, 0.81])]
    kept = refine.semantic_unique(spark.createDataFrame(vectors, "query_id int, node_id string, score double, vector array<double>")).collect()
    assert sorted(r.node_id for r in kept) == ["a", "c"]


def test_exact_unique(spark):
    rows = [("a", " x  y ", 0.1), ("b", "x y", 0.3), ("c", "z", 0.2), ("d", "x\ty", 0.3)]
    kept = refine.exact_unique(spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "node_id long, text string, score double")).collect()
    assert sorted(r.node_id for r in kept) == [1, 2]


def test_filters_and_rules(spark):
    rows = spark.createDataFrame([(1, "电磁 高考", 1, None), (2, "速溶", 1, 5.0), (3, "", 1, 5.0), (4, "无电磁学", 1, 5.0)], "id int, t string, a int, d double")
    assert [r.id for r in refine.without_words(rows, "t").orderBy("id").collect()] == [1, 4]
    assert [r.id for r in refine.within(rows, d=9).orderBy("id").collect()] == [2, 3, 4]
    assert [r.p for r in rows.orderBy("id").select(refine.rule_points(F.col("t")).alias("p")).collect()] == [18.0, 0.0, 0.0, -10.0]


def test_generated_rerank(spark):
    hits = spark.createDataFrame([(1, "q", f"n{i}", i + 1, f"t{i}") for i in range(7)], "query_id int, query_text string, node_id string, rank int, text string")
    scores = "\n".join(f"Doc: {i}, Relevance: {i}" for i in range(1, 6))
    found = refine.generated_rerank(hits, Scripted({"Doc 5": scores}, "Doc: 1, Relevance: 9\nDoc: 2, Relevance: 8"), k=3).orderBy("rank").collect()
    assert [r.node_id for r in found] == ["n5", "n6", "n4"]
    with pytest.raises(Exception, match="incomplete"):
        refine.generated_rerank(hits, Scripted()).collect()
    model = refine.model_rerank(hits.withColumn("score", F.lit(0.0)), WordOverlap(), F.lit("t3 x"), F.col("text"), 1)
    assert model.collect()[0].node_id == "n3"


@pytest.mark.parametrize("seed", range(8))
def test_compression_against_plain_python(spark, seed):
    r = random.Random(seed)
    texts = ["x" * r.choice([3, 20, 30, 60, 100, 490]) for _ in range(r.randint(0, 9))]
    parts, used = [], 0
    for t in texts:
        left = 500 - used - (2 if parts else 0)
        if len(t) <= left:
            used += len(t) + (2 if parts else 0)
            parts.append(t)
        elif left > 20:
            parts.append(t[:left] + "...")
            break
    df = spark.createDataFrame([(texts,)], "t array<string>")
    found = one(df.select(context.compressed(F.col("t"))))
    assert found == "\n\n".join(parts) and len(found) <= 503


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, " long enough text "), (1, 2, 0.4, "too far away text"), (1, 3, 0.9, "short")], "query_id int, rank int, score double, text string")
    questions = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id int, question string")
    rows = {r.query_id: r.prompt for r in context.prompts(hits, questions).collect()}
    assert rows[1] == context.PROMPT.format(context="long enough text", question="why?")
    assert rows[2] == context.PROMPT.format(context=context.NO_CONTEXT, question="who?")
    answers = spark.createDataFrame([(1, 1, None, "q", " a ")], "query_id int, rank int, text string, question string, answer string")
    assert context.medical_prompts(answers, questions.where("query_id = 1")).collect()[0].prompt == context.MEDICAL_PROMPT.format(context="问:q\n答:a", question="why?")


def bfs(edges, source, target, limit=5):
    queue, found = [(source, [(source, "")])], []
    while queue and len(found) < limit:
        node, path = queue.pop(0)
        if len(path) > 10:
            continue
        for s, label, t in edges:
            if s == node and all(t != p[0] for p in path):
                if t == target:
                    found.append([*path, (t, label)])
                else:
                    queue.append((t, [*path, (t, label)]))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_paths_against_search(spark, seed):
    r = random.Random(seed)
    names = "abcde"
    edges = [(r.choice(names), r.choice("xy"), r.choice(names)) for _ in range(11)]
    rows = spark.createDataFrame([("d", i, *e) for i, e in enumerate(edges)], "domain_id string, ordinal int, source string, label string, target string")
    pairs = spark.createDataFrame([("d", a, b) for a in names for b in names if a != b], "domain_id string, source string, target string")
    found = {}
    for p in graph.paths(rows, pairs, longest=5).orderBy("rank").collect():
        found.setdefault((p.source, p.target), []).append(list(zip(p.nodes, ["", *p.labels], strict=True)))
    for a in names:
        for b in names:
            if a != b:
                assert found.get((a, b), []) == bfs(edges, a, b)


def test_graph_answer(spark):
    domains = spark.createDataFrame([("d", "t", "s", [("甲",), ("乙",), ("丙丁",)], [("甲", "友", "乙"), ("甲", "弟", "乙")])], "id string, title string, scope string, entities array<struct<name: string>>, relations array<struct<source: string, label: string, target: string>>")
    queries = spark.createDataFrame([(1, "甲和乙"), (2, "丙丁甲"), (3, "甲的友"), (4, "?")], "query_id int, text string")
    rows = {r.query_id: r.answer for r in flows.graph_answers(domains, queries, HashedWords(8), Scripted({"?": "none"}, "I choose d")).collect()}
    assert rows[1] == "[甲] -> [乙] : 甲-[友] -> 乙: 甲-[弟] -> 乙"
    assert rows[2] == "[丙丁] -> [甲] : 无路径" and rows[3] == rows[1] and 4 not in rows


def test_query_preparation(spark):
    rules = [{"wrong": "ab", "right": "X"}, {"wrong": "abc", "right": "Y"}, {"wrong": "q", "right": "$1", "prev": "z", "next": "w"}]
    assert column(spark, prepare.correct_spelling(F.col("t"), rules), t="abcab zqw zq") == "YX z$1w zq"
    assert column(spark, prepare.without_stopwords(F.col("t"), ["The", "的"]), t="the cat THE dog") == "cat dog"
    assert column(spark, prepare.without_stopwords(F.col("t"), ["的"]), t="猫 的 cat") == "猫cat"
    assert column(spark, prepare.simple_keywords(F.col("t"), 2), t="an apple or two") == "apple, two"
    assert column(spark, prepare.simple_keywords(F.col("t"), 2), t="一二 一二三 四") == "一二三, 一二"
    assert column(spark, prepare.expanded(F.col("t")), t=" a \n\nb") == ["a", "b"]
    assert column(spark, prepare.route(F.col("t")), t="a， b，a，") == ["a", "b"]
    assert [column(spark, prepare.picked(F.col("t"), ["law", "history"]), t=t) for t in (" LAW ", "maybe history?", "无关", "x")] == ["law", "history", None, None]
    queries = spark.createDataFrame([(1, "red car", [1.0, 0.0])], "query_id int, text string, query array<double>")
    vocab = spark.createDataFrame([("color", "red", [0.0, 1.0]), ("kind", "auto", [1.0, 0.1]), ("kind", "boat", [0.0, 1.0]), ("tag", "car", [0.0, 1.0]), ("tag", "ed", [0.0, 1.0])], "field string, value string, vector array<double>")
    found = {r.field: r.values for r in prepare.semantic_filters(queries, vocab, ["kind"], ["tag"]).collect()}
    assert found == {"color": ["red"], "kind": ["auto"], "tag": ["car", "ed"]}


def test_flows_with_scripted_answers(spark):
    embedder = HashedWords(32)
    docs = spark.createDataFrame([("a", "red apple pie"), ("b", "green apple"), ("c", "blue car engine")], "node_id string, text string")
    nodes = docs.withColumn("vector", embedder.column(F.col("text"))).withColumn("kind", F.lit("x"))
    queries = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    def first(df):
        return df.orderBy("rank").collect()[0].node_id

    assert first(flows.multi_query(nodes, queries, embedder, Scripted({}, "blue car\n\n engine "))) == "c"
    assert first(flows.hypothetical(nodes, queries, embedder, Scripted({}, "red\npie"))) == "a"
    assert first(flows.verified(nodes, queries, embedder, Scripted({"Drafts": ""}, "blue car"))) == "c"
    merged = flows.step_back(nodes, queries, {"kind": "none"}, embedder, Scripted({}, "car")).collect()
    assert {r.node_id: r.sources for r in merged}["b"] == "original,step_back"
    assert first(flows.hybrid(docs, queries, embedder, 3)) == "b"
    assert "green apple" in flows.grounded_prompts(nodes, queries, embedder, 2).collect()[0].prompt
    assert flows.ingest(spark.createDataFrame([(1, "A b. C d!", ".txt")], "doc_id long, text string, suffix string"), embedder, 1).count() == 2
    assert [m["role"] for m in messages("u", "s")] == ["system", "user"]


def test_embedder_checks_counts(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    good = PandasEmbedder(lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert [r.v for r in df.select(good.column(F.col("t")).alias("v")).collect()] == [[1.0, 1.0]] * 2
    with pytest.raises(Exception, match="number of vectors"):
        df.select(PandasEmbedder(lambda ts: [[1.0]], 2).column(F.col("t"))).collect()


def test_search_variants(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0], "x", ["u", "v"]), ("b", [0.0, 1.0], "y", ["u"]), ("c", [0.7, 0.7], "x", [])], "node_id string, vector array<double>, label string, features array<string>")
    assert [r.node_id for r in search.top_one(nodes, F.array(F.lit(1.0), F.lit(0.1)), 2).collect()] == ["a", "c"]
    assert [r.node_id for r in search.filtered(nodes, {"label": "x", "features": ["u", "v"]}).collect()] == ["a"]
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<double>")
    routes = spark.createDataFrame([(1, " y"), (1, "zz")], "query_id int, label string")
    assert [r.node_id for r in search.routed(nodes, queries, routes, "label").collect()] == ["b"]
    assert bm25.bm25(nodes.select("node_id", F.col("label").alias("text")), spark.createDataFrame([(1, "x x")], "query_id int, text string")).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_text("x\ny")
    assert [(r.suffix, r.text) for r in readers.documents(spark, str(tmp_path / "d")).collect()] == [(".txt", "x\ny")]
    assert readers.parsed_documents(spark, str(tmp_path / "d"), lambda c, s: s + c.decode()).collect()[0].text == ".txtx\ny"
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.csv").write_bytes("问题,\"答,案\"\n ,x\nq2\n".encode("gb18030"))
    assert sorted(map(tuple, readers.question_answers(spark, str(tmp_path / "q")).collect())) == [("q2", ""), ("问题", "答,案")]
    (tmp_path / "j.json").write_text('[{"id": 1, "text": "a"}, {"id": 2}]')
    assert readers.json_array(spark, str(tmp_path / "j.json"), "id int, text string").count() == 2
    (tmp_path / "c.csv").write_text("id,name\n\n1,a\n 2,b \n")
    assert [r.text for r in chunking.csv_rows(readers.csv_lines(spark, str(tmp_path / "c.csv"))).orderBy("chunk_index").collect()] == ["id,name\n1,a", "id,name\n2,b"]
    stop = spark.createDataFrame([(" The ",), ("",), ("的",)], "word string")
    assert sorted(r.word for r in readers.stopwords(stop).collect()) == ["The", "the", "的"]


def test_sinks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], "t") for i in range(5)], "id long, vector array<float>, text string")
    sinks.create_database(spark, "quern_test", recreate=True)
    name = "quern_test.items"
    sinks.create_collection(rows, name, 2)
    sinks.insert(rows, name, 2)
    sinks.create_if_missing(rows, name, 2)
    assert readers.collection(spark, name).count() == 10
    assert readers.by_ids(spark.table(name), spark.createDataFrame([(3,), (9,)], "id long"), ["id"]).count() == 2
    with pytest.raises(Exception, match="vector length"):
        sinks.insert(rows, name, 3)
    sinks.drop_collection(spark, name)
    assert not spark.catalog.tableExists(name)
    assert readers.databases(spark).count() >= 1
    spark.sql("DROP DATABASE quern_test CASCADE")
    chunks = spark.createDataFrame([(2, 0, "c"), (1, 1, "b"), (1, 0, "a")], "doc_id long, chunk_index int, text string")
    assert [(r.id, r.text) for r in sinks.index_chunks(chunks, HashedWords(4)).orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    many = spark.range(5000).select(F.when(F.col("id") < 10, "small").otherwise("big").alias("g"), "id")
    assert {r.g: r["count"] for r in sinks.exact_sample(many, "g", "id").groupBy("g").count().collect()} == {"small": 1, "big": 4}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "2024-01-01 00:00:00"), (2, "a  b", "2024-01-01 00:01:00"), (3, "c", "2024-01-01 00:02:00")], "doc_id long, text string, ts string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("s_chunks", ingest.chunk_stream(stream)), ("s_unique", ingest.unique_stream(stream, "ts").select("doc_id"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("s_chunks").count() == 3 and spark.table("s_unique").count() == 2
