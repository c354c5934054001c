"""Filters from vocabularies: no row for each pair of a query and a value."""

from quern.operators import prepare

VOCAB = [("brand", "ab"), ("brand", "abc"), ("brand", "xbc"), ("kind", "q"), ("kind", "zz"), ("size", "1"), ("size", "16")]
ASKED = [(1, "xbc abc q"), (1, "zz ab"), (2, "16"), (3, None), (4, ""), (None, "q zz"), (5, "nothing"), (6, "abc 161 zz q")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_literal_filters_meet_each_field_once(spark):
    vocab = spark.createDataFrame(VOCAB, "field string, value string")
    found = prepare.literal_filters(spark.createDataFrame(ASKED, "query_id int, text string"), vocab)
    want = {}
    for q, text in ASKED:
        for f, v in VOCAB:
            if text is not None and v in text:
                want[q, f] = min(want.get((q, f), (0, v)), (-len(v), v))
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in spark.createDataFrame([(q, f, v) for (q, f), (_, v) in want.items()], "query_id int, field string, value string").collect())
    assert "collect_list" in _plan(found)


SEMANTIC_VOCAB = [("a", "m", [1.0, 0.0]), ("a", "k", [1.0, 0.0]), ("a", "n", [0.0, 1.0]), ("a", "o", [0.0, 0.0]), ("a", "p", None), ("b", "m", [1.0, 1.0]), ("c", "m", [0.0, 1.0]), ("c", "x", [0.0, 1.0])]


def test_semantic_filters_without_pairs(spark):
    vocab = spark.createDataFrame(SEMANTIC_VOCAB, "field string, value string, vector array<double>")
    asked = [(1, "has m", [1.0, 0.0]), (2, "", [2.0, 0.1]), (3, "", [0.0, 0.0]), (4, "", None), (5, "x n m", [0.1, 3.0]), (2, "", [0.0, 1.0]), (6, "", [1.0, None]), (7, "", [1.0]), (8, "", [-1.0, 0.0])]
    found = prepare.semantic_filters(spark.createDataFrame(asked, "query_id int, text string, query array<double>"), vocab, ("a", "b"), ("c",))
    got = sorted((r.query_id, r.field, r["values"]) for r in found.collect())
    assert got == [(1, "a", ["m"]), (1, "b", ["m"]), (1, "c", ["m"]), (2, "a", ["n"]), (2, "b", ["m"]), (5, "a", ["m"]), (5, "b", ["m"]), (5, "c", ["m", "x"])]
    assert "zip_with" not in _plan(found)
