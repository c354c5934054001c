"""The pipeline's stages and the registered queries against SQL and plain checks."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from oracle import rows_of_sql, same

import corpus_pipeline
from quern.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), rows_of_sql(ORACLE_SQL[name], sf_dir))


def test_stages(spark, sf_dir, tmp_path):
    """Each stage on what its predecessor kept, against plain Python."""
    from test_corpus_operators import classes_of, sets_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept, columns = [set(before)], docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    start, toxic, exact, near, mixed, packed = kept
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_toxicity"](spark, sf_dir).collect()}
    assert toxic == {i for i in start if not scores[i]}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert not [i for i in start - toxic if labels.get(i) == 0]
    assert exact == {max(i for i in toxic if before[i].text == before[j].text) for j in toxic}
    assert near == set(classes_of(sets_of([(i, before[i].text) for i in sorted(exact)])).values())
    assert mixed == near == packed
    again = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in again.select("doc_id").distinct().collect()} == packed
    assert sum(r.length for r in again.collect()) == sum(r.length for r in docs.collect())


def test_stages_with_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and repeated rows, a long text and columns with names of the operators' own."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "alone here with words", "en", "b", 1), (4, "same row", "en", "b", 1), (4, "same row", "en", "b", 1), (5, long, "en", "a", 2), (6, long + " more", "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "1 as _place", "2 as slot", "3 as row", "4 as _row", "5 as c0", "6 as key", "7 as place")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0, name
        docs = stage(spark, docs, sf_dir)
        assert name == "packing" or docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = sorted(str(r.doc_id) for r in docs.select("doc_id").distinct().collect())
        assert left == {"toxicity": ["1", "2", "4", "5", "6", "None"], "exact_dedup": ["2", "4", "5", "6", "None"]}.get(name, ["2", "4", "5", "None"])
