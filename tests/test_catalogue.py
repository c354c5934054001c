"""Every registered query of the retrieval part against its SQL, or for rows where SQL has no form."""

import pytest
from oracle import rows_of_sql, same

from quern.plans import catalogue, flow_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.SQL:
        same(found, rows_of_sql(catalogue.SQL[name], sf_dir))
    else:
        assert len(found)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_structure_pages_of_marked_documents(spark, tmp_path):
    import re

    long = "word " * 200
    texts = [f"{long}\n1. {long}\n2. {long}", f"{long}\n- {long}\n\n{long}", f"{long}\n● {long}。\n。{long}", "short\n- whole", f"{long}\n\n{long}\n1.x {long}", f"{long}\n-\n- {long}", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in enumerate(texts):
        marked, blank = ([p.strip() for p in re.split(x, text) if p.strip()] for x in (r"(?=\n(?:\d+\. |●|。|-))", r"\n\s*\n"))
        parts = [text] if len(text) <= 1500 else marked if len(marked) > 1 else blank
        want += [(i, j, p) for j, p in enumerate(parts) if text]
    found = catalogue.QUERIES["structure_pages"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.chunk_index, r.text) for r in found) == want


def test_graph_paths_of_a_large_region(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}", 0) for i in range(8)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    spark.createDataFrame([(1, "s", 0)], "s_suppkey int, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    found = catalogue.QUERIES["graph_paths"](spark, str(tmp_path)).collect()
    assert len({r.path for r in found}) == len(found) == 128 and max(r.edges for r in found) == 9
