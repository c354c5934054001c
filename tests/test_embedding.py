"""Vectors of hashed words over slices of batches."""

import hashlib
import math

from pyspark.sql import functions as F

from quern.plans import catalogue
from quern.providers import HashedWords


def _vector(text, size):
    counts = [0] * size
    for w in (text or "").lower().split():
        counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size] += 1
    norm = math.sqrt(sum(c * c for c in counts)) or 1.0
    return [c / norm for c in counts]


def test_hashed_words_by_slices(spark):
    texts = [None, "", "one two", "the " * 150_000 + "end", "", "ü ü Ü x", None, *(f"w{i} w{i % 7} w" for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    found = {r.i: r.v for r in rows.select("i", HashedWords(16).column(F.col("text")).alias("v")).collect()}
    assert found == {i: _vector(t, 16) for i, t in enumerate(texts)}
    empty = rows.where("i < 0").select(HashedWords(16).column(F.col("text")).alias("v"))
    assert empty.collect() == []


def test_no_python_object_for_each_word(spark, sf_dir):
    """Words reach Python in small Arrow batches and not as pandas objects."""
    from pyspark.util import PythonEvalType

    vector = HashedWords(4).column(F.col("text"))
    plan = spark.createDataFrame([("a",)], "text string").select(vector)._jdf.queryExecution().executedPlan().toString()
    kind = plan.split("ArrowEvalPython")[1].split("\n")[0]
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in kind and f", {PythonEvalType.SQL_SCALAR_PANDAS_UDF}" not in kind
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalogue.QUERIES["hybrid_rrf"](spark, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
