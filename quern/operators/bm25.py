"""BM25 (Lucene idf) over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .search import DIGITS, ranked


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, node_id, score, rank: the ``k`` best documents (node_id, text) for each query (query_id, text).

    Only postings of terms that some query holds go on after the corpus
    statistics; a term that a query repeats counts as often.  Each document also
    gives a posting of the empty term, which carries its length, so that one
    pass over the texts and one shuffle serve all statistics and scores.
    """
    asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    held = docs.select("node_id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    found = held.select("node_id", F.size("w").alias("dl"), F.explode(F.array_append("w", F.lit(""))).alias("term")).join(wanted, "term", "left_semi")
    tf = found.groupBy("node_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    length = F.when(F.col("term") == "", F.col("dl"))
    totals = tf.agg(F.count(length).alias("n"), F.avg(length).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    terms = df.join(totals).select("term", idf.alias("idf"), "avgdl").join(asked, "term")  # totals are one row
    scored = tf.join(terms, "term").withColumn("part", F.col("times") * F.col("idf") * weight)
    return ranked(scored.groupBy("query_id", "node_id").agg(F.round(F.sum("part"), DIGITS).alias("score")), k)
