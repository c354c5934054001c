"""Refining hits: deduplication, layered filters, reranking by rules, models and generated answers."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .search import DIGITS, ranked

#: Words that disqualify a description.
BLACKLIST = ("速溶", "乱码", "违规宣传", "奶油雪顶", "炼乳奶油")
#: Fixed values: (points, any of these words) that a title and content earn.
RULES = (
    (10.0, ("电磁", "电场", "磁场", "电磁感应")),
    (8.0, ("高考", "高三", "冲刺")),
    (6.0, ("大题", "压轴", "真题")),
    (-10.0, ("力学", "光学", "声学", "初中")),
    (-20.0, ("无电磁学", "不涉及电磁场")),
)
#: Fixed value: how a generated ranking may name a document and its relevance.
ANSWER = (
    r"(?i)(?:doc(?:ument)?|文档)\s*[:：#-]?\s*\*{0,2}(\d+)\*{0,2}"
    r"[\s,，;；\-—]*"
    r"(?:relevance|相关(?:性)?|评分|分数)\s*[:：]?\s*\*{0,2}"
    r"(\d+(?:\.\d+)?)\*{0,2}"
)


def text_key(text: Column) -> Column:
    """MD5 of the text with its white space collapsed and trimmed."""
    return F.md5(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).cast("binary"))


def exact_unique(hits: DataFrame, text: str = "text", node: str = "node_id") -> DataFrame:
    """Of hits with one text the highest score stays, of equal scores the first node.

    The choice is an aggregate, so rows are combined before the shuffle and a
    text that a third of all rows share is no large group in one task.
    """
    best = F.max_by(F.struct(*hits.columns), F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col(node)))
    return hits.groupBy(text_key(F.col(text)).alias("key")).agg(best.alias("x")).select("x.*", "key")


def semantic_unique(hits: DataFrame, most: float = 0.85) -> DataFrame:
    """Greedy by falling score: a hit goes if it is as near as ``most`` to one that stayed.

    For each query; hits (query_id, node_id, score, vector) must be a top-k
    list, as one query's hits are folded in one row.
    """
    item = F.struct(F.negate("score").alias("order"), "node_id", "score", "vector")
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    kept = F.aggregate("all", F.expr("slice(all, 1, 0)"), lambda acc, x: F.when(F.exists(acc, lambda y: cosine(x["vector"], y["vector"]) >= most), acc).otherwise(F.array_append(acc, x)))
    return lists.select("query_id", F.posexplode(kept).alias("i", "x")).select("query_id", "x.node_id", "x.score", (F.col("i") + 1).alias("rank"))


def over(hits: DataFrame, least: float = 0.5) -> DataFrame:
    return hits.where(F.col("score") >= least)


def without_words(rows: DataFrame, text: str, words: Sequence[str] = BLACKLIST) -> DataFrame:
    """Rows whose text is not empty and holds none of ``words``."""
    for word in words:
        rows = rows.where(~F.contains(F.col(text), F.lit(word)))
    return rows.where(F.col(text) != "")


def within(rows: DataFrame, **most: float) -> DataFrame:
    """Rows with each named column at most its value; null fails."""
    for name, value in most.items():
        rows = rows.where(F.col(name) <= value)
    return rows


def near_reference(rows: DataFrame, reference: Column, least: float = 0.55) -> DataFrame:
    """Rows whose vector is as near to an ideal one as ``least``."""
    return rows.where(F.round(cosine(F.col("vector"), reference), DIGITS) >= least)


def rule_points(text: Column, rules: Sequence[tuple[float, Sequence[str]]] = RULES) -> Column:
    total = F.lit(0.0)
    for points, words in rules:
        held = F.lit(False)
        for word in words:
            held = held | F.contains(text, F.lit(word))
        total = total + F.when(held, F.lit(float(points))).otherwise(F.lit(0.0))
    return total


def rule_rerank(hits: DataFrame, text: Column, rules: Sequence[tuple[float, Sequence[str]]] = RULES, k: int | None = 5) -> DataFrame:
    """Scores plus the points of the rules, ranked anew."""
    return ranked(hits.withColumn("score", F.round(F.col("score") + rule_points(text, rules), DIGITS)).drop("rank"), k)


def model_rerank(hits: DataFrame, reranker, query: Column, text: Column, k: int | None = 5) -> DataFrame:
    """Scores replaced by a reranker's, ranked anew."""
    return ranked(hits.withColumn("score", F.round(reranker.score(query, text), DIGITS)).drop("rank"), k)


def parsed_ranking(answers: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, choice, relevance) in a generated ranking (key, answer, choices).

    Choices outside 1..choices and relevances outside 1..10 are passed over;
    of valid entries for one choice the first counts.
    """
    pairs = F.arrays_zip(F.regexp_extract_all("answer", F.lit(ANSWER), F.lit(1)).alias("c"), F.regexp_extract_all("answer", F.lit(ANSWER), F.lit(2)).alias("r"))
    rows = answers.select(key, "choices", F.posexplode(pairs).alias("i", "p"))
    rows = rows.select(key, "i", "choices", F.expr("try_cast(p.c as bigint)").alias("choice"), F.col("p.r").cast("double").alias("relevance"))
    rows = rows.where("choice between 1 and choices and relevance between 1 and 10")
    first = Window.partitionBy(key, "choice").orderBy("i")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, F.col("choice").cast("int").alias("choice"), "relevance")


def generated_rerank(hits: DataFrame, generator, text: str = "text", batch: int = 5, attempts: int = 3, k: int = 5) -> DataFrame:
    """Reranks batches of ``batch`` hits by a generator's answers; a batch not fully answered is asked again.

    Raises when an answer stays incomplete after ``attempts`` tries.
    """
    pattern = re.compile(ANSWER)

    def relevances(prompt: str, n: int) -> list[float]:
        for _ in range(attempts):
            found: dict[int, float] = {}
            for choice, score in pattern.findall(generator.complete(prompt) or ""):
                if 1 <= int(choice) <= n and 1 <= float(score) <= 10:
                    found.setdefault(int(choice), float(score))
            if len(found) == n:
                return [found[i + 1] for i in range(n)]
        raise RuntimeError("the ranking stayed incomplete")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "node_id"])
        prompt = "\n".join([f"Query: {frame['query_text'].iloc[0]}", *(f"Doc {i + 1}: {t}" for i, t in enumerate(frame[text]))])
        return frame[["query_id", "node_id"]].assign(score=relevances(prompt, len(frame)))

    types = dict(hits.dtypes)
    batches = hits.withColumn("_batch", F.floor((F.col("rank") - 1) / batch))
    scored = batches.groupBy("query_id", "_batch").applyInPandas(run, f"query_id {types['query_id']}, node_id {types['node_id']}, score double")
    return ranked(scored, k)
