"""From hits to a prompt: filter, compress to a budget, fill the template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: The context that stands for none, and the two templates.
NO_CONTEXT = "(无相关的文档片段)"
PROMPT = """【角色】你是一个专业的客服/技术顾问,只基于文档回答问题｡
【任务】根据文档回答用户的问题,禁止瞎编乱造
【上下文】
{context}
【用户的问题】
{question}
【输出要求】
1. 准确､简洁,分条回答;
2. 当用户查询无关信息的时候,直接说“文档中不存在”;
3. 不要用文档以外的知识去回答｡
"""
MEDICAL_PROMPT = """【角色】你是一个专业的医疗客服，只基于文档回答问题。
【任务】根据文档回答用户的问题，禁止瞎编乱造。
【上下文】
{context}
【用户的问题】
{question}
【输出要求】
1. 准确、简洁，分条回答；
2. 当用户查询无关信息时，直接说“文档中不存在”；
3. 不要使用文档以外的知识回答。"""


def usable(hits: DataFrame, least: float = 0.5, shortest: int = 10) -> DataFrame:
    """Hits with a score of at least ``least`` (null is 0) and a trimmed text of ``shortest`` characters or more."""
    text = strip(F.coalesce("text", F.lit("")))
    return hits.withColumn("text", text).where((F.coalesce("score", F.lit(0.0)) >= least) & (F.length("text") >= shortest))


def compressed(texts: Column, budget: int = 500, unique: bool = False) -> Column:
    """Texts that fit a budget of characters, in order, joined by a blank line.

    Each after the first costs two more.  The first that does not fit is cut and
    ends the context if more than 20 characters are left for it, else it is
    passed over and later ones may fit.
    """
    if unique:
        texts = F.array_distinct(texts)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def add(acc: Column, t: Column) -> Column:
        gap = F.when(F.size(acc["parts"]) > 0, 2).otherwise(0)
        left = budget - acc["used"] - gap
        whole = F.struct(F.array_append(acc["parts"], t).alias("parts"), (acc["used"] + gap + F.length(t)).alias("used"), F.lit(False).alias("done"))
        cut = F.struct(F.array_append(acc["parts"], F.concat(F.substring(t, F.lit(1), left), F.lit("..."))).alias("parts"), F.lit(budget).alias("used"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(F.length(t) <= left, whole).when(left > 20, cut).otherwise(acc)

    return F.aggregate(texts, start, add, lambda acc: F.array_join(acc["parts"], "\n\n"))


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    """The template with its two fields filled; an empty context has a placeholder."""
    before, rest = template.split("{context}")
    middle, after = rest.split("{question}")
    held = F.when(F.coalesce(context, F.lit("")) == "", F.lit(NO_CONTEXT)).otherwise(context)
    return F.concat(F.lit(before), held, F.lit(middle), F.coalesce(question, F.lit("")), F.lit(after))


def prompts(hits: DataFrame, questions: DataFrame, least: float = 0.5, budget: int = 500) -> DataFrame:
    """query_id and prompt of each question (query_id, question) from its hits (query_id, rank, score, text)."""
    good = usable(hits, least).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    rows = questions.join(good, "query_id", "left")
    context = compressed(F.coalesce("texts", F.array().cast("array<string>")), budget)
    return rows.select("query_id", prompt(context, F.col("question")).alias("prompt"))


def medical_prompts(hits: DataFrame, questions: DataFrame, most: int = 4000) -> DataFrame:
    """As ``prompts`` from question-answer hits, all joined and cut at ``most`` characters."""
    pair = F.concat(F.lit("问:"), strip(F.coalesce("question", F.lit(""))), F.lit("\n答:"), strip(F.coalesce("answer", F.lit(""))))
    text = strip(F.coalesce("text", F.lit("")))
    held = hits.select("query_id", "rank", F.when(text != "", text).otherwise(pair).alias("t"))
    joined = held.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n\n").alias("context"))
    rows = questions.join(joined, "query_id", "left")
    return rows.select("query_id", prompt(F.substring(F.coalesce("context", F.lit("")), 1, most), F.col("question"), MEDICAL_PROMPT).alias("prompt"))
