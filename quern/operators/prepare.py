"""Preparing queries: spelling, stopwords, keywords, filters from vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from .search import DIGITS, nearest


#: Terms whose document frequencies go to every task, and words of texts that are counted at once.
MOST_TERMS, MOST_WORDS = 1 << 17, 1 << 17


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def correct_spelling(text: Column, rules: Sequence[dict]) -> Column:
    """Plain rules (wrong, right), longest first; then rules with prev or next, where these stand beside.

    A contextual rule is applied in one pass over the text.
    """
    order = sorted(rules, key=lambda r: -len(r["wrong"]))
    plain = [r for r in order if not r.get("prev") and not r.get("next")]
    beside = [r for r in order if r.get("prev") or r.get("next")]
    out = reduce(lambda t, r: F.replace(t, F.lit(r["wrong"]), F.lit(r["right"])), plain, text)
    for r in beside:
        before = f"(?<={_quoted(r['prev'])})" if r.get("prev") else ""
        after = f"(?={_quoted(r['next'])})" if r.get("next") else ""
        right = r["right"].replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, f"{before}{_quoted(r['wrong'])}{after}", right)
    return out


def without_stopwords(text: Column, stop: Sequence[str]) -> Column:
    """Tokens that are no stopword in either case: ASCII ones joined by spaces, others without."""
    held = F.array(*map(F.lit, sorted(set(stop) | {w.lower() for w in stop if w.isascii()})))
    tokens = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_])"), 1)
    kept = F.filter(tokens, lambda t: ~F.array_contains(held, t) & ~F.array_contains(held, F.lower(t)))
    ascii_only = F.forall(kept, lambda t: t.rlike(r"\A[\x00-\x7F]+\z"))
    return F.when(ascii_only, F.array_join(kept, " ")).otherwise(F.array_join(kept, ""))


def simple_keywords(text: Column, count: int = 5) -> Column:
    """ASCII words of three letters or more in order; without any, the longest tokens of two or more."""
    english = F.regexp_extract_all(text, F.lit(r"([A-Za-z]{3,})"), 1)
    long = F.array_sort(F.array_distinct(F.filter(words(text), lambda t: F.length(t) >= 2)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.array_join(F.when(F.size(english) > 0, F.slice(english, 1, count)).otherwise(F.slice(long, 1, count)), ", ")


def keywords(docs: DataFrame, count: int = 5) -> DataFrame:
    """(doc_id, rank, term, weight): each document's ``count`` terms of highest tf * ln((N + 1) / (df + 1)).

    The document frequencies of the MOST_TERMS most frequent terms go to all
    tasks.  A document's terms are counted where its text is, and only those go
    on that can be among its first: a term that is not in that table is no more
    frequent than its last one, which bounds its weight, and alone needs a join
    with the frequencies.  Rows that share a doc_id are one document; their terms
    are counted after a shuffle.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    single, many = (docs, None) if repeated.isEmpty() else (docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi"))
    seen = single.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counted = None
    if many is not None:
        counted = many.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        seen = seen.unionByName(counted.select("term"))
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.count()
    known = df.orderBy(F.desc("df"), "term").limit(MOST_TERMS).toArrow()  # MOST_TERMS rows
    whole = known.num_rows < MOST_TERMS
    shared = docs.sparkSession.sparkContext.broadcast(known)
    doc_id = docs.schema["doc_id"].dataType
    kinds = T.StructType([T.StructField("doc_id", doc_id), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        names, dfs = told.column("term").combine_chunks() if told.num_rows else pa.array([], pa.string()), told.column("df").to_numpy()
        least = dfs[-1] if len(dfs) else 0
        for batch in batches:
            lists = batch.column("w")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends, lo = np.cumsum(sizes, dtype=np.int64), 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MOST_WORDS, side="right")))
                held = lists.slice(lo, hi - lo).flatten().dictionary_encode()
                n = max(1, len(held.dictionary))
                cells, tf = np.unique(np.repeat(np.arange(hi - lo), sizes[lo:hi]) * n + held.indices.to_numpy(), return_counts=True)
                rows, terms = cells // n, cells % n
                place = pc.fill_null(pc.index_in(held.dictionary, value_set=names.cast(held.dictionary.type)), -1).to_numpy()[terms]
                rare = place < 0
                freq = np.where(rare, least, dfs[place] if len(dfs) else 0)
                low = tf * np.log((total + 1) / (freq + 1))
                high = np.where(rare, tf * np.log((total + 1) / 2), low)
                order = np.lexsort((-low, rows))
                nth = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
                bound = np.full(hi - lo, -np.inf)
                last = order[nth == count - 1]
                bound[rows[last]] = low[last]
                kept = high >= bound[rows] - 2 * 10.0**-DIGITS  # more than rounding may move
                rows, terms, tf, freq, rare = (x[kept] for x in (rows, terms, tf, freq, rare))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows + lo)), held.dictionary.take(pa.array(terms)), pa.array(tf.astype(np.int64)), pa.array(freq.astype(np.int64), mask=rare)], names=["doc_id", "term", "tf", "df"])
                lo = hi

    found = single.select("doc_id", words(F.col("text")).alias("w")).mapInArrow(run, kinds)
    if not whole:
        found = found.where("df is not null").unionByName(found.where("df is null").drop("df").join(df, "term").select("doc_id", "term", "tf", "df"))
    if counted is not None:
        found = found.unionByName(counted.join(df, "term").select("doc_id", "term", "tf", "df"))
    weight = F.round(F.col("tf") * F.log((F.lit(total) + 1) / (F.col("df") + 1)), DIGITS)
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    scored = found.select("doc_id", "term", weight.alias("weight"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def processed(queries: DataFrame, rules: Sequence[dict], stop: Sequence[str], count: int = 5) -> DataFrame:
    """text, corrected, cleaned and keywords of each query."""
    rows = queries.withColumn("corrected", correct_spelling(F.col("text"), rules))
    rows = rows.withColumn("cleaned", without_stopwords(F.col("corrected"), stop))
    return rows.withColumn("keywords", simple_keywords(F.col("cleaned"), count))


def vocabulary(rows: DataFrame, fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Distinct (field, value) of plain and array columns, in one pass over ``rows``."""
    def pair(field: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(field).alias("field"), x.cast("string").alias("value"))

    pairs = F.array(*(pair(f)(F.col(f)) for f in fields))
    for f in lists:
        pairs = F.concat(pairs, F.transform(F.coalesce(F.col(f), F.array()), pair(f)))
    return rows.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").distinct()


def _held(queries: DataFrame, vocab: DataFrame, longest: bool) -> DataFrame:
    """queries with, for each field, ``held``: its values that the text holds, the longest first or in sorted order.

    A field's values are one row, so a query meets each field once and not each value.
    """
    item = F.struct((-F.length("value") if longest else F.lit(0)).alias("size"), "value")
    fields = vocab.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias("_values"))
    held = F.filter("_values", lambda v: F.contains(F.col("text"), v))
    return queries.join(F.broadcast(fields)).select(*queries.columns, "field", held.alias("held"))


def literal_filters(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, field, value): for each field the longest value that the query (query_id, text) holds."""
    order = Window.partitionBy("query_id", "field").orderBy(F.desc(F.length("value")), "value")
    held = _held(queries.select("query_id", "text"), vocab, True).select("query_id", "field", F.get("held", F.lit(0)).alias("value")).where("value is not null")
    return held.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "field", "value")


def semantic_filters(queries: DataFrame, vocab: DataFrame, open_fields: Sequence[str], list_fields: Sequence[str] = (), least: float = 0.6) -> DataFrame:
    """(query_id, field, values): literal matches, else for open fields the nearest value above ``least``.

    A plain field takes its first literal value in sorted order, a list field
    all of them.  ``queries`` has query_id, text, query (vector); ``vocab`` has
    field, value, vector.
    """
    literal = _held(queries.select("query_id", "text"), vocab.select("field", "value"), False).where(F.size("held") > 0)
    found = literal.where(~F.col("field").isin(*list_fields)) if list_fields else literal
    found = found.select("query_id", "field", F.get("held", F.lit(0)).alias("value"), F.lit(True).alias("literal"), F.lit(None).cast("double").alias("near"))
    for field in open_fields:
        if field not in list_fields:
            values = vocab.where(F.col("field") == field).select(F.col("value").alias("node_id"), "vector")
            near = nearest(values, queries).where(F.col("score") > least)
            found = found.unionByName(near.select("query_id", F.lit(field).alias("field"), F.col("node_id").alias("value"), F.lit(False).alias("literal"), F.col("score").alias("near")))
    order = Window.partitionBy("query_id", "field").orderBy(F.desc("literal"), F.desc("near"), "value")
    one = found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "field", F.array("value").alias("values"))
    if not list_fields:
        return one
    many = literal.where(F.col("field").isin(*list_fields)).select("query_id", "field", F.explode("held").alias("value"))
    return one.unionByName(many.groupBy("query_id", "field").agg(F.sort_array(F.collect_set("value")).alias("values")))


def expanded(answer: Column) -> Column:
    """Lines of a generated expansion, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def route(answer: Column) -> Column:
    """Labels of a generated route, separated by full-width commas, trimmed and distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(answer, "，"), lambda x: F.trim(x)), lambda x: x != ""))


#: Answers that name no domain.
NO_DOMAIN = ("none", "null", "无效", "无关")


def picked(answer: Column, ids: Sequence[str]) -> Column:
    """The domain id that a generated answer is, else the first that it holds, else null."""
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    found = F.coalesce(*[F.when(text == i, F.lit(i)) for i in ids], *[F.when(F.contains(text, F.lit(i)), F.lit(i)) for i in ids]) if ids else F.lit(None).cast("string")
    return F.when(~text.isin(*NO_DOMAIN), found)
