"""Whole flows: ingest, hybrid search, query expansion, step-back, grounded prompts, graph questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import bm25, chunking, context, fusion, graph, prepare, search
from ..providers import Embedder, TextGenerator, answered

#: What the generator is asked; {query} and {n} are filled in.
EXPAND = "Write {n} different search queries for the question, one on each line.\nQuestion: {query}"
DECOMPOSE = "Split the question into {n} simpler questions, one on each line.\nQuestion: {query}"
VERIFY = "Choose the {n} drafts that best cover the question, one on each line.\nQuestion: {query}\nDrafts:\n{drafts}"
HYPOTHETICAL = "Write a short passage that answers the question.\nQuestion: {query}"
STEP_BACK = "Rewrite the question as one broader search query.\nQuestion: {query}"


def _ask(template: str, query: Column, **fields: str) -> Column:
    before, after = template.format_map({k: v for k, v in fields.items()} | {"query": "\x00"}).split("\x00")
    return F.concat(F.lit(before), query, F.lit(after))


def ingest(docs: DataFrame, embedder: Embedder, most: int = 5) -> DataFrame:
    """Documents (doc_id, text, suffix) cleaned, cut into groups of sentences and embedded, in one plan."""
    cleaned = docs.select("doc_id", clean(F.col("text"), F.col("suffix")).alias("text"))
    chunks = chunking.sentence_groups(cleaned, most)
    key = F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return chunks.select(key.alias("node_id"), "doc_id", "chunk_index", "text", embedder.column(F.col("text")).alias("vector"))


def dense(nodes: DataFrame, queries: DataFrame, embedder: Embedder, k: int = 5) -> DataFrame:
    """Top-k nodes (node_id, vector) for texts (query_id, text)."""
    return search.top_k(nodes, queries.select("query_id", embedder.column(F.col("text")).alias("query")), k)


def hybrid(docs: DataFrame, queries: DataFrame, embedder: Embedder, k: int = 5, constant: int = 60) -> DataFrame:
    """BM25 and dense top-k of documents (node_id, text) for queries (query_id, text), fused by reciprocal rank."""
    nodes = docs.select("node_id", embedder.column(F.col("text")).alias("vector"))
    lists = {"sparse": bm25.bm25(docs, queries, k), "dense": dense(nodes, queries, embedder, k)}
    return fusion.reciprocal_rank(fusion.stacked(lists), k, constant)


def _search_lines(lines: DataFrame, nodes: DataFrame, embedder: Embedder, k: int, cut: int | None) -> DataFrame:
    """Each line of a query searched on its own, the hits merged by best score."""
    asked = lines.select("query_id", F.posexplode("lines").alias("i", "text"))
    key = F.concat_ws("::", F.col("query_id").cast("string"), F.col("i").cast("string"))
    asked = asked.select("query_id", key.alias("line_id"), "i", "text")
    hits = dense(nodes, asked.select(F.col("line_id").alias("query_id"), "text"), embedder, k).withColumnRenamed("query_id", "line_id")
    hits = hits.join(asked.select("line_id", "query_id", F.col("i").alias("source")), "line_id").drop("line_id")
    return fusion.best_score(hits, cut)


def multi_query(nodes: DataFrame, queries: DataFrame, embedder: Embedder, generator: TextGenerator, n: int = 3, k: int = 3, template: str = EXPAND) -> DataFrame:
    """Hits of generated variants (or, with DECOMPOSE, of sub-questions) merged by best score and cut at ``k``."""
    lines = prepare.expanded(answered(generator, _ask(template, F.col("text"), n=str(n))))
    return _search_lines(queries.select("query_id", lines.alias("lines")), nodes, embedder, k, k)


def verified(nodes: DataFrame, queries: DataFrame, embedder: Embedder, generator: TextGenerator, drafts: int = 6, n: int = 3, k: int = 3, limit_merged: int | None = None) -> DataFrame:
    """Draft queries, of which the generator keeps ``n`` (the first ones if it keeps none), searched and merged."""
    rows = queries.select("query_id", "text", F.slice(prepare.expanded(answered(generator, _ask(EXPAND, F.col("text"), n=str(drafts)))), 1, drafts).alias("drafts"))
    before, after = VERIFY.replace("{n}", str(n)).split("{query}")
    middle, end = after.split("{drafts}")
    asked = F.concat(F.lit(before), F.col("text"), F.lit(middle), F.array_join("drafts", "\n"), F.lit(end))
    rows = rows.withColumn("kept", F.slice(prepare.expanded(answered(generator, asked)), 1, n))
    lines = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.slice("drafts", 1, n))
    return _search_lines(rows.select("query_id", lines.alias("lines")), nodes, embedder, k, limit_merged)


def hypothetical(nodes: DataFrame, queries: DataFrame, embedder: Embedder, generator: TextGenerator, k: int = 3) -> DataFrame:
    """Search by a generated passage in the question's place."""
    passage = F.array_join(prepare.expanded(answered(generator, _ask(HYPOTHETICAL, F.col("text")))), " ")
    return dense(nodes, queries.select("query_id", passage.alias("text")), embedder, k)


def step_back(nodes: DataFrame, queries: DataFrame, filters: dict[str, object], embedder: Embedder, generator: TextGenerator, k: int = 3) -> DataFrame:
    """Strict hits (all nodes if the filters leave none), hits of a broader query, merged with their sources.

    Whether the filters leave any node is one action of the driver.
    """
    strict = search.filtered(nodes, filters)
    strict = nodes if strict.isEmpty() else strict
    broader = F.element_at(F.concat(prepare.expanded(answered(generator, _ask(STEP_BACK, F.col("text")))), F.array("text")), 1)
    lists = {"original": dense(strict, queries, embedder, k), "step_back": dense(nodes, queries.select("query_id", broader.alias("text")), embedder, k)}
    return fusion.provenance(fusion.stacked(lists), k)


def grounded_prompts(nodes: DataFrame, questions: DataFrame, embedder: Embedder, k: int = 5, least: float = 0.5, budget: int = 500) -> DataFrame:
    """Prompts (query_id, prompt) of questions (query_id, text) over nodes (node_id, vector, text)."""
    hits = dense(nodes, questions, embedder, k).join(nodes.select("node_id", "text"), "node_id")
    return context.prompts(hits, questions.select("query_id", F.col("text").alias("question")), least, budget)


def graph_answers(domains: DataFrame, queries: DataFrame, embedder: Embedder, generator: TextGenerator, k: int = 3) -> DataFrame:
    """(query_id, answer): the generator picks a domain; paths between its entities, else facts near the closest ones.

    The domains' ids and titles, which the prompt lists, are few.
    """
    told = domains.select("id", "title", "scope").collect()
    listing = "\n".join(f"* id={d['id']}, title={d['title']}, scope={d['scope']}" for d in told)
    reply = answered(generator, F.concat(F.lit(f"Choose the id of the domain that fits, or none.\n{listing}\nQuestion: "), F.col("text")))
    asked = queries.select("query_id", "text", prepare.picked(reply, [d["id"] for d in told]).alias("domain_id")).where("domain_id is not null")
    edges = graph.relations(domains)
    names = domains.select(F.col("id").alias("domain_id"), F.posexplode("entities").alias("ordinal", "e")).select("domain_id", "ordinal", F.col("e.name").alias("name"))
    entities = graph.entities_in(asked, names, edges)
    by_path = graph.answers(entities, edges)
    # Two entities always give an answer, so the paths need not be sought to know who has one.
    rest = asked.join(entities.groupBy("query_id").count().where("count > 1"), "query_id", "left_anti")
    nodes = names.withColumn("vector", embedder.column(F.col("name")))
    pairs = rest.withColumn("query", embedder.column(F.col("text"))).join(nodes, "domain_id")
    near = search.ranked(pairs.select("query_id", "domain_id", "name", F.round(search.cosine(F.col("vector"), F.col("query")), 6).alias("score")), k, node="name")
    facts = graph.neighbourhood(near, edges).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("content")), "\n").alias("answer"))
    return by_path.unionByName(facts)
