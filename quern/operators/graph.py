"""Property graphs: entities and labelled relations of domains, paths, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what stands for two entities without a path.
NO_PATH = "无路径"
#: Most edges of a path, and paths sought for a pair.
MOST_EDGES, MOST_PATHS = 10, 5


def relations(domains: DataFrame) -> DataFrame:
    """Edges (domain_id, ordinal, source, label, target) of nested domains."""
    rows = domains.select(F.col("id").alias("domain_id"), F.posexplode("relations").alias("ordinal", "r"))
    return rows.select("domain_id", "ordinal", "r.source", "r.label", "r.target")


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct (domain_id, name) of all ends of edges."""
    return edges.select("domain_id", F.col("source").alias("name")).unionByName(edges.select("domain_id", F.col("target").alias("name"))).distinct()


def entities_in(queries: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, domain_id, name, position): names that a query (query_id, domain_id, text) holds, longest first.

    After them come targets of relations that the query spells as
    '<source>的<label>'.  ``names`` has domain_id, name and ordinal.
    """
    literal = queries.join(names, "domain_id").where(F.contains("text", "name")).select("query_id", "domain_id", "name", F.lit(0).alias("kind"), (-F.length("name")).alias("size"), "ordinal")
    phrase = F.concat("source", F.lit("的"), "label")
    told = queries.join(edges, "domain_id").where(F.contains(F.col("text"), phrase)).select("query_id", "domain_id", F.col("target").alias("name"), F.lit(1).alias("kind"), F.lit(0).alias("size"), "ordinal")
    place = F.min(F.struct("kind", "size", "ordinal")).alias("place")
    found = literal.unionByName(told).groupBy("query_id", "domain_id", "name").agg(place)
    return found.select("query_id", "domain_id", "name", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "name")).alias("position"))


def paths(edges: DataFrame, pairs: DataFrame, most: int | None = MOST_PATHS, longest: int = MOST_EDGES) -> DataFrame:
    """Simple directed paths between pairs (domain_id, source, target), shortest first.

    Columns: domain_id, source, target, rank, nodes, labels.  A search that has
    ``most`` paths ends only with the node it is expanding, so the last group
    of parallel edges is whole and may pass ``most``; ``None`` keeps all.  Each
    round extends all open paths by one edge in a join and lets those that have
    ended pass, so that the plan has one chain of joins; rounds are ``longest``.
    """
    step = edges.select(F.col("domain_id").alias("_domain"), F.col("source").alias("_at"), F.col("target").alias("next"), "label", "ordinal")
    none = F.array().cast("array<string>")
    found = pairs.select("domain_id", "source", "target", F.col("source").alias("at"), F.lit(False).alias("ended"), F.array("source").alias("nodes"), none.alias("labels"), F.array().cast("array<int>").alias("edges"))
    for _ in range(longest):
        own = ~F.col("ended") & (F.col("domain_id") == F.col("_domain")) & (F.col("at") == F.col("_at"))
        grown = found.join(step, own, "left").where(F.col("ended") | ~F.array_contains("nodes", F.col("next")))
        more = lambda old, new: F.when(F.col("ended"), F.col(old)).otherwise(F.array_append(old, new)).alias(old)
        at = F.when(F.col("ended"), F.col("at")).otherwise(F.col("next"))
        found = grown.select("domain_id", "source", "target", at.alias("at"), (F.col("ended") | (at == F.col("target"))).alias("ended"), more("nodes", F.col("next")), more("labels", F.col("label")), more("edges", F.col("ordinal").cast("int")))
    found = found.where("ended")
    order = Window.partitionBy("domain_id", "source", "target").orderBy(F.size("edges"), "edges")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if most is not None:
        parent = F.slice("edges", F.lit(1), F.size("edges") - 1)
        last = ranked.where(F.col("rank") == most).select("domain_id", "source", "target", parent.alias("_parent"))
        ranked = ranked.join(last, ["domain_id", "source", "target"], "left").where((F.col("rank") <= most) | (parent == F.col("_parent")))
    return ranked.select("domain_id", "source", "target", "rank", "nodes", "labels")


def path_text(nodes: str = "nodes", labels: str = "labels"):
    """'a-[label] -> b-[label] -> c'."""
    tail = F.expr(f"slice({nodes}, 2, size({nodes}))")
    return F.concat(F.element_at(nodes, 1), F.array_join(F.zip_with(F.col(labels), tail, lambda label, n: F.concat(F.lit("-["), label, F.lit("] -> "), n)), ""))


def answers(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, answer): paths between each two entities of a query, in their order; none gives no row."""
    a = found.select("query_id", "domain_id", F.col("name").alias("source"), F.col("position").alias("i"))
    b = found.select("query_id", F.col("name").alias("target"), F.col("position").alias("j"))
    pairs = a.join(b, "query_id").where("i < j")
    known = paths(edges, pairs.select("domain_id", "source", "target").distinct())
    texts = known.groupBy("domain_id", "source", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", path_text().alias("t")))), lambda x: x["t"]), ": ").alias("paths"))
    lines = pairs.join(texts, ["domain_id", "source", "target"], "left")
    line = F.concat(F.lit("["), "source", F.lit("] -> ["), "target", F.lit("] : "), F.coalesce("paths", F.lit(NO_PATH)))
    ordered = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", line.alias("t")))).alias("l"))
    return ordered.select("query_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("answer"))


def neighbourhood(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct 'source-[label] -> target' facts at one edge from hit entities (query_id, domain_id, name)."""
    ends = edges.select("domain_id", F.explode(F.array("source", "target")).alias("name"), F.concat("source", F.lit("-["), "label", F.lit("] -> "), "target").alias("content"))
    return hits.join(ends, ["domain_id", "name"]).select("query_id", "content").distinct()
