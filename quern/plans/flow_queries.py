"""Registered queries of whole flows with scripted answers, of sources and of sinks, and their DuckDB SQL.

Generators are scripted: they give fixed lines for each question, so that SQL
can repeat what a flow does with them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import clean_slides, labelled
from ..operators import chunking, context, graph, prepare, refine, search
from ..providers import HashedWords, Scripted, WordOverlap
from ..sources import readers, sinks
from . import flows
from .catalogue import _ASKED, _RANKED, _TOKENS, _asked, _nodes, _table, _values, query

EMBEDDER = HashedWords(64)
#: Questions, and what the scripted generator answers to each: its lines.
QUESTIONS = ((1, "what does the text say about and"), (2, "wer hat die Zeit und den Ort"), (3, "which words stand here"))
VARIANTS = ((1, ("the and of text", "text of the words", "that and this")), (2, ("die der und", "nicht das ein", "Zeit und Ort")), (3, ("words here", "la de que", "le les des")))
DRAFTS = ((1, ("the and of", "text words", "that this", "of and", "to in", "it is")), (2, ("die der", "und das", "ein nicht", "Zeit", "Ort", "wer")), (3, ("words", "here", "la de", "que", "le les", "des")))
KEPT = ((1, ("it is", "the and of")), (2, ()), (3, ("des", "here", "la de")))
PASSAGES = ((1, ("the text says that and", "of the words")), (2, ("die Zeit und der Ort",)), (3, ("the words stand here",)))


def _script(told, mark: str = "") -> dict[str, str]:
    """The answer of each question, found by its text (and ``mark``) in the prompt."""
    text = dict(QUESTIONS)
    return {f"{mark}{text[i]}": "\n" + "\n \n".join(f" {x} " for x in lines) for i, lines in told}


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id int, text string")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of the benchmark as nodes."""
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), "text")
    return rows.withColumn("vector", EMBEDDER.column(F.col("text")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="quern-")
    return f"{shared.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def _lines(told) -> str:
    return _values([(i, j, x) for i, lines in told for j, x in enumerate(lines)], "query_id, i, text")


def _bag(name: str, source: str, key: str, size: int = 64) -> str:
    """CTEs of the hashed words of ``source`` (key, text): counts by bucket and norms."""
    return f"""{name}b AS (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {size} AS b, count(*) AS c FROM (SELECT {key}, unnest({_TOKENS}) AS term FROM {source}) GROUP BY ALL),
    {name}s AS (SELECT {key}, sqrt(sum(c * c)) AS s FROM {name}b GROUP BY ALL)"""


def _dense(nodes: str, asked: str, size: int = 64) -> str:
    """CTE sc (query_id, node_id, score) of all pairs of ``nodes`` (node_id, text) and ``asked`` (query_id, text)."""
    return f"""{_bag("n", nodes, "node_id", size)}, {_bag("k", asked, "query_id", size)},
    sc AS (SELECT q.query_id, n.node_id, round(coalesce(d.score, 0), 6) AS score FROM {asked} q CROSS JOIN {nodes} n LEFT JOIN
        (SELECT query_id, node_id, sum(nb.c * kb.c) / any_value(ns.s) / any_value(ks.s) AS score FROM nb JOIN kb USING (b) JOIN ns USING (node_id) JOIN ks USING (query_id) GROUP BY ALL) d USING (query_id, node_id))"""


_BENCH = "nodes AS (SELECT item_id AS node_id, text FROM benchmark)"
_TOP3 = "WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 3"


def _merged(told: str, cut: int | None) -> str:
    """Lines searched one by one, merged by best score."""
    limit = f"QUALIFY row_number() OVER w <= {cut}" if cut else ""
    return f"""WITH {_BENCH}, l AS (SELECT query_id AS question, i, query_id || '::' || i AS query_id, text FROM {told}), {_dense("nodes", "l")},
    h AS (SELECT *, row_number() OVER w AS r FROM sc {_TOP3}),
    m AS (SELECT question AS query_id, node_id, score, i AS source, r FROM h JOIN l USING (query_id)),
    b AS (SELECT query_id, node_id, score, source FROM m QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, source, r) = 1)
    SELECT query_id, node_id, score, source, {_RANKED} FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) {limit}"""


@query(_merged(_lines(VARIANTS), 3))
def multi_query(spark, sf_dir):
    return flows.multi_query(_passages(spark, sf_dir), _questions(spark), EMBEDDER, Scripted(_script(VARIANTS)))


@query(_merged(_lines(PASSAGES), 3))
def sub_query(spark, sf_dir):
    return flows.multi_query(_passages(spark, sf_dir), _questions(spark), EMBEDDER, Scripted(_script(PASSAGES)), template=flows.DECOMPOSE)


_KEPT = [(i, dict(KEPT)[i] or lines[:3]) for i, lines in DRAFTS]


@query(_merged(_lines(_KEPT), None))
def verification_chain(spark, sf_dir):
    scripts = {f"Question: {dict(QUESTIONS)[i]}\nDrafts": "\n".join(lines) for i, lines in KEPT}
    return flows.verified(_passages(spark, sf_dir), _questions(spark), EMBEDDER, Scripted(scripts | _script(DRAFTS)))


@query(f"""WITH {_BENCH}, q AS (SELECT query_id, string_agg(text, ' ' ORDER BY i) AS text FROM {_lines(PASSAGES)} GROUP BY query_id), {_dense("nodes", "q")}
    SELECT query_id, node_id, score, {_RANKED} FROM sc {_TOP3}""")
def hyde(spark, sf_dir):
    return flows.hypothetical(_passages(spark, sf_dir), _questions(spark), EMBEDDER, Scripted(_script(PASSAGES)))


#: Questions about parts, what the scripted generator broadens them to, and filters that some parts meet.
PART_QUESTIONS = ((1, "large brushed tin"), (2, "small plated copper"), (3, "economy anodized steel"))
BROADER = ((1, ("tin",)), (2, ("copper plated",)), (3, ()))
_PARTS = "nodes AS (SELECT p_partkey AS node_id, p_name || ' ' || p_brand || ' ' || p_type AS text, p_size, string_split(p_type, ' ') AS features FROM part)"


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), "p_size", F.split("p_type", " ").alias("features"))
    return rows.withColumn("vector", EMBEDDER.column(F.col("text")))


_FIRST_TYPE = "(SELECT string_split(min(p_type), ' ') AS f FROM part)"


@query(f"SELECT node_id FROM (WITH {_PARTS} SELECT node_id, features, f FROM nodes, {_FIRST_TYPE}) WHERE list_has_all(features, f)")
def contains_filter(spark, sf_dir):
    nodes = _part_nodes(spark, sf_dir)
    least = _table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return search.filtered(nodes, {"features": (least or "").split(" ")}).select("node_id")


def _step_back(condition: str) -> str:
    broad = [(i, (dict(BROADER)[i] or (text,))[0]) for i, text in PART_QUESTIONS]
    return f"""WITH {_PARTS}, s AS (SELECT * FROM nodes WHERE {condition}), strict AS (SELECT * FROM s UNION ALL SELECT * FROM nodes WHERE (SELECT count(*) FROM s) = 0),
    q AS (SELECT 'o' || query_id AS query_id, text FROM {_values(PART_QUESTIONS, "query_id, text")} UNION ALL SELECT 'b' || query_id, text FROM {_values(broad, "query_id, text")}), {_dense("nodes", "q")},
    l AS (SELECT * FROM sc WHERE query_id[1] = 'b' OR node_id IN (SELECT node_id FROM strict) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 3),
    m AS (SELECT query_id[2:]::INTEGER AS query_id, node_id, max(score) AS score, string_agg(CASE query_id[1] WHEN 'o' THEN 'original' ELSE 'step_back' END, ',' ORDER BY query_id[1] DESC) AS sources FROM l GROUP BY 1, 2)
    SELECT query_id, node_id, score, sources, {_RANKED} FROM m {_TOP3}"""


def _stepped(spark: SparkSession, sf_dir: str, filters: dict[str, object]) -> DataFrame:
    script = {dict(PART_QUESTIONS)[i]: "\n\n".join(lines) for i, lines in BROADER}
    return flows.step_back(_part_nodes(spark, sf_dir), spark.createDataFrame(list(PART_QUESTIONS), "query_id int, text string"), filters, EMBEDDER, Scripted(script))


@query(_step_back("p_size = 7"))
def step_back(spark, sf_dir):
    return _stepped(spark, sf_dir, {"p_size": 7})


@query(_step_back("p_size = -1"))
def step_back_without_hits(spark, sf_dir):
    return _stepped(spark, sf_dir, {"p_size": -1})


_PROMPTED = context.PROMPT.replace("'", "''").split("{context}")
_ASKED_FOR = _PROMPTED[1].split("{question}")
#: A greedy fold of ordered texts (key, r, t) under a budget of 500 characters: the context of each key.
_FOLD = """RECURSIVE f AS (SELECT key, 0 AS r, '' AS parts, 0 AS used, false AS done, false AS begun FROM (SELECT DISTINCT key FROM ordered)
      UNION ALL SELECT f.key, o.r,
        CASE WHEN done OR t IS NULL THEN parts WHEN length(t) <= 500 - used - gap THEN parts || sep || t WHEN 500 - used - gap > 20 THEN parts || sep || substr(t, 1, 500 - used - gap) || '...' ELSE parts END,
        CASE WHEN done THEN used WHEN length(t) <= 500 - used - gap THEN used + gap + length(t) WHEN 500 - used - gap > 20 THEN 500 ELSE used END,
        done OR (length(t) > 500 - used - gap AND 500 - used - gap > 20),
        begun OR (NOT done AND (length(t) <= 500 - used - gap OR 500 - used - gap > 20))
      FROM (SELECT *, CASE WHEN begun THEN 2 ELSE 0 END AS gap, CASE WHEN begun THEN chr(10) || chr(10) ELSE '' END AS sep FROM f) f JOIN ordered o ON o.key = f.key AND o.r = f.r + 1),
    folded AS (SELECT key, arg_max(parts, r) AS context FROM f GROUP BY key)"""


def _filled(context_sql: str, question: str) -> str:
    return f"'{_PROMPTED[0]}' || CASE WHEN coalesce({context_sql}, '') = '' THEN '{context.NO_CONTEXT}' ELSE {context_sql} END || '{_ASKED_FOR[0]}' || {question} || '{_ASKED_FOR[1]}'"


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"""WITH {_FOLD.replace("RECURSIVE", f'''RECURSIVE {_BENCH}, q AS (SELECT * FROM {_values(QUESTIONS, "query_id, text")}), {_dense("nodes", "q")},
    hits AS (SELECT query_id, node_id, score, row_number() OVER w AS rank FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 5),
    ordered AS (SELECT query_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, t FROM (SELECT hits.*, {_STRIPPED} AS t FROM hits JOIN nodes USING (node_id)) WHERE score >= 0.2 AND length(t) >= 10),''')}
    SELECT q.query_id, {_filled("context", "q.text")} AS prompt FROM q LEFT JOIN folded ON key = q.query_id""")
def grounded_prompts(spark, sf_dir):
    return flows.grounded_prompts(_passages(spark, sf_dir), _questions(spark), EMBEDDER, least=0.2)


_MEDICAL = context.MEDICAL_PROMPT.replace("'", "''").replace("{question}", "{context}").split("{context}")


@query(f"""WITH nodes AS (SELECT conv_id AS node_id, max(text) FILTER (turn = 0) AS question, max(text) FILTER (turn = 1) AS answer, coalesce(max(text) FILTER (turn = 0), '') AS text FROM conversations GROUP BY conv_id),
    q AS (SELECT * FROM {_values(QUESTIONS, "query_id, text")}), {_dense("nodes", "q")},
    hits AS (SELECT query_id, node_id, row_number() OVER w AS rank FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 5),
    c AS (SELECT query_id, substr(string_agg('问:' || regexp_replace(coalesce(question, ''), '^\\s+|\\s+$', '', 'g') || chr(10) || '答:' || regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank), 1, 4000) AS context FROM hits JOIN nodes USING (node_id) GROUP BY query_id)
    SELECT q.query_id, '{_MEDICAL[0]}' || context || '{_MEDICAL[1]}' || q.text || '{_MEDICAL[2]}' AS prompt FROM q JOIN c USING (query_id)""")
def medical_prompts(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("question"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("answer"))
    nodes = turns.select(F.col("conv_id").alias("node_id"), "question", "answer", F.lit("").alias("text"), EMBEDDER.column(F.coalesce("question", F.lit(""))).alias("vector"))
    hits = flows.dense(nodes, _questions(spark), EMBEDDER).join(nodes.drop("vector"), "node_id")
    return context.medical_prompts(hits, _questions(spark).select("query_id", F.col("text").alias("question")))


@query(f"""WITH {_FOLD.replace("RECURSIVE", "RECURSIVE ordered AS (SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r, text AS t FROM conversations WHERE text IS NOT NULL),")}
    SELECT c.conv_id, coalesce(context, '') AS context FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN folded ON key = c.conv_id""")
def compress_context(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return turns.select("conv_id", context.compressed(F.filter("t", lambda x: x.isNotNull())).alias("context"))


@query(f"""WITH RECURSIVE {_ASKED}, h AS (SELECT query_id, node_id, n.v, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q, n),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM h QUALIFY r <= 20),
    g AS (SELECT query_id, 0::BIGINT AS r, []::DOUBLE[][] AS kept, NULL::BIGINT AS node_id, NULL::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM l)
      UNION ALL SELECT g.query_id, l.r, CASE WHEN near THEN kept ELSE list_append(kept, l.v) END, CASE WHEN near THEN NULL ELSE l.node_id END, l.score
      FROM (SELECT g.*, l.*, len(list_filter(g.kept, lambda y: list_cosine_similarity(l.v, y) >= 0.85)) > 0 AS near FROM g JOIN l ON l.query_id = g.query_id AND l.r = g.r + 1) x, LATERAL (SELECT x.query_id) g(query_id), LATERAL (SELECT x.r_1 AS r, x.node_id_1 AS node_id, x.v, x.score_1 AS score) l)
    SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r)::INTEGER AS rank FROM g WHERE node_id IS NOT NULL""")
def semantic_dedup(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    hits = search.top_k(nodes, _asked(nodes), 20).join(nodes.select("node_id", "vector"), "node_id")
    return refine.semantic_unique(hits)


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain for each region: its nations (no name within another), each near the next ones."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    held = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_name"], F.lit("."))).alias("names"))
    pair = lambda i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(F.element_at("names", i + 1).alias("source"), F.lit("near").alias("label"), b.alias("target")))
    edges = F.flatten(F.transform(F.sequence(F.lit(0), F.size("names") - 1), pair))
    rows = held.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.lower("r_name").alias("id"), F.col("r_name").alias("title"), F.lit("nations").alias("scope"), F.transform("names", lambda n: F.struct(n.alias("name"))).alias("entities"), edges.alias("relations"))


_GRAPH = "e AS (SELECT lower(r_name) AS domain_id, n_name || '.' AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_GRAPH} SELECT domain_id, name, (SELECT count(*) FROM e y WHERE y.domain_id = e.domain_id AND y.p > e.p) AS edges_out FROM e")
def graph_nodes(spark, sf_dir):
    edges = graph.relations(_domains(spark, sf_dir))
    out = edges.groupBy("domain_id", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("edges_out"))
    return graph.vertices(edges).join(out, ["domain_id", "name"], "left").select("domain_id", "name", F.coalesce("edges_out", F.lit(0)).alias("edges_out"))


@query(f"""WITH {_GRAPH}, a AS (SELECT x.domain_id, x.name AS a, y.name AS b, z.name AS c FROM e x JOIN e y USING (domain_id) JOIN e z USING (domain_id) WHERE x.p = 2 AND y.p = 3 AND z.p = 4)
    SELECT domain_id AS query_id, CASE WHEN (length(a), 0) >= (length(c), 1) THEN '[' || a || '] -> [' || c || '] : ' || a || '-[near] -> ' || c || ': ' || a || '-[near] -> ' || b || '-[near] -> ' || c
        ELSE '[' || c || '] -> [' || a || '] : {graph.NO_PATH}' END AS answer FROM a
    UNION ALL SELECT domain_id || '?', string_agg(DISTINCT f, chr(10) ORDER BY f) FROM (SELECT x.domain_id, x.name || '-[near] -> ' || y.name AS f FROM e x JOIN e y USING (domain_id) WHERE x.p < y.p) GROUP BY domain_id""")
def graph_answers(spark, sf_dir):
    """Two entities by name (a path or none), and a question that names none (facts around the nearest entities)."""
    domains = _domains(spark, sf_dir)
    held = domains.select("id", F.transform("entities", lambda x: x["name"]).alias("n"))
    named = held.select(F.col("id").alias("query_id"), F.concat(F.lit("how is "), F.element_at("n", 2), F.lit(" tied to "), F.element_at("n", 4), F.lit(" in "), "id").alias("text"))
    open_ones = held.select(F.concat("id", F.lit("?")).alias("query_id"), F.concat(F.lit("what is known in "), "id").alias("text"))
    ids = [r["id"] for r in domains.select("id").orderBy("id").collect()]
    generator = Scripted({f"in {i}": f" {i.upper()} " for i in ids}, "none")
    return flows.graph_answers(domains, named.unionByName(open_ones), EMBEDDER, generator, k=5)


@query(r"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1)::INTEGER AS chunk_index, x AS text FROM (SELECT conv_id, unnest(p) AS x, generate_subscripts(p, 1) AS o FROM (
      SELECT conv_id, list_filter(list_transform(list(t ORDER BY turn), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) GROUP BY conv_id))""")
def generated_chunks(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    answers = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n===CHUNK===\n").alias("answer"))
    return answers.select("conv_id", F.posexplode(chunking.from_answer(F.col("answer"))).alias("chunk_index", "text"))


@query(f"""WITH nodes AS (SELECT p_partkey AS node_id, p_name AS text, '{chunking.CARD}' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || 'type: ' || p_type AS card FROM part),
    q AS (SELECT * FROM {_values(PART_QUESTIONS, "query_id, text")}), {_dense("nodes", "q")}
    SELECT query_id, node_id, score, {_RANKED}, parent_text FROM (SELECT sc.*, card AS parent_text FROM sc JOIN nodes USING (node_id)) {_TOP3}""")
def parent_retrieval(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    field = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
    rows = part.select(F.col("p_partkey").alias("parent_id"), F.col("p_name").alias("child_text"), F.array(field("brand", "p_brand"), field("type", "p_type")).alias("card_fields"))
    cards = chunking.parent_cards(rows)
    nodes = cards.select(F.col("parent_id").alias("node_id"), EMBEDDER.column(F.col("child_text")).alias("vector"))
    hits = flows.dense(nodes, spark.createDataFrame(list(PART_QUESTIONS), "query_id int, text string"), EMBEDDER, 3)
    return search.with_payload(hits, cards.select(F.col("parent_id").alias("node_id"), "parent_text")).select("query_id", "node_id", "score", "rank", "parent_text")


@query("""WITH z AS (SELECT r_regionkey, r_name, 'z' || (row_number() OVER (ORDER BY r_regionkey) - 1) AS id FROM region),
    s AS (SELECT z.*, n_nationkey, n_name, z.id || '_s' || (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1) AS sid FROM nation JOIN z ON n_regionkey = r_regionkey)
    SELECT id, r_name || ':region' AS text FROM z UNION ALL SELECT sid, r_name || '/' || n_name || ':nation' FROM s
    UNION ALL SELECT sid || '_b' || (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1), s_name FROM supplier JOIN s ON s_nationkey = n_nationkey""")
def level_nodes(spark, sf_dir):
    region, nation, supplier = (_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    books = supplier.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.struct(x["s_name"].alias("title"), x["s_name"].alias("text"))).alias("books"))
    shelf = F.struct("n_nationkey", F.col("n_name").alias("shelf"), F.lit("nation").alias("shelf_desc"), F.coalesce("books", F.array().cast("array<struct<title: string, text: string>>")).alias("books"))
    shelves = nation.join(books, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(shelf), lambda a, b: a["n_nationkey"] - b["n_nationkey"]).alias("shelves"))
    tree = region.join(shelves, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("zone_no"), F.col("r_name").alias("zone"), F.lit("region").alias("zone_desc"), "shelves")
    zones, rows, items = chunking.levels(tree)
    return zones.select(F.col("zone_id").alias("id"), "text").unionByName(rows.select(F.col("shelf_id").alias("id"), "text")).unionByName(items.select(F.col("item_id").alias("id"), "text"))


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q, n),
    h AS (SELECT *, {_RANKED} FROM s {_TOP3})
    SELECT query_id, node_id, rank, text FROM h JOIN documents ON doc_id = node_id""")
def summary_retrieval(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    hits = search.top_k(nodes, _asked(nodes), 3)
    return search.with_payload(hits, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")).select("query_id", "node_id", "rank", "text")


@query("""SELECT l.i AS "order", s_suppkey AS node_id, printf('%d. %s (nation %d), score %.4f', l.i, s_name, s_nationkey, s_acctbal) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier) l""")
def hit_lines(spark, sf_dir):
    hits = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("score"), "s_name")
    rows = search.ranked(hits, None)
    line = search.hit_line("%s (nation %d)", F.col("s_name"), F.col("query_id"))
    return rows.select(F.col("rank").cast("long").alias("order"), "node_id", line.alias("line"))


@query("SELECT p_partkey AS node_id, 'Name: ' || p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Size: ' || p_size || chr(10) || 'Price: ' AS text FROM part")
def node_texts(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("node_id"), labelled(("Name: ", F.col("p_name")), ("Brand: ", F.col("p_brand")), ("Size: ", F.col("p_size")), ("Price: ", F.lit(None))).alias("text"))


@query("SELECT n_nationkey, n_name || chr(10) || 'about ' || n_name || ' and more' || chr(10) || 'noted' AS text FROM nation")
def slide_text(spark, sf_dir):
    raw = F.concat(F.lit("Title: a slide\n"), F.lit("# **"), "n_name", F.lit("**\n---\nabout **"), "n_name", F.lit("** and # more #\n[Speaker Notes]: noted\n"))
    lines = F.filter(F.transform(F.split(clean_slides(raw), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(lines, "\n").alias("text"))


@query(r"""WITH t AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '.PPTX' WHEN 1 THEN '.pdf' WHEN 2 THEN '.csv' ELSE '.txt' END AS suffix, 'T' || doc_id AS title FROM documents),
    c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM t WHERE suffix = '.csv')
    SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM (
      SELECT doc_id, l[1] || chr(10) || unnest(l[2:]) AS text FROM c WHERE len(l) > 1
      UNION ALL SELECT doc_id, text FROM t WHERE suffix = '.txt'
      UNION ALL SELECT doc_id, unnest(CASE WHEN length(text) <= 1500 THEN [text] ELSE [p FOR p IN [trim(x, ' ' || chr(10)) FOR x IN string_split(regexp_replace(text, '\n((\d+\. |●|。|-)\s*)', chr(1) || chr(10) || '\1', 'g'), chr(1))] IF p <> ''] END) FROM t WHERE suffix = '.pdf' AND length(text) > 0 AND (length(text) <= 1500 OR regexp_matches(text, '\n(\d+\. |●|。|-)'))
      UNION ALL SELECT doc_id, unnest(CASE WHEN length(text) > 1500 AND NOT regexp_matches(text, '\n(\d+\. |●|。|-)') THEN [p FOR p IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN regexp_split_to_array(text, '\n\s*\n')] IF p <> ''] ELSE [] END) FROM t WHERE suffix = '.pdf'
      UNION ALL SELECT doc_id, 's1' || chr(10) || 's2' FROM t WHERE suffix = '.PPTX') GROUP BY doc_id""")
def structured_chunks(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, (".PPTX", ".pdf", ".csv", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", kind.alias("suffix"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.array(F.lit("s1"), F.lit(""), F.lit("s2")).alias("sections"))
    return chunking.structured(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters"))


@query(f"""WITH q AS (SELECT * FROM {_values(QUESTIONS, "query_id, text")}), h AS (SELECT query_id, item_id AS node_id, q.text AS asked, b.text FROM q, benchmark b),
    s AS (SELECT query_id, node_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(asked), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')), {_TOKENS})) / len(list_distinct(regexp_extract_all(lower(asked), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))), 6)::DOUBLE AS score FROM h)
    SELECT query_id, node_id, score, {_RANKED} FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 5""")
def model_rerank(spark, sf_dir):
    rows = _questions(spark).withColumnRenamed("text", "asked")
    hits = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), "text").join(rows).withColumns({"score": F.lit(0.0), "rank": F.lit(1)})
    return refine.model_rerank(hits, WordOverlap(), F.col("asked"), F.col("text")).select("query_id", "node_id", "score", "rank")


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q, n),
    h AS (SELECT query_id, node_id, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 10),
    g AS (SELECT query_id, node_id, [3.0, 9.5, 1.0, 7.0, 10.0][(r - 1) % 5 + 1]::DOUBLE AS score FROM h) SELECT query_id, node_id, score, {_RANKED} FROM g {_TOP3.replace("3", "5")}""")
def generated_rerank(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    hits = search.top_k(nodes, _asked(nodes), 10).withColumns({"text": F.col("node_id").cast("string"), "query_text": F.col("query_id").cast("string")})
    reply = "Doc: 1, Relevance: 3\nDocument 2 - Relevance: 9.5\nDoc 3, Relevance: 11\nDoc 3, Relevance: 1\n文档：4，相关性：7\nDoc: 5, Relevance: 10"
    return refine.generated_rerank(hits, Scripted({}, reply)).select("query_id", "node_id", "score", "rank")


@query(f"""WITH q AS (SELECT doc_id, regexp_replace(replace(replace(text, 'thth', 'the'), 'onon', 'on'), 'theder', 'theter', 'g') AS corrected FROM documents),
    k AS (SELECT doc_id, corrected, list_filter(regexp_extract_all(corrected, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_]'), lambda t: NOT list_contains(['the', 'of'], t) AND NOT list_contains(['the', 'of'], lower(t))) AS k FROM q),
    c AS (SELECT doc_id, corrected, CASE WHEN len(list_filter(k, lambda t: NOT regexp_full_match(t, '[\\x00-\\x7F]+'))) = 0 THEN array_to_string(k, ' ') ELSE array_to_string(k, '') END AS cleaned FROM k)
    SELECT doc_id, corrected, cleaned, array_to_string(CASE WHEN regexp_matches(cleaned, '[A-Za-z]{{3,}}') THEN regexp_extract_all(cleaned, '[A-Za-z]{{3,}}')[:5]
        ELSE list_transform(list_sort([[lpad((1000000 - length(t))::VARCHAR, 9, '0'), t] FOR t IN list_distinct(regexp_extract_all(lower(cleaned), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) IF length(t) >= 2]), lambda x: x[2])[:5] END, ', ') AS keywords FROM c""")
def query_pipeline(spark, sf_dir):
    from .catalogue import SPELLING

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return prepare.processed(docs, SPELLING, ("the", "of")).drop("text")


@query(f"""WITH v AS (SELECT DISTINCT 'brand' AS field, p_brand AS value FROM part UNION SELECT DISTINCT 'type', p_type FROM part), nodes AS (SELECT field || '|' || value AS node_id, value AS text, field FROM v),
    q AS (SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' of ' || p_type WHEN 1 THEN lower(p_type) ELSE p_name END AS text FROM part), {_dense("nodes", "q")},
    m AS (SELECT query_id, field, n.text AS value, contains(q.text, n.text) AS literal, CASE WHEN field = 'type' AND score > 0.6 THEN score END AS near FROM sc JOIN nodes n USING (node_id) JOIN q USING (query_id))
    SELECT query_id, field, value FROM m WHERE literal OR near IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY literal DESC, CASE WHEN NOT literal THEN near END DESC NULLS LAST, value) = 1""")
def semantic_filters(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    vocab = prepare.vocabulary(part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), ("brand", "type"))
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat_ws(" of ", "p_brand", "p_type")).when(kind == 1, F.lower("p_type")).otherwise(F.col("p_name"))
    asked = part.select(F.col("p_partkey").alias("query_id"), text.alias("text")).withColumn("query", EMBEDDER.column(F.col("text")))
    found = prepare.semantic_filters(asked, vocab.withColumn("vector", EMBEDDER.column(F.col("value"))), ("type",))
    return found.select("query_id", "field", F.element_at("values", 1).alias("value"))


@query("SELECT DISTINCT field, value FROM (SELECT 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'size', p_size::VARCHAR FROM part UNION ALL SELECT 'features', unnest(string_split(p_type, ' ')) FROM part)")
def catalogue_values(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.split("p_type", " ").alias("features"))
    return prepare.vocabulary(part, ("brand", "size"), ("features",))


@query(f"""WITH {_ASKED}, r AS (SELECT query_id, label FROM q WHERE query_id % 40 = 0 UNION ALL SELECT query_id, (label + 1) % 10 FROM q),
    s AS (SELECT q.query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q JOIN r USING (query_id) JOIN n ON n.label = r.label)
    SELECT query_id, node_id, score, {_RANKED} FROM s {_TOP3.replace("3", "5")}""")
def generated_route(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    asked = _asked(nodes)
    following = ((F.col("query_label").cast("int") + 1) % 10).cast("string")
    answer = F.concat(F.when(F.col("query_id") % 40 == 0, F.concat(F.lit(" "), "query_label", F.lit(" ，"))).otherwise(F.lit("none，")), following, F.lit("，， "), following)
    routes = asked.select("query_id", F.explode(prepare.route(answer)).alias("label"))
    return search.routed(nodes, asked.drop("query_label"), routes, "label")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 3 <> 2")
def collection_lookup(spark, sf_dir):
    """A database with a collection: created, replaced, appended to in batches, one dropped, then read by ids."""
    name = f"quern_{uuid.uuid4().hex[:12]}"
    sinks.create_database(spark, name)
    sinks.create_database(spark, name, recreate=True)
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    sinks.create_collection(rows, f"{name}.all", 64)
    sinks.create_collection(rows.where("id % 3 = 0"), f"{name}.all", 64)
    sinks.create_if_missing(rows, f"{name}.all", 64)
    more = sinks.insert(rows.where("id % 3 = 1"), f"{name}.all", 64)
    sinks.create_if_missing(rows.limit(1), f"{name}.other", 64)
    sinks.drop_collection(spark, f"{name}.other")
    if more != rows.where("id % 3 = 1").count() or readers.databases(spark).where(F.col("namespace") == name).isEmpty() or spark.catalog.tableExists(f"{name}.other"):
        raise RuntimeError("the collection is not as it was made")
    return readers.by_ids(readers.collection(spark, f"{name}.all"), rows.where("id % 7 = 0").select("id"), ["id", "label"])


@query(r"""SELECT row_number() OVER (ORDER BY item_id, i) AS id, text FROM (SELECT item_id, i, array_to_string(l[i * 5 + 1 : i * 5 + 5], ' ') AS text FROM (SELECT item_id, l, unnest(range((len(l) + 4) // 5)) AS i FROM (
    SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM benchmark) WHERE len(l) > 0))""")
def chunk_index(spark, sf_dir):
    chunks = chunking.sentence_groups(_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
    return sinks.index_chunks(chunks, EMBEDDER).select("id", "text")


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= greatest(1, n // 1000)""")
def sample_rows(spark, sf_dir):
    return sinks.exact_sample(_table(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "event_type")


@query("SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text, '.txt' AS suffix FROM nation GROUP BY n_regionkey")
def text_folder(spark, sf_dir):
    path = scratch(spark, "folder")
    _table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    return readers.documents(spark, path).select("text", "suffix")


@query("SELECT n_nationkey::INTEGER AS chunk_index, 'key,name' || chr(10) || n_nationkey || ',' || n_name AS text FROM nation")
def csv_folder(spark, sf_dir):
    path = scratch(spark, "csv")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.concat_ws(",", F.col("n_nationkey").cast("string"), F.col("n_name")).alias("value"))
    head = spark.createDataFrame([(-2, "key,name"), (-1, "  ")], "i int, value string")
    rows.unionByName(head).coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return chunking.csv_rows(readers.csv_lines(spark, path)).select("chunk_index", "text")


@query("SELECT n_name AS question, '属于 ' || r_name AS answer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4 UNION ALL SELECT n_name, '' FROM nation WHERE n_nationkey % 5 = 4")
def qa_folder(spark, sf_dir):
    """Question files with and without a byte order mark, with blanks around cells, empty answers and rows without a question."""
    path, nation = scratch(spark, "qa"), _table(spark, sf_dir, "nation")
    rows = nation.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit('" '), "n_name", F.lit(' "'), F.when(F.col("n_nationkey") % 5 != 4, F.concat(F.lit(",属于 "), "r_name")).otherwise("")).alias("value"))
    for i, mark in enumerate(("\ufeff", "")):
        own = rows.where(F.col("n_nationkey") % 2 == i).unionByName(spark.createDataFrame([(-1, mark + " ,无")], "n_nationkey int, value string"))
        own.coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(f"{path}/{i}")
    return readers.question_answers(spark, f"{path}/*", "*.txt")


@query("SELECT doc_id, regexp_replace(replace(replace(text, 'thth', 'the'), 'onon', 'on'), 'theder', 'theter', 'g') AS corrected FROM documents")
def spelling_file(spark, sf_dir):
    from .catalogue import SPELLING

    path = scratch(spark, "spelling")
    rules = spark.createDataFrame([(r["wrong"], r["right"], r.get("prev"), r.get("next")) for r in SPELLING], schemas.SPELLING)
    rules.agg(F.to_json(F.collect_list(F.struct(*rules.columns))).alias("value")).coalesce(1).write.text(path)
    read = [r.asDict() for r in readers.json_array(spark, path, schemas.SPELLING).collect()]  # a file of rules, which are few
    return _table(spark, sf_dir, "documents").select("doc_id", prepare.correct_spelling(F.col("text"), read).alias("corrected"))


@query("SELECT DISTINCT word FROM (SELECT trim(x) AS word FROM (SELECT ' ' || n_name || ' ' AS x FROM nation UNION ALL SELECT lower(n_name) || 'Ä' FROM nation UNION ALL SELECT '  ') UNION ALL SELECT lower(n_name) FROM nation) WHERE word <> ''")
def stopword_list(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    words = nation.select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("word")).unionByName(nation.select(F.concat(F.lower("n_name"), F.lit("Ä")).alias("word"))).unionByName(spark.createDataFrame([("  ",)], "word string"))
    return readers.stopwords(words)
