"""Registered queries over the test tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, words
from ..functions.vectors import cosine
from ..operators import bm25, chunking, context, fusion, graph, prepare, refine, search
from ..providers import HashedWords
from ..session import small_batches
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Texts searched for, words removed, spelling rules, and word rules of the demonstration queries.
TEXTS = ((1, "the licensed version and the text"), (2, "nicht der die und das"), (3, "les aux de la que"), (4, "password token secret"), (5, "que los las ción"))
STOP = ("the", "of", "and", "to", "der", "die", "und", "le", "la", "que")
SPELLING = ({"wrong": "thth", "right": "the"}, {"wrong": "onon", "right": "on"}, {"wrong": "ed", "right": "et", "prev": "th", "next": "er"})
POINTS = ((10.0, ("License", "Apache")), (8.0, ("password", "token")), (-10.0, ("idiot", "scum")))
ADJECTIVES = ("red", "green", "blue", "small", "large")
REPLIES = ((1, "Doc: 1, Relevance: 11\nDoc: 1, Relevance: 9\nDocument 3 - Relevance: 4.5"), (2, "文档：2，相关性：8\nDoc 9, Relevance: 3"), (3, "no ranking"), (4, "doc #4 **4**, relevance: **7**\nDoc: 2 评分 10"))


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows, names: str) -> str:
    """A SQL table of literal rows."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({names})"


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS), "query_id int, text string")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), "label")


def _asked(nodes: DataFrame) -> DataFrame:
    """The stated query set of searches: rows whose id is divisible by 20."""
    return nodes.where(F.col("node_id") % 20 == 0).select(F.col("node_id").alias("query_id"), F.col("vector").alias("query"), F.col("label").alias("query_label"))


_V = "embedding::DOUBLE[]"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
_TOP = "WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 5"
_RANKED = "row_number() OVER w::INTEGER AS rank"
_ASKED = f"q AS (SELECT vec_id AS query_id, {_V} AS v, label FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT vec_id AS node_id, {_V} AS v, label FROM embeddings)"


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'), chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS cleaned FROM documents""")
def clean_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean(F.col("text")).alias("cleaned"))


@query("""SELECT doc_id, i::INTEGER AS chunk_index, (i * 450)::INTEGER AS chunk_start, least(i * 450 + 500, length(text))::INTEGER AS chunk_end, substr(text, i * 450 + 1, 500) AS text
    FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 50) / 450.0), 1)::BIGINT)) AS i FROM documents WHERE length(text) > 0)""")
def fixed_chunks(spark, sf_dir):
    return chunking.fixed(_table(spark, sf_dir, "documents"))


_SENTENCES = r"""s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)"""


@query(f"""WITH {_SENTENCES}
    SELECT doc_id, i::INTEGER AS chunk_index, (i * 5)::INTEGER AS chunk_start, least(i * 5 + 5, len(l))::INTEGER AS chunk_end, array_to_string(l[i * 5 + 1 : i * 5 + 5], ' ') AS text
    FROM (SELECT doc_id, l, unnest(range((len(l) + 4) // 5)) AS i FROM s WHERE len(l) > 0)""")
def sentence_chunks(spark, sf_dir):
    return chunking.sentence_groups(_table(spark, sf_dir, "documents"))


@query(f"""WITH {_SENTENCES}
    SELECT doc_id || '::s' || i AS node_id, doc_id, i::INTEGER AS i, l[i + 1] AS sentence, array_to_string(l[greatest(i, 1) : i + 2], ' ') AS "window"
    FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM s)""")
def sentence_window(spark, sf_dir):
    return chunking.sentence_windows(_table(spark, sf_dir, "documents"))


@query("SELECT 'nation' AS file_path, n_nationkey AS chunk_index, 'n_nationkey,n_name,n_regionkey' || chr(10) || concat_ws(',', n_nationkey, n_name, n_regionkey) AS text FROM nation")
def csv_row_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation")
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in rows.columns))
    return chunking.csv_rows(rows.select(F.lit("nation").alias("file_path"), F.lit(",".join(rows.columns)).alias("header"), F.col("n_nationkey").alias("line_no"), line.alias("line")))


@query(r"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::INTEGER AS chunk_index, text FROM (
    SELECT page_id, unnest(p) AS text, generate_subscripts(p, 1) AS o FROM (
      SELECT doc_id AS page_id, CASE WHEN length(text) <= 1500 THEN [text] ELSE list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS p
      FROM documents WHERE length(text) > 0 AND NOT regexp_matches(text, '\n(\d+\. |●|。|-)')))""")
def structure_pages(spark, sf_dir):
    return chunking.pages(_table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "page_id")


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.recursive(_table(spark, sf_dir, "documents"))


@query()
def semantic_chunks(spark, sf_dir):
    return chunking.semantic(_table(spark, sf_dir, "documents"), HashedWords(16).column)


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q, n)
    SELECT query_id, node_id, score, {_RANKED} FROM s {_TOP}""")
def vector_topk(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return search.top_k(nodes, _asked(nodes))


@query(f"""WITH {_ASKED} SELECT query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS cosine, round(list_inner_product(q.v, n.v), 6) AS dot, round(-list_distance(q.v, n.v), 5) + 0.0 AS negated_distance
    FROM q, n WHERE q.label = n.label""")
def vector_metrics(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return search.metrics(nodes, _asked(nodes).withColumnRenamed("query_label", "label"), "label")


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q, n WHERE n.label = 3)
    SELECT query_id, node_id, score, {_RANKED} FROM s {_TOP}""")
def filtered_topk(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return search.top_k(search.filtered(nodes, {"label": 3}), _asked(nodes))


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q, n WHERE n.label IN (q.label, (q.label + 1) % 10))
    SELECT query_id, node_id, score, {_RANKED} FROM s {_TOP}""")
def routed_topk(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    asked = _asked(nodes)
    routes = asked.select("query_id", F.explode(F.array("query_label", ((F.col("query_label") + 1) % 10).cast("int"))).alias("label"))
    return search.routed(nodes, asked, routes, "label")


_CENTRES = f"c AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, round(avg(x), 6) AS m FROM (SELECT label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label)"


def _centres(nodes: DataFrame) -> DataFrame:
    """The mean vector of each label."""
    parts = nodes.select("label", F.posexplode("vector").alias("d", "x")).groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centre"))


@query(f"""WITH {_ASKED}, {_CENTRES}, m AS (SELECT node_id, c.label FROM n, c WHERE round(list_cosine_similarity(n.v, c.v), 6) >= 0.3),
    p AS (SELECT DISTINCT query_id, m.node_id, q.v FROM q JOIN m ON m.label = q.label),
    s AS (SELECT query_id, node_id, round(list_cosine_similarity(p.v, n.v), 6) AS score FROM p JOIN n USING (node_id))
    SELECT query_id, node_id, score, {_RANKED} FROM s {_TOP}""")
def multi_label_route(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    members = search.memberships(nodes, _centres(nodes))
    asked = _asked(nodes)
    return search.multi_routed(nodes.drop("label"), members, asked.drop("query_label"), asked.select("query_id", F.col("query_label").alias("label")))


@query(f"""WITH {_ASKED}, {_CENTRES}, z AS (SELECT query_id, c.label, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM q, c
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c.label) <= 2),
    s AS (SELECT q.query_id, node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q JOIN z USING (query_id) JOIN n ON n.label = z.label)
    SELECT query_id, node_id, score, {_RANKED} FROM s {_TOP}""")
def hierarchical_topk(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    top = _centres(nodes).select(F.col("label").cast("long").alias("node_id"), F.col("centre").alias("vector"))
    leaves = nodes.select("node_id", F.col("label").cast("long").alias("parent_id"), "vector")
    return search.cascade([(top, 2), (leaves, 5)], _asked(nodes).drop("query_label"))[-1]


@query(f"""WITH {_ASKED}, {_CENTRES}, s AS (SELECT node_id AS query_id, c.label AS node_id, round(list_cosine_similarity(n.v, c.v), 6) AS score FROM n, c)
    SELECT query_id, node_id AS label, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w = 1""")
def intent_top1(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    intents = _centres(nodes).select(F.col("label").alias("node_id"), F.col("centre").alias("vector"))
    asked = nodes.select(F.col("node_id").alias("query_id"), F.col("vector").alias("query"))
    return search.top_k(intents, asked, 1).select("query_id", F.col("node_id").alias("label"), "score")


_BM25 = f"""tok AS (SELECT doc_id AS node_id, unnest({_TOKENS}) AS term FROM documents), tf AS (SELECT node_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT doc_id AS node_id, len({_TOKENS}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS}) AS term FROM {_values(TEXTS, "query_id, text")}) GROUP BY ALL),
    bm AS (SELECT query_id, node_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (node_id), st GROUP BY query_id, node_id)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")


@query(f"WITH {_BM25} SELECT query_id, node_id, score, {_RANKED} FROM bm {_TOP}")
def bm25_topk(spark, sf_dir):
    return bm25.bm25(_docs(spark, sf_dir), _texts(spark))


_HASHED = f"""w AS (SELECT node_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf) AS c FROM tf GROUP BY ALL), wn AS (SELECT node_id, sqrt(sum(c * c)) AS s FROM w GROUP BY ALL),
    qw AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(times) AS c FROM qt GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(c * c)) AS s FROM qw GROUP BY ALL),
    de AS (SELECT query_id, doc_id AS node_id, round(coalesce(score, 0), 6) AS score FROM (SELECT query_id, doc_id FROM qn, documents) LEFT JOIN
        (SELECT query_id, node_id AS doc_id, sum(w.c * qw.c) / any_value(wn.s) / any_value(qn.s) AS score FROM w JOIN qw USING (b) JOIN wn USING (node_id) JOIN qn USING (query_id) GROUP BY ALL) USING (query_id, doc_id))"""


@query(f"""WITH {_BM25}, {_HASHED}, l AS (SELECT query_id, node_id, row_number() OVER w AS rank FROM bm {_TOP} UNION ALL SELECT query_id, node_id, row_number() OVER w AS rank FROM de {_TOP}),
    f AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM l GROUP BY ALL)
    SELECT query_id, node_id, score, {_RANKED} FROM f {_TOP}""".replace("FROM bm WINDOW", "FROM bm WINDOW"))
def hybrid_rrf(spark, sf_dir):
    from .flows import hybrid

    return hybrid(_docs(spark, sf_dir), _texts(spark), HashedWords(64))


_LISTS = f"""{_ASKED}, h AS (SELECT q.label AS query_id, q.query_id AS source, n.node_id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM q, n),
    l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, node_id) AS rank FROM h QUALIFY rank <= 5)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit lists of single queries, of which those with one label belong together."""
    nodes = _nodes(spark, sf_dir)
    asked = _asked(nodes)
    hits = search.top_k(nodes, asked).withColumnRenamed("query_id", "source")
    return hits.join(asked.select(F.col("query_id").alias("source"), F.col("query_label").alias("query_id")), "source")


@query(f"""WITH {_LISTS}, b AS (SELECT query_id, node_id, score, source FROM l QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, source, rank) = 1)
    SELECT query_id, node_id, score, source, {_RANKED} FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id)""")
def max_merge(spark, sf_dir):
    return fusion.best_score(_lists(spark, sf_dir))


@query(f"""WITH {_LISTS}, b AS (SELECT query_id, node_id, max(score) AS score, string_agg(DISTINCT source::VARCHAR, ',' ORDER BY source::VARCHAR) AS sources FROM l GROUP BY ALL)
    SELECT query_id, node_id, score, sources, {_RANKED} FROM b {_TOP}""")
def provenance_merge(spark, sf_dir):
    return fusion.provenance(_lists(spark, sf_dir).withColumn("source", F.col("source").cast("string")), 5)


@query(r"""SELECT key, min(doc_id) FILTER (n_chars = top) AS doc_id, any_value(top) AS score FROM (
    SELECT *, max(n_chars) OVER (PARTITION BY key) AS top FROM (SELECT doc_id, n_chars, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key FROM documents)) GROUP BY key""")
def exact_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").alias("score"))
    return refine.exact_unique(docs, node="doc_id").select("key", "doc_id", "score")


@query(f"""WITH ref AS (SELECT {_V} AS v FROM embeddings WHERE vec_id = 0)
    SELECT doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], ref.v), 6) AS score FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id, ref
    WHERE quality >= 1 AND NOT contains(text, 'idiot') AND NOT contains(text, 'scum') AND text <> '' AND n_chars <= 5000 AND toxic <= 0 AND round(list_cosine_similarity(e.embedding::DOUBLE[], ref.v), 6) >= 0.05""")
def layered_filter(spark, sf_dir):
    docs, nodes = _table(spark, sf_dir, "documents"), _nodes(spark, sf_dir)
    rows = docs.join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("score", F.col("quality"))
    rows = refine.within(refine.without_words(refine.over(rows, 1), "text", ("idiot", "scum")), n_chars=5000, toxic=0)
    ideal = nodes.where("node_id = 0").select(F.col("vector").alias("ideal"))
    held = rows.join(nodes.select(F.col("node_id").alias("doc_id"), "vector"), "doc_id").join(ideal)
    return refine.near_reference(held, F.col("ideal"), 0.05).select("doc_id", F.round(cosine(F.col("vector"), F.col("ideal")), 6).alias("score"))


_POINTS = " + ".join(f"CASE WHEN {' OR '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in ws)} THEN {p} ELSE 0.0 END" for p, ws in POINTS)


@query(f"""SELECT lang AS query_id, doc_id AS node_id, round((n_chars / 1000.0) + ({_POINTS}), 6)::DOUBLE AS score, row_number() OVER w::INTEGER AS rank FROM documents
    WINDOW w AS (PARTITION BY lang ORDER BY round((n_chars / 1000.0) + ({_POINTS}), 6) DESC, doc_id) QUALIFY row_number() OVER w <= 5""")
def rule_rerank(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("node_id"), (F.col("n_chars") / 1000.0).alias("score"), "text")
    return refine.rule_rerank(docs, F.col("text"), POINTS).select("query_id", "node_id", "score", "rank")


@query("""WITH v AS (SELECT DISTINCT field, value FROM (SELECT 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'size', p_size::VARCHAR FROM part))
    SELECT query_id, field, value FROM (SELECT p_partkey AS query_id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part) q JOIN v ON contains(text, value)
    QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY length(value) DESC, value) = 1""")
def filter_extract(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    vocab = prepare.vocabulary(part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size")), ("brand", "type", "size"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return prepare.literal_filters(asked, vocab)


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query(rf"""SELECT doc_id, CASE WHEN len(list_filter(k, lambda t: NOT regexp_full_match(t, '[\x00-\x7F]+'))) = 0 THEN array_to_string(k, ' ') ELSE array_to_string(k, '') END AS cleaned
    FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\s\p{{L}}\p{{M}}\p{{N}}_]'), lambda t: NOT list_contains({_STOP}, t) AND NOT list_contains({_STOP}, lower(t))) AS k FROM documents)""")
def stopword_filter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", prepare.without_stopwords(F.col("text"), STOP).alias("cleaned"))


@query(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
    s AS (SELECT doc_id, term, round(tf * ln((n + 1) / (df + 1)), 6) AS weight FROM tf JOIN df USING (term), n)
    SELECT doc_id, term, weight, row_number() OVER w::INTEGER AS rank FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY weight DESC, term) QUALIFY row_number() OVER w <= 5""")
def tfidf_keywords(spark, sf_dir):
    return prepare.keywords(_table(spark, sf_dir, "documents"))


@query(r"SELECT doc_id, regexp_replace(replace(replace(text, 'thth', 'the'), 'onon', 'on'), 'theder', 'theter', 'g') AS corrected FROM documents")
def spelling(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", prepare.correct_spelling(F.col("text"), SPELLING).alias("corrected"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to nations, nations to regions and to the next nation of the region."""
    nation, region, supplier = (_table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    own = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    a = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_name").alias("source"), F.lit("in").alias("label"), F.col("n_name").alias("target"), F.col("s_suppkey").cast("int").alias("ordinal"))
    b = own.select(F.col("n_name").alias("source"), F.lit("of").alias("label"), F.col("r_name").alias("target"), (F.col("n_nationkey") + 1000000).cast("int").alias("ordinal"))
    x, y = nation.alias("x"), nation.alias("y")
    c = x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))).select(F.col("x.n_name").alias("source"), F.lit("near").alias("label"), F.col("y.n_name").alias("target"), (F.col("x.n_nationkey") * 100 + F.col("y.n_nationkey") + 2000000).cast("int").alias("ordinal"))
    return a.unionByName(b).unionByName(c).withColumn("domain_id", F.lit("trade"))


@query("""WITH RECURSIVE e AS (SELECT s_name AS source, 'in' AS label, n_name AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT n_name, 'of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT x.n_name, 'near', y.n_name FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey),
    p AS (SELECT s_name AS source, r_name AS target, s_name AS cur, [s_name] AS nodes, s_name AS path FROM supplier, region
      UNION ALL SELECT p.source, p.target, e.target, list_append(p.nodes, e.target), p.path || '-[' || e.label || '] -> ' || e.target FROM p JOIN e ON e.source = p.cur
      WHERE p.cur <> p.target AND NOT list_contains(p.nodes, e.target) AND len(p.nodes) <= 10)
    SELECT source, target, (len(nodes) - 1)::INTEGER AS edges, path FROM p WHERE cur = target""")
def graph_paths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    region = _table(spark, sf_dir, "region").select(F.col("r_name").alias("target"))
    pairs = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source")).join(region).withColumn("domain_id", F.lit("trade"))
    found = graph.paths(edges, pairs, most=None)
    return found.select("source", "target", (F.size("nodes") - 1).alias("edges"), graph.path_text().alias("path"))


_PROMPT = context.PROMPT.replace("'", "''").split("{context}")


@query(f"""SELECT conv_id AS query_id, '{_PROMPT[0]}' || CASE WHEN length(trim(a)) = 0 THEN '{context.NO_CONTEXT}' ELSE a END || '{_PROMPT[1].split("{question}")[0]}' || q || '{_PROMPT[1].split("{question}")[1]}' AS prompt
    FROM (SELECT conv_id, coalesce(max(text) FILTER (turn = 1), '') AS a, coalesce(max(text) FILTER (turn = 0), '') AS q FROM conversations GROUP BY conv_id)""")
def prompt_build(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("q"))
    held = F.when(F.length(F.trim("a")) > 0, F.col("a"))
    return turns.select(F.col("conv_id").alias("query_id"), context.prompt(held, F.col("q")).alias("prompt"))


@query(r"""SELECT regexp_replace(coalesce(role, ''), '^\s+|\s+$', '', 'g') AS question, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS answer FROM conversations
    WHERE regexp_replace(coalesce(role, ''), '^\s+|\s+$', '', 'g') <> ''""")
def qa_clean(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return readers.clean_questions(rows.select(F.col("role").alias("question"), F.col("text").alias("answer")))


@query("SELECT * FROM (VALUES (1, 1, 9.0::DOUBLE), (1, 3, 4.5), (2, 2, 8.0), (4, 2, 10.0)) AS t(query_id, choice, relevance)")
def llm_rerank_parse(spark, sf_dir):
    answers = spark.createDataFrame([(i, a, 5) for i, a in REPLIES], "query_id int, answer string, choices int")
    return refine.parsed_ranking(answers)


@query("SELECT doc_id, len(w)::INTEGER AS n_words, len(list_distinct(w))::INTEGER AS n_distinct FROM (SELECT doc_id, " + _TOKENS + " AS w FROM documents)")
def word_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))
