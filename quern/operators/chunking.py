"""Chunking: every strategy takes documents and returns one row per chunk."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, strip
from ..functions.vectors import cosine

#: Separators of the recursive split, coarse to fine ('' cuts anywhere).
SEPARATORS = ("\n\n", "\n", ".", "?", "!", ";", ",", " ", "")
#: Most characters of a structural chunk.
STRUCTURE_CHARS = 1500


def fixed(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` code points, each starting ``size - overlap`` after the one before.

    The last chunk ends with the text; empty texts give none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    count = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(float(step))), F.lit(1)).cast("int")
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("doc_id", "chunk_index", start.alias("chunk_start"), F.least(start + size, F.length("text")).alias("chunk_end"), F.substring("text", start + 1, F.lit(size)).alias("text"))


def sentence_groups(docs: DataFrame, most: int = 5) -> DataFrame:
    """Groups of ``most`` sentences joined by a space; start and end count sentences."""
    held = docs.select("doc_id", sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    last = F.floor((F.size("s") - 1) / most).cast("int")
    rows = held.select("doc_id", "s", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * most
    return rows.select("doc_id", "chunk_index", start.alias("chunk_start"), F.least(start + most, F.size("s")).alias("chunk_end"), F.array_join(F.slice("s", start + 1, F.lit(most)), " ").alias("text"))


def sentence_windows(docs: DataFrame, width: int = 1) -> DataFrame:
    """Every sentence with its ``width`` neighbours on both sides (column window), key doc::s0, doc::s1, ..."""
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s")).select("doc_id", "s", F.posexplode("s").alias("i", "sentence"))
    first = F.greatest(F.col("i") - width, F.lit(0))
    window = F.array_join(F.slice("s", first + 1, F.col("i") + width - first + 1), " ")
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("::s"), F.col("i").cast("string")).alias("node_id"), "doc_id", "i", "sentence", window.alias("window"))


def default_tokens(text: str) -> int:
    """Words, and each CJK character for itself."""
    import re

    return len(re.findall(r"[⺀-鿿぀-ヿ가-힣]|[^\s⺀-鿿぀-ヿ가-힣]+", text))


def recursive(docs: DataFrame, most: int = 512, tokens: Callable[[str], int] = default_tokens) -> DataFrame:
    """Parts of at most ``most`` tokens, split at the coarsest separator that suffices.

    Parts keep their separators, so the chunks of a text join to the text.
    """
    def split(text: str, level: int = 0) -> list[str]:
        if tokens(text) <= most or len(text) < 2:
            return [text]
        mark = SEPARATORS[level]
        if not mark:
            half = len(text) // 2
            return split(text[:half], level) + split(text[half:], level)
        pieces = [p + mark for p in text.split(mark)]
        pieces[-1] = pieces[-1][: -len(mark)]
        out: list[str] = []
        held = 0  # tokens of the last part, or a bound: two texts joined have no more words than both
        for piece in filter(None, pieces):
            own = tokens(piece)
            if out and (subadditive and held + own <= most or (held := tokens(out[-1] + piece) - own) + own <= most):
                out[-1] += piece
                held += own
            elif own <= most:
                out.append(piece)
                held = own
            else:
                out += split(piece, level + 1)
                held = tokens(out[-1])
        return out

    subadditive = tokens is default_tokens

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t) if t else [])

    return docs.select("doc_id", F.posexplode(cut("text")).alias("chunk_index", "text"))


def semantic(docs: DataFrame, embed: Callable[[Column], Column], percent: float = 0.95) -> DataFrame:
    """Runs of sentences, broken where the distance to the next exceeds a percentile of the document's distances."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "sentence"))
    rows = rows.withColumn("v", embed(F.col("sentence")))
    order = Window.partitionBy("doc_id").orderBy("i")
    rows = rows.withColumn("gap", 1 - F.coalesce(cosine(F.lag("v").over(order), F.col("v")), F.lit(0.0)))
    rows = rows.withColumn("gap", F.when(F.col("i") > 0, F.col("gap")))
    limit = F.percentile("gap", F.lit(percent)).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("limit", limit).withColumn("chunk_index", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(order).cast("int"))
    return rows.groupBy("doc_id", "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def from_answer(answer: Column, most: int | None = None) -> Column:
    """Chunks of a generated answer: parts between ===CHUNK=== lines, trimmed, without empty ones.

    With ``most``, longer parts are cut into pieces of so many characters.
    """
    parts = F.filter(F.transform(F.split(answer, r"\n?===CHUNK===\n?"), strip), lambda x: x != "")
    if most is None:
        return parts
    return F.flatten(F.transform(parts, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most)))))


def slides(docs: DataFrame, most: int = STRUCTURE_CHARS) -> DataFrame:
    """Slides (doc_id, title, sections array<string>): all sections, or packed runs of them under the title."""
    full = F.array_join(F.filter("sections", lambda s: s.isNotNull() & (s != "")), "\n")
    room = F.lit(most) - F.length(F.coalesce("title", F.lit(""))) - 1

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), s)))
        return F.when((F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= room), grown).otherwise(F.concat(acc, F.array(s)))

    packed = F.aggregate(F.filter("sections", lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"), add)
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit("\n"))).otherwise("")
    chunks = F.when(F.length(full) <= most, F.array(full)).otherwise(F.transform(packed, lambda p: F.concat(title, p)))
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "text")).where("text <> ''")


def pages(docs: DataFrame, most: int = STRUCTURE_CHARS) -> DataFrame:
    """Pages (doc_id, text): whole if short, else split before numbered or marked lines, else at blank lines."""
    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split("text", pattern), strip), lambda p: p != "")

    marked = parts(r"(?=\n(?:\d+\. |●|。|-)\s*)")
    chunks = F.when(F.length("text") <= most, F.array("text")).when(F.size(marked) > 1, marked).otherwise(parts(r"\n\s*\n"))
    return docs.where(F.length("text") > 0).select("doc_id", F.posexplode(chunks).alias("chunk_index", "text"))


def csv_rows(lines: DataFrame) -> DataFrame:
    """Each data line under its file's header (file_path, header, line_no, line)."""
    return lines.select("file_path", F.col("line_no").alias("chunk_index"), F.concat_ws("\n", "header", "line").alias("text"))


def structured(docs: DataFrame) -> DataFrame:
    """Chunks by suffix: slides, pages and CSV lines each their way; other documents stay whole.

    Needs doc_id, text, suffix, title and sections.
    """
    kind = F.lower("suffix")
    slide, page, table = kind.isin(".ppt", ".pptx", ".pptm"), kind == ".pdf", kind == ".csv"
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), strip), lambda x: x != "")
    of_table = docs.where(table).select("doc_id", lines.alias("l")).where(F.size("l") > 1)
    rows = of_table.select("doc_id", F.element_at("l", 1).alias("h"), F.posexplode(F.expr("slice(l, 2, size(l))")).alias("chunk_index", "x"))
    rest = docs.where(~(F.coalesce(slide | page | table, F.lit(False)))).select("doc_id", F.lit(0).alias("chunk_index"), "text")
    parts = slides(docs.where(slide)).unionByName(pages(docs.where(page)))
    return parts.unionByName(rows.select("doc_id", "chunk_index", F.concat_ws("\n", "h", "x").alias("text"))).unionByName(rest)


#: Fixed value: the heading of a card.
CARD = "【三国演义 · 故事卡片】"


def parent_cards(rows: DataFrame, heading: str = CARD) -> DataFrame:
    """parent_id, child_text and the parent's card: heading and child, then 'key: value' lines in order."""
    lines = F.transform("card_fields", lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    card = F.array_join(F.concat(F.array(F.concat(F.lit(heading), "child_text")), lines), "\n")
    return rows.select("parent_id", "child_text", card.alias("parent_text"))


def levels(tree: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Zones, shelves and items of a nested tree; ids are positions z0, z0_s0, z0_s0_b0.

    ``tree`` needs ``zone_no``, the position of the zone.
    """
    zones = tree.select(F.concat(F.lit("z"), F.col("zone_no").cast("string")).alias("zone_id"), "zone", F.concat_ws(":", "zone", "zone_desc").alias("text"), "shelves")
    shelves = zones.select("zone_id", "zone", F.posexplode("shelves").alias("j", "x"))
    shelves = shelves.select("zone_id", F.concat("zone_id", F.lit("_s"), F.col("j").cast("string")).alias("shelf_id"), F.concat_ws(":", F.concat_ws("/", "zone", "x.shelf"), "x.shelf_desc").alias("text"), F.col("x.books").alias("books"))
    items = shelves.select("zone_id", "shelf_id", F.posexplode("books").alias("k", "b"))
    items = items.select("zone_id", "shelf_id", F.concat("shelf_id", F.lit("_b"), F.col("k").cast("string")).alias("item_id"), F.col("b.title").alias("title"), F.col("b.text").alias("text"))
    return zones.drop("shelves", "zone"), shelves.drop("books"), items
