"""Exact deduplication over content-defined chunk recipes.

A rolling hash over the last 32 bytes of a text decides where its chunks end,
so equal content is cut alike wherever it stands.  Each chunk is named by a
64-bit hash; all chunks that carry one name are compared by SHA-256 and length,
and the name is *verified* when they agree.  A document's recipe is the ordered
list of its chunks' verified names (a name that is not verified is replaced by
its full digest), and documents are equal exactly when their recipes are equal.
Texts themselves never move: a shuffle carries names and digests only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, numbered_rows, text_bytes, text_slices

#: Chunk sizes in bytes: no cut before LEAST, a cut about every 2**MASK_BITS after it, always one at MOST.
LEAST, MASK_BITS, MOST = 512, 11, 16384
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_RECIPES = "doc_id long, row long, text_sha256 string, recipe binary, digests binary"


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Positions after a byte whose 32-byte rolling hash ends in MASK_BITS zeros."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # gear hash of 2 * step bytes from two of step bytes
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_ends(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes start..end, given all candidate cuts in order."""
    ends, at, last = [], start, end
    for c in candidates.tolist():
        if c >= last:
            break
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST:
            ends.append(c)
            at = c
    while last - at > MOST:
        at += MOST
        ends.append(at)
    if last > at:
        ends.append(last)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary()), ("digests", pa.binary())])
    for batch in batches:
        column = batch.column("text")
        for lo, hi in text_slices(column, 4 << 20):
            raw, offsets = text_bytes(column.slice(lo, hi - lo))
            # The window may reach back into the row before; LEAST > 32 keeps such bytes from deciding a cut.
            cuts, data = cut_points(raw), memoryview(raw.tobytes())
            bounds = np.searchsorted(cuts, offsets)
            shas, recipes, digests = [], [], []
            for i in range(hi - lo):
                a, b = int(offsets[i]), int(offsets[i + 1])
                names, full, at = [], [], a
                for e in chunk_ends(cuts[bounds[i] : bounds[i + 1]], a, b):
                    full.append(hashlib.sha256(data[at:e]).digest() + (e - at).to_bytes(4, "little"))
                    names.append(hashlib.blake2b(data[at:e], digest_size=8).digest())
                    at = e
                shas.append(hashlib.sha256(data[a:b]).hexdigest())
                recipes.append(b"".join(names))
                digests.append(b"".join(full))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("row").slice(lo, hi - lo), pa.array(shas), pa.array(recipes, pa.binary()), pa.array(digests, pa.binary())], schema=schema)


def recipes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row (a number of its own for each), text_sha256, recipe (8 bytes a chunk) and digests (36 bytes a chunk)."""
    number = F.monotonically_increasing_id() if row is None else row
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(_recipes, _RECIPES)


def chunk_names(made: DataFrame) -> DataFrame:
    """One row per chunk name: how often it occurs and its least and greatest digest."""
    at = F.explode(F.sequence(F.lit(0), F.expr("cast(length(recipe) / 8 as int) - 1")))
    parts = made.where(F.length("recipe") > 0).select("recipe", "digests", at.alias("i"))
    parts = parts.select(F.expr("substring(recipe, i * 8 + 1, 8)").alias("name"), F.expr("substring(digests, i * 36 + 1, 36)").alias("digest"))
    return parts.groupBy("name").agg(F.count(F.lit(1)).alias("uses"), F.min("digest").alias("least"), F.max("digest").alias("most"))


def _renamed(made: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes in which every name of ``clashes`` is replaced by the chunk's digest."""
    at = F.posexplode(F.sequence(F.lit(1), F.expr("cast(length(recipe) / 8 as int)")))
    parts = made.where(F.length("recipe") > 0).select("row", "recipe", "digests", at.alias("i", "n"))
    parts = parts.select("row", "i", F.expr("substring(recipe, i * 8 + 1, 8)").alias("name"), F.expr("substring(digests, i * 36 + 1, 36)").alias("digest"))
    parts = parts.join(clashes.select("name", F.lit(True).alias("clash")), "name", "left")
    name = F.when(F.col("clash"), F.concat(F.lit("d"), F.hex("digest"))).otherwise(F.concat(F.lit("n"), F.hex("name")))
    new = parts.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", name.alias("x")))), lambda s: s["x"]), "").cast("binary").alias("renamed"))
    return made.join(new, "row", "left").select("doc_id", "row", "text_sha256", F.coalesce("renamed", "recipe").alias("recipe"))


def _verified(made: DataFrame) -> DataFrame:
    """doc_id, row, text_sha256 and recipe, equal exactly where texts are."""
    clashes = chunk_names(made).where(F.col("least") != F.col("most"))
    # With no two chunks of one name (the usual case) every name is verified as it stands.
    return made.select("doc_id", "row", "text_sha256", "recipe") if clashes.isEmpty() else _renamed(made, clashes)


def _best() -> Column:
    """Of equal texts the largest doc_id, a null one only where there is no other; of its rows the first by number."""
    return F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), (-F.col("row")).alias("back")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of identical texts: doc_id, keep_id, group_size, kept, text_sha256.

    A row for every row of ``docs`` (doc_id, text).  A null text counts as the
    empty text.  The largest doc_id of a group stays, in one row: should several
    rows of the group carry it, the one of the least row number is kept.  A null
    doc_id stays only where its group has no other, and keep_id is then null.
    Other columns are ignored, and an empty table gives an empty result.  Texts
    are read whole; long ones give long recipes and are never compared byte by
    byte.  The groups are summed before the shuffle and joined back by recipe; a
    recipe shared by a third of all rows is a skewed join side that Spark splits.
    """
    named = _verified(Stored(recipes(docs), "recipes").df)
    groups = named.groupBy("recipe").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
    shared = Stored(groups.where("group_size > 1"), "groups")  # read again as a plain join side, which Spark can replicate
    out = named.join(shared.df, "recipe", "left")
    alone = F.col("group_size").isNull()
    keep_id, kept = F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")), alone | (F.col("row") == -F.col("best.back"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    Rows are told apart by a number of their own and chosen as in
    ``exact_groups``; an empty table gives an empty one.
    """
    rows, row = numbered_rows(docs, "rows")
    named = _verified(Stored(recipes(rows, F.col(row)), "recipes").df)
    keep = named.groupBy("recipe").agg(_best().alias("best")).select((-F.col("best.back")).alias("_keep"))
    kept = rows.join(keep, rows[row] == keep["_keep"], "left_semi")
    return kept.select(*(kept[c] for c in docs.columns))
