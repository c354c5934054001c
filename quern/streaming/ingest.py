"""Streaming forms of cleaning, chunking and exact deduplication (an extension: batch is the parity surface)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import chunking
from ..operators.refine import text_key


def chunk_stream(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of a stream of documents (doc_id, text): stateless, so it runs in append mode."""
    return chunking.fixed(docs.withColumn("text", clean(F.col("text"), compose=False)), size, overlap)


def unique_stream(docs: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first document of each text within the watermark; state of older texts is dropped."""
    return docs.withColumn("key", text_key(F.col("text"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])
