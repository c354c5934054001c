"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from quern.llm.common import Stored, table
from quern.llm.queries import PACKING_VOCABULARY, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic (score of one half or more) go; all others stay.

    Each row is judged alone by its whole text, however long, so repeated rows
    fare alike.  A null or empty text and a null doc_id are no reason to go; an
    empty table stays empty; other columns pass through, whatever their names.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the largest doc_id stays, and of its repeated rows one.

    A null text equals the empty one; a null doc_id stays only where its text has
    no other; long texts are compared by their chunks' names; an empty table
    stays empty; other columns pass through.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingle similarity of 0.75 links, the least doc_id stays, and of its rows one.

    Texts without words are linked with nothing and all stay; a null doc_id stays
    only where its group has no other; long texts count whole; an empty table
    stays empty; other columns pass through.
    """
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows in the order of the mixture schedule.

    A source's target weight is its characters to the power one half.  A null
    source is one of its own, a null text counts one character, a long text
    stands where it begins; ties of place go by doc_id, nulls first, then by a
    hash of the text; repeated rows all stay; an empty table stays empty.
    """
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens, shard after shard in the order of the rows.

    A null text is the end token alone; long texts fill windows of their own;
    repeated rows are packed once each; an empty table gives no piece.
    """
    return packing.pack(docs, vocabulary(PACKING_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training, scheduling and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; what a stage stored goes when the next has been written."""
    docs, mark = table(spark, sf_dir, "documents"), len(Stored.made)
    for name, stage in STAGES[:-1]:
        held = Stored(stage(spark, docs, sf_dir), name)
        Stored.drop_since(mark, held)
        docs = held.df
    return STAGES[-1][1](spark, docs, sf_dir)
