"""Shared helpers: tables, shared storage, Arrow batches and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, opened by Spark's own reader."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none (local tests) a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return context._jsc.sc().getCheckpointDir().get()


class Stored:
    """A DataFrame written to the shared folder, so that later jobs start from it."""

    made: ClassVar[list[Stored]] = []

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.path = f"{shared_dir(self.spark).rstrip('/')}/quern-{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        Stored.made.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    @classmethod
    def drop_since(cls, mark: int, keep: Stored) -> None:
        """Delete what was stored since ``made`` had ``mark`` members, but for ``keep``; no later job may read it."""
        gone = [s for s in cls.made[mark:] if s is not keep]
        cls.made[mark:] = [keep]
        for s in gone:
            s.drop()

    def drop(self) -> None:
        """Delete the files; no later job may read them."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered_rows(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written once with a number for each row, and the name of that column."""
    name, taken = "_row", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return Stored(df.withColumn(name, F.monotonically_increasing_id()), tag).df, name


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns c0, c1, ..., which no column that an operator adds is called, and their names by the old ones."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def united(bits: DataFrame) -> DataFrame:
    """Unions of binary rows (block, bits) of equal length by block; a task holds one union a block."""

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, b in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                held[block] = held.get(block, 0) | np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["block", "bits"])

    return bits.repartition("block").mapInArrow(either, "block int, bits binary")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` characters each (longer rows stand alone)."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(column.cast(pa.large_binary())).to_pylist()):
        n = n or 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if len(column) > start:
        yield start, len(column)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column with null as the empty string."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n + 1 offsets; null is empty."""
    array = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths)
