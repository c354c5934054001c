"""Packing documents into fixed windows by the sum-of-squares rule, online.

A shard (one input partition, in its row order) keeps a level array: N[h] is
the number of open windows filled to level h.  A document fills whole windows
first; its rest of s tokens goes to the level h whose choice leaves the least
sum of N[h]**2 over open levels.  At the end of a shard the windows still open
are emptied into each other, cutting documents, and the last one is divided at
powers of two, which need no padding.  So only whole windows and powers of two
remain, and a shard depends on no other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import WordTokenizer

#: Shard numbers stand in the bits above this one of a sequence_id.
SHARD_BITS = 32
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelArray:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """The level (0: a new window) where ``size`` tokens least raise the sum of squares.

        Moving a window from h to h + size changes the sum by
        2 * (N[h + size] - N[h]) + 2; a new window adds 2 * N[size] + 1; one
        that gets full takes 2 * N[h] - 1 away.  Ties go to the fullest level.
        """
        n, top = self.count, self.window - size
        delta = 2 * (n[size : self.window] - n[:top]) + 2
        delta[0] = 2 * n[size] + 1 if size < self.window else 0
        delta[1:][n[1:top] == 0] = np.iinfo(np.int64).max
        best = top - 1 - int(np.argmin(delta[::-1])) if top else 0
        least = delta[best] if top else 0
        if top and n[top] and 1 - 2 * n[top] <= least:
            return top
        return best

    def place(self, size: int, piece) -> list | None:
        """Put a piece of 1 to window - 1 tokens; the window's pieces if it is full now."""
        level = self.choose(size)
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        else:
            held = []
        held.append(piece)
        level += size
        if level == self.window:
            return held
        self.open.setdefault(level, []).append(held)
        self.count[level] += 1
        return None

    def rest(self) -> list[list]:
        """Pieces of the windows still open, the fullest window first."""
        return [w for level in sorted(self.open, reverse=True) for w in self.open[level]]


def closing(pieces: list[tuple], window: int) -> Iterator[list[tuple]]:
    """Full windows, then powers of two, from the pieces (doc, start, ids, tokens) of open windows."""
    total = sum(len(p[2]) for p in pieces)
    sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if (total % window) >> b & 1]
    rest = iter(pieces)
    doc, start, ids, tokens = next(rest, (0, 0, (), 0))
    for size in sizes:
        held, room = [], size
        while room:
            if not len(ids):
                doc, start, ids, tokens = next(rest)
            taken = min(room, len(ids))
            held.append((doc, start, ids[:taken], tokens))
            start, ids, room = start + taken, ids[taken:], room - taken
        yield held


def _pack(tokenizer_file: str, end_id: int, window: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.shared(tokenizer_file, special_as_text)
        levels, sequence, rows = LevelArray(window), TaskContext.get().partitionId() << SHARD_BITS, []

        def emit(held: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, tokens in held:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            doc_ids, column = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            for lo, hi in text_slices(column):
                for doc, ids in zip(doc_ids[lo:hi], tokenizer.encode(column.slice(lo, hi - lo).to_pylist(), end_id), strict=True):
                    whole = len(ids) // window * window
                    for start in range(0, whole, window):
                        emit([(doc, start, ids[start : start + window], len(ids))])
                    if whole < len(ids):
                        full = levels.place(len(ids) - whole, (doc, whole, ids[whole:].copy(), len(ids)))
                        if full:
                            emit(full)
                if len(rows) > 5000:
                    yield flush()
        for held in closing([p for w in levels.rest() for p in w], window):
            emit(held)
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, window: int = 4096, special_as_text: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    One row per piece: doc_id, start (tokens of its document before it),
    length, ids_crc32 (of its ids as little-endian 32-bit words), doc_tokens
    (with the end id), sequence_id and offset in the sequence.  A null text is
    the empty text, whose document is the end id alone; a text of more than a
    window fills whole windows first; repeated rows are packed once each, and a
    null doc_id stays null; equal levels are chosen fullest first; an empty table
    gives no piece; columns other than doc_id and text are ignored.  The string
    of a special token in a text gives that token's id, as the library has it by
    default, or with ``special_as_text`` the ids of its characters.  No shuffle: each partition of ``docs`` is a shard and
    is read once, in order, with only the pieces of open windows held.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(_pack(tokenizer_file, end_id, window, special_as_text), _PIECES)
