"""Models behind small interfaces, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import words


#: Words of texts that are counted at once (longer texts stand alone).
MOST_WORDS = 1 << 17


class Embedder(Protocol):
    dimension: int

    def column(self, text: Column) -> Column: ...


class TextGenerator(Protocol):
    def complete(self, prompt: str, system: str | None = None) -> str: ...

    def stream(self, prompt: str, system: str | None = None) -> Iterator[str]: ...


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class HashedWords:
    """A unit vector of counts of words, each in the bucket that its MD5 names (SQL can repeat it)."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def column(self, text: Column) -> Column:
        dimension = self.dimension

        @F.arrow_udf("array<double>")
        def run(lists: pa.Array) -> pa.Array:
            bucket = lru_cache(1 << 16)(lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimension)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            counts, ends = np.zeros((len(lists), dimension)), np.cumsum(sizes, dtype=np.int64)
            lo = 0
            while lo < len(lists):  # slices of whole texts; only the distinct words of one become Python's
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MOST_WORDS, side="right")))
                held = lists.slice(lo, hi - lo).flatten().dictionary_encode()
                buckets = np.array([bucket(w) for w in held.dictionary.to_pylist()], int)
                cells = np.repeat(np.arange(hi - lo) * dimension, sizes[lo:hi]) + buckets[held.indices.to_numpy()]
                counts[lo:hi] = np.bincount(cells, minlength=(hi - lo) * dimension).reshape(hi - lo, dimension)
                lo = hi
            norms = np.sqrt((counts**2).sum(axis=1, keepdims=True))
            counts /= np.where(norms > 0, norms, 1.0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimension, pa.int32()), pa.array(counts.ravel()))

        return run(words(text))


class PandasEmbedder:
    """A model function (list of texts -> list of vectors), called in batches by the executors."""

    def __init__(self, embed, dimension: int, batch: int = 100):
        self.embed, self.dimension, self.batch = embed, dimension, batch

    def column(self, text: Column) -> Column:
        embed, dimension, batch = self.embed, self.dimension, self.batch

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            out: list = []
            for lo in range(0, len(texts), batch):
                part = ["" if t is None else t for t in texts.iloc[lo : lo + batch]]
                vectors = [[float(x) for x in v] for v in embed(part)]
                if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                    raise ValueError("the model returned another number of vectors, or of components")
                out += vectors
            return pd.Series(out, dtype=object)

        return run(text)


class Scripted:
    """Answers prompts from given texts: the first whose key the prompt holds, else the default."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = ""):
        self.answers, self.default = answers or {}, default

    def complete(self, prompt: str, system: str | None = None) -> str:
        return next((a for k, a in self.answers.items() if k in prompt), self.default)

    def stream(self, prompt: str, system: str | None = None) -> Iterator[str]:
        yield from self.complete(prompt, system)


class WordOverlap:
    """The share of a query's distinct words that a text holds."""

    def score(self, query: Column, text: Column) -> Column:
        asked = F.array_distinct(words(query))
        held = F.array_intersect(asked, words(text))
        return F.when(F.size(asked) > 0, F.size(held) / F.size(asked)).otherwise(0.0)


def messages(user: str, system: str | None = None) -> list[dict[str, str]]:
    """Chat turns, the system's first."""
    return ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]


def answered(generator: TextGenerator, prompt: Column) -> Column:
    """The generator's answer to each prompt, on the executors; none is empty."""
    return F.udf(lambda p: generator.complete(p or "") or "")(prompt)
