"""Spans found in texts: order, digest and replacement."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_rows, plain_names

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end of all spans by start, then kind as listed, then end; code points, end exclusive."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def parsed(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def replaced(text: str, spans: Iterable[Span]) -> str:
    """``text`` with each span, joined with those it overlaps, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def replacing(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with the spans that ``find`` gives for (doc_id, text) replaced in ``text``; rows are told apart by numbers."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if not s else replaced(t or "", parsed(s)) for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows, row = numbered_rows(docs, "rows")
    found = find(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("number"), F.col("spans").alias("found"))
    held, name = plain_names(rows)
    held = held.join(found, F.col(name[row]) == F.col("number"))
    return held.withColumn(name["text"], replace(name["text"], "found")).select(*(name[c] for c in docs.columns)).toDF(*docs.columns)
