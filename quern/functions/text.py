"""Text as Column expressions; lengths and positions are code points."""

from __future__ import annotations

from functools import reduce
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rounds in which wrapped headings of slides are unwrapped.
ROUNDS = 8


def strip(text: Column) -> Column:
    """Without white space (of all Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks, numbers and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)


def sentences(text: Column) -> Column:
    """Parts that end after one of 。！？.!?, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？.!?])"), strip), lambda s: s != "")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, for which there is no built-in expression."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalize("NFKC", t))

    return run(text)


def clean_slides(text: Column) -> Column:
    """Slide text without title lines, rules, note labels and heading or bold marks.

    Wrapped headings are unwrapped until none is left; as every other mark goes
    in the end, unwrapping only changes white space beside marks, and each round
    takes two marks of a pair, so ROUNDS rounds settle lines of up to twice as
    many; marks beyond them go too, with the white space beside them kept.
    """
    # The patterns and what takes their place, in their order.
    steps = [
        (r"(?m)^Title:\s*.+\s*$", ""),
        (r"(?m)^-{3,}\s*$", ""),
        (r"(?m)^\[Speaker Notes\]:\s*", ""),
        (r"(?m)^#\s*\*\*(.+?)\*\*\s*$", "$1"),
        (r"\*\*(.+?)\*\*", "$1"),
        *[(r"#\s*(.+?)\s*#", "$1")] * ROUNDS,
        (r"(?m)^#\s+", ""),
        (r"#\s*$", ""),
        (r"\s+#\s+", ""),
        (r"#", ""),
    ]
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def clean(text: Column, suffix: Column | None = None, compose: bool = True) -> Column:
    """Normalised text: no zero-width or control characters, trimmed lines, no blank line."""
    out = F.regexp_replace(text, r"[\uFEFF\u200B-\u200D]", "")
    out = nfkc(out) if compose else out
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    if suffix is not None:
        out = F.when(F.lower(suffix).isin(".pptx", ".ppt", ".pptm"), clean_slides(out)).otherwise(out)
    lines = F.filter(F.transform(F.split(out, "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


def labelled(*parts: tuple[str, Column], sep: str = "\n") -> Column:
    """'label: value' of each field, joined: the text of a node that is embedded."""
    return F.concat_ws(sep, *(F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit(""))) for label, value in parts))
