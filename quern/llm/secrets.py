"""Secret scan: fixed patterns, then a battery of randomness tests under FDR control.

Candidates are long runs of characters in which keys are written, also where a
pattern found them.  For each the smallest encoding that holds it is inferred,
down to digits or letters of one case, and tests ask whether it could be uniform
in that encoding: chi-squared over single characters at every length (the exact
distribution of the statistic where fewer than five of each are expected),
chi-squared over its character classes where it has several, runs above and below
the middle of the alphabet, and serial correlation of neighbours.  A candidate
that fails the battery is ordinary.  For the others the hypothesis to reject is
that the corpus writes such tokens: a model of neighbouring characters, counted
over all words of the corpus, gives the probability of the token, and its ratio
to the uniform probability bounds the chance of an ordinary token that looks so
random.  Benjamini-Hochberg over all candidates of one length class of the corpus
decides which are reported, so that of the reported tokens a share of at most
``level`` is expected to be ordinary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, text_bytes, text_slices, texts
from .spans import Span, digest, joined, parsed, replacing

KINDS = ("assign", "access", "hex", "random")
#: The base patterns, and what a match must have to count.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs of [0-9a-f] of 24 or more
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Least lengths of the length classes.
LENGTHS = (16, 20, 24, 32, 48, 64)
#: A candidate whose battery has a smaller p-value is not random.
UNIFORM = 0.001
#: p-values are counted in bins of -log10(p) of this width, up to the last bin.
BIN, BINS = 0.05, 400
#: Encodings from small to large: name, its characters in order, and its classes.
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("digits", (_DIG,)),
    ("hex", (_DIG, "abcdef")),
    ("HEX", (_DIG, "ABCDEF")),
    ("lower", (_LOW,)),
    ("upper", (_UP,)),
    ("base32", (_UP, "234567")),
    ("base36", (_DIG, _LOW)),
    ("BASE36", (_DIG, _UP)),
    ("letters", (_UP, _LOW)),
    ("base62", (_DIG, _UP, _LOW)),
    ("base64", (_DIG, _UP, _LOW, "+/")),
    ("base64url", (_DIG, _UP, _LOW, "-_")),
    ("any", (_DIG, _UP, _LOW, "+/-_")),
)


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' matches, leftmost and non-overlapping for each kind."""
    found: list[Span] = []
    if _HINT.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


@cache
def _encodings() -> list[tuple[frozenset, dict[str, int], np.ndarray]]:
    out = []
    for _, classes in ENCODINGS:
        signs = "".join(classes)
        out.append((frozenset(signs), {c: i for i, c in enumerate(signs)}, np.repeat(np.arange(len(classes)), [len(c) for c in classes])))
    return out


def _chi_squared(observed: np.ndarray, expected: np.ndarray) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    free = len(observed) - 1
    x = float(((observed - expected) ** 2 / expected).sum())
    z = ((x / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(512)
def _pair_tail(n: int, size: int) -> np.ndarray:
    """P(T >= t) for t = 0, 1, ...: pairs of equal characters among n that are uniform over ``size``.

    T is the chi-squared statistic up to scale and shift.  The counts are
    independent Poisson variables given their sum, so a Fourier transform over
    sum and pairs gives their distribution; errors are far below 1e-11, the
    least value returned.
    """
    mean = n * (n - 1) / 2 / size
    wide = 1 << int(mean + 20 * math.sqrt(mean) + 200).bit_length()  # more pairs than this do not occur
    sums = 2 * n + 64
    counts = np.arange(n + 1)
    rate = n / size
    weight = np.exp(counts * math.log(rate) - rate - np.array([math.lgamma(c + 1) for c in counts]))
    of_sum = np.exp(-2j * np.pi * (np.outer(np.arange(sums), counts) % sums) / sums) * weight
    of_pairs = np.exp(-2j * np.pi * (np.outer(counts * (counts - 1) // 2, np.arange(wide)) % wide) / wide)
    whole = (of_sum @ of_pairs) ** size
    at_n = (np.exp(2j * np.pi * (np.arange(sums) * n % sums) / sums) @ whole) / sums
    p = np.maximum(np.fft.ifft(at_n).real, 0)
    return np.clip(np.cumsum(p[::-1])[::-1] / p.sum(), 1e-11, 1.0)


def _uniform(counts: np.ndarray) -> float:
    """p-value of chi-squared over single characters."""
    n, size = int(counts.sum()), len(counts)
    if n >= 5 * size:
        return _chi_squared(counts, np.full(size, n / size))
    tail, pairs = _pair_tail(n, size), int((counts * (counts - 1) // 2).sum())
    return float(tail[pairs]) if pairs < len(tail) else 1e-11


def _encoding(token: str) -> tuple[frozenset, dict[str, int], np.ndarray]:
    """The smallest encoding that holds the token."""
    signs = frozenset(token)
    return next(e for e in _encodings() if signs <= e[0])


def randomness(token: str) -> float:
    """p-value of the battery that ``token`` is uniform in its inferred encoding (Bonferroni over the tests)."""
    _, number, classes = _encoding(token)
    v = np.array([number[c] for c in token])
    n, size = len(v), len(number)
    p = [_uniform(np.bincount(v, minlength=size))]
    share = np.bincount(classes) / size
    if len(share) > 1:
        p.append(_chi_squared(np.bincount(classes[v], minlength=len(share)), n * share))
    high = v >= size / 2
    up, down = int(high.sum()), int(n - high.sum())
    if up and down:
        mean = 2 * up * down / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p.append(math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread / math.sqrt(2)))
    else:
        p.append(2.0 ** (1 - n))
    x = v - v.mean()
    p.append(math.erfc(abs(float((x[1:] * x[:-1]).sum()) / max(float((x * x).sum()), 1e-9) + 1 / n) * math.sqrt(n) / math.sqrt(2)))
    return max(min(1.0, len(p) * min(p)), 1e-300)


#: The letters and digits as numbers 0 to 61, 62 for + / _ -, which stand between words of a token, 255 for all else.
_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer((_DIG + _UP + _LOW).encode(), np.uint8)] = np.arange(62)
_CODES[np.frombuffer(b"+/_-", np.uint8)] = 62
_START = 62
#: The model's share of characters between words, and of each single one.
BETWEEN = 0.05


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often one letter or digit follows another, or begins a word (after number 62), in this task's texts."""
    total = np.zeros(63 * 62, np.int64)
    for batch in batches:
        column = batch.column("text")
        for lo, hi in text_slices(column):
            raw, offsets = text_bytes(column.slice(lo, hi - lo))
            code = np.minimum(_CODES[raw], 62).astype(np.int64)
            before = np.concatenate([[62], code[:-1]]) if len(code) else code
            before[offsets[:-1][offsets[:-1] < len(code)]] = 62
            word = code < 62
            total += np.bincount(before[word] * 62 + code[word], minlength=63 * 62)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["pair", "n"])


def ordinary(docs: DataFrame) -> np.ndarray:
    """Logarithms of P(character | the one before) over all words of ``docs`` (text), row 62 for the first of a word."""
    counts = np.zeros(63 * 62)
    for row in docs.select("text").mapInArrow(_neighbours, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 63 x 62 rows at most
        counts[row["pair"]] = row["n"]
    counts = counts.reshape(63, 62) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True) * (1 - BETWEEN))


def surprise(token: str, model: np.ndarray) -> float:
    """-log10 of a bound of the chance that an ordinary token is so much better explained as uniform in some encoding.

    P(ordinary) / P(uniform) is the inverse of a mean-one statistic, so by
    Markov's inequality it is a p-value; the choice of one of the encodings is
    paid for by their number.  Any number is ordinary: digits that begin the
    token or follow digits have a tenth of the probability each, or what the
    corpus says if that is more.
    """
    code = _CODES[np.frombuffer(token.encode(), np.uint8)].astype(np.int64)
    before = np.concatenate([[_START], code[:-1]])
    word = code < 62
    steps = model[before[word], code[word]]
    number = (code[word] < 10) & ((before[word] < 10) | (np.flatnonzero(word) == 0))
    log = np.where(number, np.maximum(steps, -math.log(10)), steps).sum() + (~word).sum() * math.log(BETWEEN / 4)
    size = len(_encoding(token)[1])
    return -(log + len(token) * math.log(size) + math.log(len(ENCODINGS))) / math.log(10)


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            base, tested = [], []
            for text in texts(batch):
                base.append(joined(base_spans(text), KINDS))
                more = []
                for m in _CANDIDATE.finditer(text):
                    far = min(max(surprise(m[0], known), 0.0), BIN * BINS)
                    if far and randomness(m[0]) < UNIFORM:
                        far = 0.0
                    more.append({"start": m.start(), "end": m.end(), "length_class": sum(len(m[0]) >= n for n in LENGTHS) - 1, "bin": int(far / BIN)})
                tested.append(more)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length_class", pa.int32()), ("bin", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), pa.array(tested, kind)], names=["doc_id", "base", "tested"])

    return run


def reported_bins(counts: dict[tuple[int, int], int], level: float) -> dict[int, int]:
    """For each length class the least bin that Benjamini-Hochberg reports (BINS + 1: none); bin 0 holds p-values up to 1."""
    out = {}
    for kind in range(len(LENGTHS)):
        of = [counts.get((kind, b), 0) for b in range(BINS + 1)]
        total, above, best = sum(of), 0, BINS + 1
        for b in range(BINS, -1, -1):
            above += of[b]
            if b and above and 10 ** (-b * BIN) <= level * above / total:  # the largest p-value of the bin
                best = b
        out[kind] = best
    return out


def _finish(least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for base, tested in zip(batch.column("base").to_pylist(), batch.column("tested").to_pylist(), strict=True):
                found = parsed(base)
                digests.append(digest(base))
                found += [("random", t["start"], t["end"]) for t in tested if t["bin"] >= least[t["length_class"]]]
                for k in KINDS:
                    n[k].append(sum(s[0] == k for s in found))
                spans.append(joined(found, KINDS))
            counts = [pa.array(n[k], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts[:3], pa.array(digests), pa.array(spans), counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return run


def find_secrets(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """A row per row of ``docs``: counts by kind, base_sha256, spans, n_random.

    Base spans stay as the patterns give them; a candidate that the battery
    reports is a ``random`` span, also inside a base one.  Null texts are empty
    and give no span; repeated rows give equal rows; candidates of one bin of
    p-values are reported together; an empty table gives an empty result;
    columns other than doc_id and text are ignored.  The whole text is read
    whatever its length.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(ordinary(held))
    scanned = Stored(held.mapInArrow(_scan(model), "doc_id long, base string, tested array<struct<start: int, end: int, length_class: int, bin: int>>"), "secrets").df
    counted = scanned.select(F.explode("tested").alias("t")).groupBy("t.length_class", "t.bin").count().collect()  # at most classes x bins rows
    least = reported_bins({(r["length_class"], r["bin"]): r["count"] for r in counted}, level)
    return scanned.mapInArrow(_finish(least), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redacted(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets; rows and columns stay as they are."""
    return replacing(docs, lambda rows: find_secrets(rows, level))
