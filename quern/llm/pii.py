"""Personal data: fixed patterns, then information-theoretic sanitisation of terms.

The values that the patterns find are protected entities, and so are the parts
that values share: the host of an address, a network, the first digits of a
number.  So a term can reveal what entities seen once have in common.  Over the whole
corpus n(c) documents hold the entity c, n(t) the term t outside of entities and
n(c,t) both, wherever they stand in it; each row is a document, copies too.  The
pointwise mutual information log(N n(c,t) / (n(c) n(t))) says how much t tells of
c.  A term that tells more than the share ``disclosure`` of the entity's own
information log(N / n(c)) would let a reader infer c without seeing it, so every
occurrence of it in every document is reported (and generalised to its kind in
``sanitised``), whether or not the entity is there.

Terms are words of any length, in lower case; scripts written without spaces
give each two neighbouring characters as a term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, mix64, texts, united
from .spans import Span, digest, joined, parsed, replacing

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # sought from the start of each run of digits, where a match must begin
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Characters of scripts without spaces between words.
_CJK = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W\d_{_CJK}]+")
#: Two such letters in a row (also overlapping ones), or a single one between other characters.
_PAIR = re.compile(rf"(?=([{_CJK}]{{2}}|(?<![{_CJK}])[{_CJK}](?![{_CJK}])))")
_SPACELESS = re.compile(rf"[{_CJK}]")
#: Documents in which a term must stand together with an entity before it can disclose it.
SUPPORT = 3
FILTER_BITS = 23
#: Pairs of entity and term, and counted entities and terms, that a task holds before it sends them on.
PAIRS, COUNTED = 1 << 18, 300_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Matches of _EMAIL, sought from each @ backwards: a match starts where its run of characters does."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield "email", m.start(), m.end()
            end = m.end()
        at = max(at + 1, end)


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' matches, leftmost and non-overlapping for each kind; failing ones are dropped."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


def _hash(term: str) -> int:
    n = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def entities_of(kind: str, value: str) -> Iterator[str]:
    """An entity and the parts of its value that several entities share: host, network, area or issuer."""
    yield f"{kind}:{value}"
    if kind == "email":
        yield f"host:{value.rpartition('@')[2].lower()}"
    elif kind == "ip":
        parts = value.split(".")
        yield f"net:{'.'.join(parts[:3])}"
        yield f"net:{'.'.join(parts[:2])}"
    else:
        yield f"{kind} begins:{''.join(_DIGITS.findall(value))[:6 if kind == 'card' else 4]}"


def _split(text: str) -> tuple[list[Span], set[str], str]:
    """The base spans, the entities, and the text with spaces for them."""
    own = base_spans(text)
    entities = {e for kind, a, b in own for e in entities_of(kind, text[a:b])}
    rest, at = [], 0
    for _, a, b in sorted(own, key=lambda s: s[1:]):
        if b > at:
            rest += [text[at:a], " " * (b - max(a, at))]
            at = b
    return own, entities, "".join([*rest, text[at:]])


def _terms(rest: str) -> set[str]:
    """The distinct terms of a text without entities."""
    found = {t.lower() for t in set(_WORD.findall(rest))}
    if _SPACELESS.search(rest):
        found |= set(_PAIR.findall(rest))
    return found


def _places(rest: str) -> Iterator[tuple[str, int, int]]:
    """All occurrences of terms: the term, its start and end."""
    for m in _WORD.finditer(rest):
        yield m[0].lower(), m.start(), m.end()
    if _SPACELESS.search(rest):
        for m in _PAIR.finditer(rest):
            yield m[1], m.start(1), m.end(1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each entity and each term, in parts of about COUNTED different ones."""

    def made() -> Iterator[pa.RecordBatch]:
        for kind, seen in (("entity", entities), ("term", terms)):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(seen), pa.string()), pa.array([_hash(x) for x in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["kind", "key", "n"])
            seen.clear()

    entities, terms = Counter(), Counter()
    for batch in batches:
        for text in texts(batch):
            _, own, rest = _split(text)
            entities.update(own)
            terms.update(_terms(rest))
        if len(entities) + len(terms) > COUNTED:
            yield from made()
    yield from made()


def _pairs(often, wanted):
    """Documents of a task that hold both an entity and a term which the filters let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities, terms = (np.unpackbits(np.frombuffer(x.value, np.uint8)).view(bool) for x in (often, wanted))

        def made(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            both = np.concatenate([np.stack(x, axis=1) for x in held])
            order = np.lexsort((both[:, 1], both[:, 0]))
            both = both[order]
            first = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1))))
            return pa.RecordBatch.from_arrays([pa.array(both[first, 0]), pa.array(both[first, 1]), pa.array(np.diff(np.append(first, len(both))))], names=["entity", "term", "n"])

        held, size = [], 0
        for batch in batches:
            for text in texts(batch):
                _, own, rest = _split(text)
                c = np.array([_hash(x) for x in own], np.int64)
                c = c[entities[_slot(c)]]
                if not len(c):
                    continue
                t = np.array([_hash(x) for x in _terms(rest)], np.int64)
                t = t[terms[_slot(t)]]
                step = max(1, PAIRS // max(1, len(t)))
                for i in range(0, len(c) if len(t) else 0, step):
                    few = c[i : i + step]
                    held.append((np.repeat(few, len(t)), np.tile(t, len(few))))
                    size += len(few) * len(t)
                    if size >= PAIRS:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    return run


def _scan(told):
    """Base spans of each row, and its occurrences of terms that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = np.unpackbits(np.frombuffer(told.value, np.uint8)).view(bool) if told else None
        near_type = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            split = [_split(text) for text in texts(batch)]
            held = [_terms(rest) for _, _, rest in split] if told else [()] * len(split)
            names = list(set().union(*held))
            hashes = np.array([_hash(x) for x in names], np.int64)
            some = {names[i]: int(hashes[i]) for i in np.flatnonzero(terms[_slot(hashes)])} if names else {}
            base = [joined(own, KINDS) for own, _, _ in split]
            near = [[{"term": some[t], "start": a, "end": b} for t, a, b in _places(rest) if t in some] if not some.keys().isdisjoint(h) else [] for (_, _, rest), h in zip(split, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), pa.array(near, near_type)], names=["doc_id", "base", "near"])

    return run


def _slot(terms: np.ndarray) -> np.ndarray:
    return (mix64(terms.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_slot(batch.column("key").to_numpy())] = True
    packed = np.packbits(bits).reshape(-1, 4096)
    used = np.flatnonzero(packed.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])


def _filter(keys: DataFrame):
    """A broadcast of 2**FILTER_BITS bits, of which those of ``keys`` (column key) are set."""
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in united(keys.select("key").mapInArrow(_slots, "block int, bits binary")).toLocalIterator():
        bits[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def disclosing_terms(docs: DataFrame, disclosure: float) -> DataFrame:
    """Hashes (key) of the terms whose information on some entity exceeds its share of the entity's own."""
    counted = docs.select("text").mapInArrow(_count, "kind string, key long, n long")
    counted = Stored(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT), "counts").df
    often, seen = (counted.where(F.col("kind") == kind).select("key", "n") for kind in ("entity", "term"))
    most, total = often.agg(F.max("n")).first()[0], docs.count()
    if most is None:
        return seen.select("key").limit(0)
    # n(c,t) <= n(c), so a term of more documents than this tells too little of every entity (for any disclosure >= 0).
    seen = seen.where(F.col("n") <= total * (most / total) ** max(disclosure, 0.0) * (1 + 1e-9))
    pairs = docs.select("text").mapInArrow(_pairs(_filter(often), _filter(seen)), "entity long, term long, n long")
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both")).where(F.col("both") >= SUPPORT)
    told = pairs.join(often.select(F.col("key").alias("entity"), F.col("n").alias("alone")), "entity").join(seen.select(F.col("key").alias("term"), F.col("n").alias("seen")), "term")
    pmi = F.log(F.lit(float(total)) * F.col("both") / (F.col("alone") * F.col("seen")))
    return told.where(pmi > disclosure * F.log(F.lit(float(total)) / F.col("alone"))).select(F.col("term").alias("key")).distinct()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans = [], []
        for base, terms in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
            found = parsed(base)
            digests.append(digest(base))
            found += sorted({("term", t["start"], t["end"]) for t in terms or ()})
            for k in KINDS:
                n[k].append(sum(s[0] == k for s in found))
            spans.append(joined(found, KINDS))
        counts = [pa.array(n[k], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts[:4], pa.array(digests), pa.array(spans), counts[4]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])


def find_personal_data(docs: DataFrame, disclosure: float = 0.8) -> DataFrame:
    """A row per row of ``docs``: doc_id, counts by kind, base_sha256, spans, n_term.

    Null texts are empty and give no span; every row is a document of its own,
    also where rows share a doc_id (or have none) or are copies; texts are read
    whole at any length, in time that grows with it, but for the pairs of an
    entity and a term of one document; of base matches that overlap each kind
    keeps its own; an empty table gives an empty result; columns other than
    doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = Stored(disclosing_terms(docs, disclosure), "told").df
    none = told.isEmpty()
    made = docs.mapInArrow(_scan(None if none else _filter(told)), "doc_id long, base string, near array<struct<term: long, start: int, end: int>>")
    scanned = Stored(made.withColumn("row", F.monotonically_increasing_id()), "personal").df
    result = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"
    if none:
        return scanned.select("doc_id", "base", F.array().cast("array<struct<start: int, end: int>>").alias("terms")).mapInArrow(_finish, result)
    near = scanned.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", F.col("x.term").alias("key"), "x.start", "x.end")
    terms = near.join(told, "key").groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("terms"))
    return scanned.select("row", "doc_id", "base").join(terms, "row", "left").select("doc_id", "base", "terms").mapInArrow(_finish, result)


def sanitised(docs: DataFrame, disclosure: float = 0.8) -> DataFrame:
    """``docs`` with entities and disclosing terms in ``text`` generalised to their kind; rows and columns stay as they are."""
    return replacing(docs, lambda rows: find_personal_data(rows, disclosure))
