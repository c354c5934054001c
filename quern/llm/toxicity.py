"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are words of a fixed lexicon, surface patterns, and words and word
beginnings induced from labelled rows.  The generative model says how each voter
fires on toxic and on other documents, given the vote of one other voter on which
it depends most: the voters' accuracies and their correlations are parameters,
and the dependences form the tree of greatest conditional mutual information.  A
given label is one more voter, whose accuracy is estimated too.  Expectation
maximisation finds all of them together with the posterior labels, over the votes
of every document that may be learned from.  A logistic classifier trained on
posterior labels then scores whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, held_out, text_bytes, text_slices
from .shingles import beginnings, word_hashes

#: Fixed lexicon of insults: voters that need no labelled row.
LEXICON = ("idiot moron stupid loser pathetic worthless scum trash disgusting clown dumb imbecile vermin filth jerk bastard idiota estúpido imbécil basura idiote crétin débile ordure trottel dummkopf abschaum versager").split()
#: Bytes of word beginnings that may become voters (0: the whole word).
PREFIXES = (0, 4, 5, 6, 7, 8, 9)
#: Labelled rows from which voters are induced and the classifier learns, and the voters induced.
LABELLED, INDUCED = 8000, 300
#: Rounds of expectation maximisation without and with dependences.
ROUNDS = 6
#: Different votes that a task sums, and the most tasks that sum them.
PART_ROWS, PARTS = 20_000, 64
#: Bytes of text that are worked on at once.
SLICE = 1 << 18
_GAPS = np.ones(256, bool)
_GAPS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_PATTERNS = 3


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]), _GAPS)[0][0])


def marks(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words and their beginnings, by length; beginnings count only for longer words."""
    hashes, first, sizes = beginnings(raw, offsets, PREFIXES, _GAPS)
    for i, most in enumerate(PREFIXES):
        if most:
            hashes[i] = np.where(sizes > most, hashes[i] ^ np.uint64(0xA5A5 * most), np.uint64(0))
    return hashes, first


def patterns(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Surface patterns by document: shouting, runs of exclamation marks, masked letters."""
    def sums(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    size = np.maximum(np.diff(offsets), 1)
    upper, lower = sums((raw >= 0x41) & (raw <= 0x5A)), sums((raw >= 0x61) & (raw <= 0x7A))
    bang = raw == 0x21
    twice = bang.copy()
    twice[1:] &= bang[:-1]
    letter, star = ~_GAPS[raw], raw == 0x2A
    masked = np.zeros(len(raw), bool)
    masked[1:-1] = letter[:-2] & star[1:-1] & (star[2:] | letter[2:])
    return np.stack([(upper > lower) & (upper >= 20), sums(twice) * 200 > size, sums(masked) > 0], axis=1)


@dataclass
class Model:
    """Sorted voter hashes and the linear classifier over their votes, patterns and length."""

    voters: np.ndarray
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = field(default=None)

    def votes(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which voters fire on each document: once or more, twice or more, then the patterns."""
        n, docs = len(self.voters), len(offsets) - 1
        times = np.zeros(docs * n, np.int64)
        filtered = np.zeros(1 << 16, bool)
        filtered[(self.voters & np.uint64(0xFFFF)).astype(np.int64)] = True
        hashes, first = marks(raw, offsets)
        for words in hashes:
            hit = np.flatnonzero(filtered[(words & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(self.voters, words[hit])
            at[at == n] = 0
            hit, at = hit[self.voters[at] == words[hit]], at[self.voters[at] == words[hit]]
            times += np.bincount((np.searchsorted(first, hit, side="right") - 1) * n + at, minlength=docs * n)
        times = times.reshape(docs, n)
        return np.concatenate([times > 0, times > 1, patterns(raw, offsets)], axis=1).astype(np.float64)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = features(self.votes(raw, offsets), offsets)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def features(votes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes and the logarithm of the length: a voter tells less in a long text."""
    return np.concatenate([votes, (np.log1p(np.diff(offsets))[:, None] / 10).astype(votes.dtype)], axis=1)


@dataclass
class LabelModel:
    """Share of toxic documents; P(label 1 | y); each voter's parent (-1: none); P(vote | y, parent's vote)."""

    prior: float
    label: np.ndarray
    parent: np.ndarray
    table: np.ndarray

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of 0/1 votes; labels are 0, 1 or -1 (not known)."""
        on, off = np.log(self.table[1] / self.table[0]), np.log((1 - self.table[1]) / (1 - self.table[0]))
        mine, other = on - off, off[1] - off[0]
        above = _above(votes, self.parent)
        log = math.log(self.prior / (1 - self.prior)) + off[0].sum() + votes @ mine[0] + above @ other + (votes * above) @ (mine[1] - mine[0])
        told = np.log(np.stack([1 - self.label, self.label]))[:, 1] - np.log(np.stack([1 - self.label, self.label]))[:, 0]
        log += np.where(labels == 1, told[1], np.where(labels == 0, told[0], 0.0))
        return 1 / (1 + np.exp(-np.clip(log, -30, 30)))


def _above(votes: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The votes of each voter's parent, 0 without one."""
    return np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0).astype(votes.dtype)


def first_guess(votes: np.ndarray, labels: np.ndarray, any_label: bool) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors to begin with, and the weight of each row: the labels, or where there are none whether voters fire."""
    if any_label:
        return np.where(labels == 1, 0.95, 0.05), (labels >= 0).astype(float)
    return np.where(votes.any(axis=1), 0.7, 0.05), np.ones(len(labels))


def moments(model: LabelModel | None, parent: np.ndarray, votes: np.ndarray, labels: np.ndarray, counts: np.ndarray, any_label: bool) -> np.ndarray:
    """Sums by class: rows, labelled rows, rows labelled 1, votes, votes together with the parent's."""
    both, out = votes * _above(votes, parent), []
    for p in _classes(model, votes, labels, any_label):
        w = p * counts
        out.append(np.concatenate([[w.sum(), w[labels >= 0].sum(), w[labels == 1].sum()], w @ votes, w @ both]))
    return np.array(out)


def maximised(sums: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The model of greatest likelihood (with weak priors) for sums by class."""
    n = (sums.shape[1] - 3) // 2
    rows, told, ones, fired, both = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3 : 3 + n], sums[:, 3 + n :]
    alone = np.clip((fired + 0.05) / (rows[:, None] + 1), 1e-6, 1 - 1e-6)
    above = np.where(parent >= 0, fired[:, np.maximum(parent, 0)], 0.0)
    given = np.stack([(fired - both + 2 * alone) / (rows[:, None] - above + 2), (both + 2 * alone) / (above + 2)], axis=1)
    label = np.clip((ones + [1, 9]) / (told + 10), 1e-4, 1 - 1e-4)
    prior = float(np.clip((rows[1] + 1) / (rows.sum() + 20), 0.002, 0.5))
    return LabelModel(prior, label, parent, np.clip(given, 1e-6, 1 - 1e-6))


def dependences(rows: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree of greatest mutual information given the class, -1 where nothing speaks for one.

    ``rows`` holds the weight of each class, ``both`` (2, n, n) how often two voters fire together.
    """
    n, total = both.shape[1], max(float(rows.sum()), 1e-9)
    gain = np.zeros((n, n))
    for m, size in zip(both, np.maximum(rows, 1e-9), strict=True):
        one = np.diag(m) / size
        p11 = m / size
        for p, a, b in ((p11, one, one), (one[:, None] - p11, one, 1 - one), (one[None] - p11, 1 - one, one), (1 - one[:, None] - one[None] + p11, 1 - one, 1 - one)):
            p = np.clip(p, 1e-12, 1)
            gain += size / total * p * np.log(p / np.maximum(np.outer(a, b), 1e-12))
    np.fill_diagonal(gain, 0)
    gain[2 * total * gain < 11] = 0  # as likely by chance as one in a thousand
    parent, best, source = np.full(n, -1), np.full(n, -1.0), np.full(n, -1)
    left = np.ones(n, bool)
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -2)))
        if best[i] > 0:
            parent[i] = source[i]
        left[i] = False
        better = left & (gain[i] > best)
        best[better], source[better] = gain[i][better], i
    return parent


def _classes(model: LabelModel | None, votes: np.ndarray, labels: np.ndarray, any_label: bool) -> list[np.ndarray]:
    """The weight of each row in each class."""
    q, weight = (model.posterior(votes, labels), 1.0) if model else first_guess(votes, labels, any_label)
    return [(1 - q) * weight, q * weight]


def estimated(sums: Callable[[LabelModel | None, np.ndarray], np.ndarray], together: Callable[[LabelModel | None], np.ndarray], voters: int) -> LabelModel:
    """Expectation maximisation: ``sums`` gives the moments under a model, ``together`` the voters' joint ones.

    The dependences are found under the first guess, so that repeated voters
    never outvote the others, and once more under the model.
    """
    model, parent = None, np.full(voters, -1)
    for _ in range(2):
        parent = dependences(sums(model, parent)[:, 0], together(model))
        for _ in range(ROUNDS):
            model = maximised(sums(model, parent), parent)
    return model


def label_model(votes: np.ndarray, labels: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """The model and the posteriors of rows held in memory."""
    ones, any_label = np.ones(len(labels)), bool((labels >= 0).any())

    def together(model: LabelModel | None) -> np.ndarray:
        return np.stack([(votes * p[:, None]).T @ votes for p in _classes(model, votes, labels, any_label)])

    model = estimated(lambda m, parent: moments(m, parent, votes, labels, ones, any_label), together, votes.shape[1])
    return model, model.posterior(votes, labels)


def logistic(x: np.ndarray, q: np.ndarray, weight: np.ndarray | float = 1.0, penalty: float = 0.5, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias that fit soft labels of weighted rows, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (weight * (p - q)) + keep * w)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def _documents_with(raw: np.ndarray, offsets: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
    """Every mark once for each document that holds it, or those of ``only`` (sorted)."""
    hashes, first = marks(raw, offsets)
    doc, out = np.repeat(np.arange(len(first) - 1), np.diff(first)), []
    for words in hashes:
        w, d = words, doc
        if only is not None:
            at = np.searchsorted(only, w)
            at[at == len(only)] = 0
            w, d = w[only[at] == w], d[only[at] == w]
        order = np.lexsort((d, w))
        w, d = w[order], d[order]
        fresh = w > 0
        fresh[1:] &= (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        out.append(w[fresh])
    return np.concatenate(out)


def _marks(only: np.ndarray | None, wanted: int):
    """In how many texts of rows labelled ``wanted`` each mark stands, batch by batch; all marks, or those of ``only``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.filter(pc.equal(batch.column("toxic"), wanted)).column("text")
            for lo, hi in text_slices(column, SLICE):
                found, n = np.unique(_documents_with(*text_bytes(column.slice(lo, hi - lo)), only), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["mark", "n"])

    return run


def induced(sample: DataFrame, one: int, two: int) -> np.ndarray:
    """Marks that stand mostly in toxic rows of ``sample`` (text, toxic), the INDUCED strongest by likelihood ratio.

    ``one`` and ``two`` are the numbers of toxic and of other rows.
    """
    if not one:
        return np.zeros(0, np.uint64)
    toxic = Stored(sample.mapInArrow(_marks(None, 1), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).where("n >= 4"), "marks").df
    only = np.sort(np.array([r["mark"] for r in toxic.select("mark").toLocalIterator()], np.int64).view(np.uint64))
    if not len(only):
        return only
    clean = sample.mapInArrow(_marks(only, 0), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("m"))
    m = F.coalesce("m", F.lit(0))
    odds = F.log((F.col("n") + 0.5) / (one + 1) / ((m + 0.5) / (two + 1)))
    gain = F.round(F.col("n") * F.col("odds") - F.greatest(F.col("n") - m * (one / max(two, 1)), F.lit(0.0)), 9)
    strong = toxic.join(clean, "mark", "left").withColumn("odds", odds).withColumn("gain", gain).where(f"odds > {math.log(3)} and gain > 8")
    return np.array([r["mark"] for r in strong.orderBy(F.desc("gain"), "mark").limit(INDUCED).collect()], np.int64).view(np.uint64)


def _packed(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Range of rows, their votes packed to bits, and the lengths of their texts."""
    column = batch.column("text")
    for lo, hi in text_slices(column, SLICE):
        raw, offsets = text_bytes(column.slice(lo, hi - lo))
        yield lo, hi, np.packbits(model.votes(raw, offsets) > 0, axis=1), np.diff(offsets)


def _patterns(model: Model):
    """How many rows of a batch have the same votes and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int8)
            for lo, hi, bits, _ in _packed(model, batch):
                rows, n = np.unique(np.concatenate([bits, toxic[lo:hi, None].view(np.uint8)], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r[:-1].tobytes() for r in rows], pa.binary()), pa.array(rows[:, -1].view(np.int8).astype(np.int32)), pa.array(n, pa.int64())], names=["votes", "toxic", "n"])

    return run


def _sample_votes(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, bits, sizes in _packed(model, batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "toxic", "votes", "size"])

    return run


def _unpacked(rows: list[bytes], voters: int) -> np.ndarray:
    bits = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -(-voters // 8))
    return np.unpackbits(bits, axis=1, count=voters).astype(np.float32)


def _batch_votes(batch: pa.RecordBatch, voters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpacked(batch.column("votes").to_pylist(), voters), batch.column("toxic").to_numpy(), batch.column("n").to_numpy().astype(float)


def over_all(patterns: DataFrame, voters: int, any_label: bool) -> LabelModel:
    """The label model of all rows of ``patterns`` (votes, toxic, n), summed by the executors in each round."""

    def sums(model: LabelModel | None, parent: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 3 + 2 * voters))
            for batch in batches:
                if batch.num_rows:
                    total += moments(model, parent, *_batch_votes(batch, voters), any_label)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = [np.frombuffer(r["sums"]).reshape(2, -1) for r in patterns.mapInArrow(run, "sums binary").collect()]  # PARTS rows at most
        return np.sum(parts, axis=0) if parts else np.zeros((2, 3 + 2 * voters))

    def together(model: LabelModel | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, voters, voters), np.float32)
            for batch in batches:
                if batch.num_rows:
                    votes, labels, n = _batch_votes(batch, voters)
                    for t, p in zip(total, _classes(model, votes, labels, any_label), strict=True):
                        t += (votes * (p * n)[:, None].astype(np.float32)).T @ votes
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * voters), pa.int32()), pa.array([r.tobytes() for r in total.reshape(2 * voters, voters)], pa.binary())], names=["row", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for row, sums in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    held[row] = held.get(row, 0) + np.frombuffer(sums, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["row", "sums"])

        found = np.zeros((2 * voters, voters))
        for r in patterns.mapInArrow(run, "row int, sums binary").repartition("row").mapInArrow(add, "row int, sums binary").collect():  # one row a voter and class
            found[r["row"]] = np.frombuffer(r["sums"], np.float32)
        return found.reshape(2, voters, voters)

    return estimated(sums, together, voters)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """The classifier, from no row that is held out.

    Voters are induced and the classifier is trained on at most ``labelled``
    labelled rows (those of least hash); the label model is estimated over the
    votes of all documents.  Of labels for one doc_id the largest counts, of
    texts for one doc_id the sample takes the least.  Texts stay with the
    executors; the driver sees votes of the sample and sums.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & ~held_out(F.coalesce("doc_id", F.lit(0))))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = Stored(given.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "told").df
    sample = docs.join(F.broadcast(told), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # ``labelled`` rows are sent
    sample = Stored(sample, "sample").df
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    fixed = np.array([_hash_of(w) for w in LEXICON], np.uint64)
    model = Model(np.unique(np.concatenate([fixed, induced(sample, sizes.get(1, 0), sizes.get(0, 0))])), np.zeros(0), 0.0)
    voters = 2 * len(model.voters) + _PATTERNS
    votes = docs.join(F.broadcast(told), "doc_id", "left").select("text", "toxic").mapInArrow(_patterns(model), "votes binary, toxic int, n long")
    patterns = Stored(votes.groupBy("votes", "toxic").agg(F.sum("n").alias("n")), "patterns").df
    patterns = patterns.coalesce(min(PARTS, 1 + patterns.count() // PART_ROWS))
    model.labels = over_all(patterns, voters, bool(sizes))
    rows = sorted((r["doc_id"], r["toxic"], bytes(r["votes"]), r["size"], 1) for r in sample.mapInArrow(_sample_votes(model), "doc_id long, toxic int, votes binary, size long").toLocalIterator())
    if not rows:  # no label: learn from the lexicon's posteriors over the commonest votes
        rows = [(0, -1, bytes(r["votes"]), 500, r["n"]) for r in patterns.orderBy(F.desc("n"), "votes").limit(labelled).collect()]
    held = _unpacked([r[2] for r in rows], voters)
    q = model.labels.posterior(held, np.array([r[1] for r in rows], np.int64))
    model.weights, model.bias = logistic(features(held, np.concatenate([[0], np.cumsum([r[3] for r in rows])])), q, np.array([r[4] for r in rows], float))
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            parts = [model.scores(*text_bytes(column.slice(lo, hi - lo))) for lo, hi in text_slices(column, SLICE)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0; the
    score reads the whole text alone, of any length.  Null texts are empty, and
    an empty text has the score of a document on which nothing fires.  With no
    labelled row the fixed lexicon and the patterns vote alone.  Repeated rows
    give equal rows, and equal texts equal scores; a null doc_id counts as not
    held out and keeps a null held_out; an empty table gives an empty result;
    other columns are ignored.
    """
    model = model or fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def score(text):
        column = pa.array(text, pa.string(), from_pandas=True)
        parts = [model.scores(*text_bytes(column.slice(lo, hi - lo))) for lo, hi in text_slices(column, SLICE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(F.col("text").cast("string")) < 0.5)
