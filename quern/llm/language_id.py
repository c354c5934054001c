"""Language identification by a byte convolutional network in numpy.

Texts are read whole, as UTF-8 bytes in windows of fixed length.  Each byte is
embedded; filters of several widths slide over a window and keep their maximum;
a softmax over the pooled values gives the language.  Training runs on the
driver over a bounded sample of labelled windows.  For scoring, embedding and
filters collapse into tables by pairs of bytes, so that a window costs look-ups
and additions only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, held_out, text_bytes, text_slices

#: Bytes of a window, of which the last WIDTHS[-1] - 1 are also the first of the next.
WINDOW, WIDTHS = 256, (2, 3, 4)
STEP = WINDOW - WIDTHS[-1] + 1
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteNet:
    """Embedding (256, d), filters by width (w * d, f), output weights and the languages."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def new(languages: list[str], size: int = 8, filters: int = 12, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        total = filters * len(WIDTHS)
        return ByteNet(
            languages,
            rng.normal(0, 0.5, (256, size)).astype(np.float32),
            [rng.normal(0, (w * size) ** -0.5, (w * size, filters)).astype(np.float32) for w in WIDTHS],
            np.zeros(total, np.float32),
            rng.normal(0, total**-0.5, (total, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of a batch of windows (b, WINDOW)."""
        b, size = len(x), self.embedding.shape[1]
        seen = self.embedding[x]
        pooled, places = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            rows = np.concatenate([seen[:, j : STEP + j] for j in range(w)], axis=2)
            z = rows.reshape(b * STEP, w * size) @ f
            z = z.reshape(b, STEP, -1)
            places.append(z.argmax(axis=1))
            pooled.append(np.take_along_axis(z, places[-1][:, None], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[np.arange(b), y] + 1e-9).mean())
        p[np.arange(b), y] -= 1
        p /= b
        d_hidden = (p @ self.out.T) * (raw > 0)
        d_embedding, d_filters, at = np.zeros_like(self.embedding), [], 0
        for w, f, place in zip(WIDTHS, self.filters, places, strict=True):
            n = f.shape[1]
            d = d_hidden[:, at : at + n]
            at += n
            bytes_at = x[np.arange(b)[:, None, None], place[:, :, None] + np.arange(w)]  # only the maximum passes a gradient
            d_filters.append(np.einsum("bn,bnk->kn", d, self.embedding[bytes_at].reshape(b, n, w * size)).astype(np.float32))
            np.add.at(d_embedding, bytes_at, (d[:, :, None] * f.T[None]).reshape(b, n, w, size))
        return loss, [d_embedding, *d_filters, d_hidden.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam over shuffled batches."""
        rng, t = np.random.default_rng(seed), 0
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                pick, t = order[lo : lo + batch], t + 1
                _, grads = self.step(x[pick], y[pick])
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By pair of bytes: all filters' first two positions; the third byte; positions three and four."""
        size = self.embedding.shape[1]
        part = [[self.embedding @ f[j * size : (j + 1) * size] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        pair = np.concatenate([(p[0][:, None] + p[1][None]).reshape(1 << 16, -1) for p in part], axis=1)
        return pair, part[1][2], (part[2][2][:, None] + part[2][3][None]).reshape(1 << 16, -1)

    def scorer(self):
        """A function from windows (b, WINDOW) to probabilities (b, languages)."""
        pair, third, last = self.tables()
        n = third.shape[1]

        def score(x: np.ndarray) -> np.ndarray:
            pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
            z = pair[pairs[:, :STEP]]
            z[:, :, n : 2 * n] += third[x[:, 2 : 2 + STEP]]
            z[:, :, 2 * n :] += last[pairs[:, 2 : 2 + STEP]]
            logits = np.maximum(z.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)

        return score


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, zero-padded, and how many each text has (at least one)."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - (WINDOW - STEP)) // STEP))
    first = np.repeat(offsets[:-1], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    ends = np.repeat(offsets[1:], counts)
    at = first[:, None] + np.arange(WINDOW)
    padded = np.concatenate([raw, np.zeros(1, np.uint8)])
    return np.where(at < ends[:, None], padded[np.minimum(at, len(raw))], 0).astype(np.uint8), counts


def _predict(net: ByteNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer()
        for batch in batches:
            column, names, best = batch.column("text"), [], []
            for lo, hi in text_slices(column, 1 << 18):
                part = column.slice(lo, hi - lo)
                x, counts = windows(*text_bytes(part))
                p = np.concatenate([score(x[i : i + 32]) for i in range(0, len(x), 32)])
                mean = np.add.reduceat(p, np.cumsum(counts) - counts) / counts[:, None]
                for text, row in zip(part.to_pylist(), mean, strict=True):
                    if text is None or not _LETTER.search(text):
                        names.append("und")
                        best.append(0.0)
                    else:
                        names.append(net.languages[int(row.argmax())])
                        best.append(float(row.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, per_language: int = 600, parts: int = 3) -> ByteNet | None:
    """A network from at most ``per_language`` labelled, not held-out documents of each language.

    The sample is the rows of least hash; each gives ``parts`` windows from
    places set by that hash.  None if there is no labelled row.
    """
    mix = F.xxhash64("doc_id")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), "text", mix.alias("mix"))
    # Of each language only the rows below a hash that leaves about four times as many as are wanted reach its window.
    sizes = Stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages").df
    unit = (F.col("mix") / 2.0**64) + 0.5
    few = labelled.join(sizes, "lang").where(unit * F.col("size") <= 4 * per_language)
    places = [F.substring(F.col("text"), (F.pmod(F.shiftright("mix", 7 * i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)) for i in range(parts)]
    few = few.select("doc_id", "lang", "mix", F.array(*places).alias("cuts"))
    order = Window.partitionBy("lang").orderBy("mix", "doc_id", "cuts")
    rows = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "lang", "cuts").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["cuts"]))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    cuts = [(c.encode()[:WINDOW], languages.index(r["lang"])) for r in rows for c in r["cuts"] if _LETTER.search(c)]
    if not cuts:
        return None
    x = np.array([np.frombuffer(c.ljust(WINDOW, b"\0"), np.uint8) for c, _ in cuts])
    net = ByteNet.new(languages)
    net.train(x, np.array([y for _, y in cuts]))
    return net


def identify(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, and lang to learn from): doc_id, held_out, lang_pred, score.

    ``lang`` is read only where crc32(doc_id) mod 5 is not 0, to train; source
    and doc_id are never inputs.  Texts that are null or without letters are
    'und' with score 0, and so is every text if nothing could be learned.  The
    score is the mean probability over all windows of the text, however many; of
    equally likely languages the first by name is given.  Repeated rows give
    equal rows; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col("lang")] if "lang" in docs.columns else []))
    if net is None and "lang" in docs.columns:
        net = fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")
