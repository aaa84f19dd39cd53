"""Document quality by supervised subword embeddings.

Each word gives itself, the pair with the word before and its character
n-grams, hashed into one table of learned vectors; a document is the average over all its features, and a softmax
layer gives the chance of label 1. Trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows. As the layer is linear, a trained
model scores by one number for each feature, so a word costs one look-up, and its pair another.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumivox.llm.common import held_out, small_batches

CACHED_WORDS = 300_000


@dataclass(frozen=True)
class Options:
    """max_rows bounds the labelled sample: those with the least hashed ids. buckets bounds a row's features, whatever its length."""

    buckets: int = 1 << 16
    dim: int = 12
    shortest: int = 3
    longest: int = 4
    epochs: int = 8
    rate: float = 0.2
    max_rows: int = 4000
    seed: int = 7


def features(word: str, o: Options) -> list[int]:
    """Buckets of a word and of its character n-grams, ends marked."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(o.shortest, o.longest + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % o.buckets for g in (f" {word}", *grams)]


class Words(dict):
    """Numbers words; of each the buckets, their count and summed weight, and a hash for its word pairs.

    Emptied between texts once it holds CACHED_WORDS.
    """

    def __init__(self, o: Options, weight: list[float] | None = None):
        super().__init__()
        self.o, self.weight = o, weight
        self.buckets: list[np.ndarray] = []
        self.n, self.hash = np.zeros(1024, np.int64), np.zeros(1024, np.uint64)
        self.sum = np.zeros(1024)

    def __missing__(self, word: str) -> int:
        at, f = len(self), features(word, self.o)
        if at == len(self.n):
            self.n, self.hash, self.sum = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n, self.hash, self.sum))
        if self.weight is None:
            self.buckets.append(np.array(f, dtype=np.int32))
        else:
            self.sum[at] = sum(map(self.weight.__getitem__, f))
        self.n[at], self.hash[at] = len(f), zlib.crc32(word.encode())
        self[word] = at
        return at

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's words by number, and the buckets of its word pairs; a word with itself is one pair, whatever the word."""
        if len(self) >= CACHED_WORDS:
            self.clear(), self.buckets.clear()
        words = np.fromiter(map(self.__getitem__, (text or "").split()), dtype=np.int64)
        h = self.hash[words]
        pair = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) % np.uint64(self.o.buckets - 1) + np.uint64(1)
        return words, np.where(h[:-1] == h[1:], np.uint64(0), pair).astype(np.int64)


def counted(texts: DataFrame, o: Options) -> DataFrame:
    """label, buckets and counts of each (text, label) row, the latter two as the bytes of 32-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(o)
        for b in batches:
            ids, ns = [], []
            for t in b["text"]:
                words, pairs = known.of(t)
                number, times = np.unique(words, return_counts=True)
                of_words = np.concatenate([known.buckets[k] for k in number] or [np.zeros(0, np.int32)])
                total = np.bincount(of_words, np.repeat(times, known.n[number]), o.buckets).astype(np.int64) + np.bincount(pairs, minlength=o.buckets)
                at = np.flatnonzero(total)
                ids.append(at.astype("<i4").tobytes()), ns.append(total[at].astype("<i4").tobytes())
            yield pd.DataFrame({"label": b["label"], "ids": ids, "ns": ns})

    return texts.select("label", "text").mapInPandas(run, "label int, ids binary, ns binary")


@dataclass
class Model:
    """weight: of each bucket in the difference of the two classes' activations; bias: that of a text without features."""

    weight: np.ndarray
    bias: float
    options: Options


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], o: Options) -> Model:
    """Vectors, softmax layer and bias by gradient descent over (label, buckets, counts); without rows, a score of 1/2."""
    rng = np.random.default_rng(o.seed)
    vectors = rng.uniform(-1 / o.dim, 1 / o.dim, (o.buckets, o.dim))
    layer, bias = np.zeros((2, o.dim)), np.zeros(2)
    if rows:
        share = np.bincount([r[0] for r in rows], minlength=2) + 1.0
        bias = np.log(share / share.sum())
    steps, done = max(1, len(rows) * o.epochs), 0
    for _ in range(o.epochs):
        for k in rng.permutation(len(rows)):
            label, at, n = rows[k]
            done += 1
            if not len(at):
                continue
            rate = o.rate * (1 - done / (steps + 1))
            part = n / n.sum()
            hidden = part @ vectors[at]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, hidden)
            vectors[at] -= rate * np.outer(part * len(at), back)  # each feature gets the whole step, its repeats as many
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]), o)


def fit(docs: DataFrame, labels: DataFrame, o: Options = Options(), text: str = "text", label: str = "quality", modulus: int = 5, held: int = 0) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) leaves another remainder than `held`.

    Labels other than 0 and 1, null ids and null texts are left out. If an id
    is labelled more than once, its least label counts.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, held))
    ids = ids.groupBy(F.col("doc_id").alias("id")).agg(F.min(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(o.max_rows)
    texts = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text")).join(ids, F.col("doc_id") == ids.id)
    one = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = counted(one, o).toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("label", "ids", "ns"))))
    del found
    rows = [(label, np.frombuffer(ids, "<i4"), np.frombuffer(ns, "<i4")) for label, ids, ns in rows]
    return train(rows, o)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds column `to`, the chance of label 1, to every row from its whole text; null and empty texts get the prior's. One of that name before is replaced."""
    spark, o = docs.sparkSession, model.options
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weight.tolist(), model.bias))
    rest = docs.drop(to)
    at = rest.columns.index(text)
    names, schema = [*rest.columns, to], T.StructType([*rest.schema.fields, T.StructField(to, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        words, of_bucket = Words(o, weight), np.array(weight)
        for b in batches:
            out = np.empty(b.num_rows)
            for k, t in enumerate(b.column(at).to_pylist()):
                own, pairs = words.of(t)
                z = bias + (words.sum[own].sum() + of_bucket[pairs].sum()) / max(1, words.n[own].sum() + len(pairs))
                out[k] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names)

    return rest.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, o: Options = Options()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row of docs.

    Labels are read only to fit; scores depend on the text alone. Repeated rows
    stay, a null doc_id counts as an empty one for the fold, other columns are ignored.
    """
    model = fit(docs, labels, o)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
