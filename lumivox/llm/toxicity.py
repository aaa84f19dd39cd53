"""Toxicity by weak supervision: many lexicon and pattern voters, a label model over their votes, a linear classifier on its posteriors.

Voters are lists of words given here, word stems that a bounded sample of labelled rows shows to come with toxic
texts, and patterns of a text's bytes; each votes or is silent. The label model has each row's true class hidden. It estimates by
expectation maximisation how often each voter speaks in either class (the label is one of them, so wrong labels are outvoted),
and from what correlation is left within the classes how much a vote adds to those of its like.
A logistic layer over densities of the same words and stems learns the posteriors and scores every text; as it is linear in
densities, a word costs one look-up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumivox.llm.common import discard, held_out, small_batches, written

CACHED_WORDS = 300_000
WORD = re.compile(r"\w+")
#: Words by voter. What they are worth is for the label model to say.
LEXICONS = {
    "insults": "idiot idiots moron morons stupid dumb fool loser losers clown imbecile",
    "contempt": "scum trash garbage filth vermin worthless useless pathetic disgusting",
    "threats": "kill die hurt destroy burn hang",
    "address": "you your yours u ur yourself",
    "german": "idiot dummkopf trottel arschloch depp abschaum",
    "french": "idiot imbécile crétin connard abruti ordure",
    "spanish": "idiota estúpido imbécil basura escoria tonto",
}
PATTERNS = ("shouting", "exclaiming", "symbols", "digits", "masked", "repeating")
UPPER, LETTER, DIGIT, SPACE = (np.array([chr(b) in s for b in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\x0b\x0c"))
SYMBOL = ~(LETTER | DIGIT | SPACE) & (np.arange(256) < 128)
MASKED = re.compile(r"[^\W\d_]+[\d_]+[^\W\d_]+")


@dataclass(frozen=True)
class Options:
    """max_rows bounds the labelled sample, those with the least hashed ids; most_terms and most_voters bound the stems found in it.

    A stem speaks in a text that has it twice, or once among fewer than short_text words. least_rows and least_gain (the G statistic): of the
    toxic rows in which a stem speaks, and of how it tells the labels apart. label_noise: of the labels, what is taken to be wrong.
    ridge: the classifier's penalty.
    """

    max_rows: int = 6000
    most_terms: int = 400
    most_voters: int = 80
    shortest: int = 3
    longest: int = 8
    least_rows: int = 3
    least_gain: float = 14.0
    short_text: int = 100
    scale: float = 40.0
    label_noise: float = 0.03
    ridge: float = 0.005
    rounds: int = 40


def terms_of(word: str, o: Options) -> list[str]:
    """The word, marked as whole, and its stems: what it begins with."""
    return [word + "$", *(word[:k] for k in range(o.shortest, min(o.longest, len(word)) + 1))]


def speaks(count: np.ndarray, n: int, o: Options) -> np.ndarray:
    return (count >= 2) | ((count >= 1) & (n < o.short_text))


class Words(dict):
    """Numbers words; of each the places of its terms among `terms`, and whether it has digits between letters. Emptied between texts when full."""

    def __init__(self, terms: list[str], o: Options, weight: np.ndarray | None = None):
        super().__init__()
        self.o, self.place, self.weight = o, {}, weight
        for k, names in enumerate([*LEXICONS.values(), *terms]):
            for name in [w + "$" for w in names.split()] if k < len(LEXICONS) else [names]:
                self.place.setdefault(name, []).append(k)
        self.size = len(LEXICONS) + len(terms)
        self.terms: list[list[int]] = []
        self.masked, self.sum = np.zeros(1024, bool), np.zeros(1024)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.sum):
            self.masked, self.sum = (np.concatenate([x, np.zeros_like(x)]) for x in (self.masked, self.sum))
        found = [k for t in terms_of(word, self.o) for k in self.place.get(t, ())]
        self.terms.append(found)
        self.masked[at] = MASKED.fullmatch(word) is not None
        self.sum[at] = sum(self.weight[k] for k in found) if self.weight is not None else 0.0
        self[word] = at
        return at

    def of(self, text: str | None) -> np.ndarray:
        """The text's words by number."""
        if len(self) >= CACHED_WORDS:
            self.clear(), self.terms.clear()
        return np.fromiter(map(self.__getitem__, WORD.findall((text or "").lower())), np.int64)

    def patterns(self, text: str, words: np.ndarray) -> np.ndarray:
        """Whether the text has each of PATTERNS; words: the same text's."""
        count, n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256), max(1, len(words))
        found = (
            count[UPPER].sum() > 0.5 * max(20, count[LETTER].sum()), count[ord("!")] > 0.1 * n and count[ord("!")] >= 3, count[SYMBOL].sum() > 0.2 * max(20, len(text)),
            count[DIGIT].sum() > 0.2 * max(20, len(text)), self.masked[words].sum() >= 2, n >= 20 and len(np.unique(words)) < 0.3 * n,
        )
        return np.array(found, bool)

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Of each lexicon and term, how many of the words it has."""
        number, times = np.unique(words, return_counts=True)
        total = np.zeros(self.size)
        for w, n in zip(number.tolist(), times.tolist()):
            for k in self.terms[w]:
                total[k] += n
        return total


def density(n: np.ndarray, o: Options) -> np.ndarray:
    """What one word of a text of n words counts."""
    return o.scale / np.maximum(n, o.short_text)


def find_terms(texts: DataFrame, o: Options) -> list[str]:
    """Stems and words that speak more often in rows labelled 1, best first; of nested ones that speak in about the same rows the best.

    texts: (label, text). Counted in tasks; those past the test, a bounded number, come to the driver.
    """

    def run(got: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in got:
            met: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for label, text in zip(b["label"], b["text"]):
                words = Counter(WORD.findall(text.lower()))
                n, terms = sum(words.values()), Counter()
                for w, c in words.items():
                    for t in terms_of(w, o):
                        terms[t] += c
                met[int(label)].update(t for t, c in terms.items() if c >= 2 or n < o.short_text)
            every = list(met[0].keys() | met[1].keys())
            yield pd.DataFrame({"term": every, "clean": [met[0][t] for t in every], "toxic": [met[1][t] for t in every]})

    n = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return []
    found = texts.select("label", "text").mapInPandas(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.where(F.col("toxic") >= o.least_rows).where(F.col("toxic") * (3.0 / toxic) > F.col("clean") * (9.0 / clean))
    part = lambda k, of: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) * (clean + toxic) / ((F.col("clean") + F.col("toxic")) * of))).otherwise(0.0)
    found = found.withColumn("g", 2 * (part("clean", clean) + part("toxic", toxic))).where(F.col("g") >= o.least_gain)
    kept: list[tuple[str, int]] = []
    for r in found.orderBy(F.desc("g"), F.length("term"), "term").limit(4 * o.most_terms).collect():
        bare = r.term.rstrip("$")
        if len(kept) < o.most_terms and not any((bare.startswith(k.rstrip("$")) or k.startswith(bare)) and 10 * abs(r.toxic - m) <= max(r.toxic, m) for k, m in kept):
            kept.append((r.term, r.toxic))
    return [t for t, _ in kept]


@dataclass
class LabelModel:
    """prior: of class 1; speaks: of each voter by class, how often it speaks; weight: what its vote counts beside those of its like; posterior: of each row."""

    prior: float
    speaks: np.ndarray
    weight: np.ndarray
    posterior: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """Of each voter, how likely class 1 is where it speaks."""
        one, zero = self.speaks[:, 1] * self.prior, self.speaks[:, 0] * (1 - self.prior)
        return one / (one + zero)


def label_model(votes: np.ndarray, start: np.ndarray, o: Options = Options()) -> LabelModel:
    """Expectation maximisation over rows of votes (1 speaks, 0 is silent), from first posteriors `start`; the last two voters are the labels,
    whose share of errors is given.

    Silence is no evidence; that all stems are silent is a voter of its own. After each round the correlations of the voters that neither class explains give the weights: voters that always speak together count as one.
    """
    rows, voters = votes.shape
    q, weight = start.astype(float), np.ones(voters)
    for _ in range(o.rounds):
        of = np.stack([1 - q, q], 1)
        size = of.sum(0)
        prior = (size[1] + 1) / (rows + 2)
        p = (votes.T @ of + 0.05) / (size + 0.1)
        p[-2:] = [[1 - o.label_noise, o.label_noise], [o.label_noise, 1 - o.label_noise]]
        left = votes - of @ p.T
        spread = np.sqrt((left**2).sum(0)) + 1e-9
        alike = np.clip((left.T @ left) / np.outer(spread, spread), 0, 1)
        weight = 1 / np.where(alike > 0.5, alike, 0).sum(0).clip(1)
        weight[-2:] = 1
        odds = votes @ (weight * np.log(p[:, 1] / p[:, 0])) + np.log(prior / (1 - prior))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return LabelModel(float(prior), p, weight, q)


def train(x: np.ndarray, target: np.ndarray, ridge: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic layer that fits the targets, by Newton steps; the bias carries no penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    share = (target.sum() + 1) / (len(target) + 2)
    w[-1] = np.log(share / (1 - share))
    for _ in range(rounds if len(target) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (target - p) - penalty * np.append(w[:-1], 0))
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """terms: stems found; weight: of lexicons and terms, in that order."""

    terms: list[str]
    weight: np.ndarray
    bias: float
    options: Options
    labels: LabelModel | None = field(default=None, repr=False)


def fit(docs: DataFrame, labels: DataFrame, o: Options = Options(), text: str = "text", label: str = "toxic", modulus: int = 3, held: int = 1) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) leaves another remainder than `held`, max_rows of them at most.

    Labels other than 0 and 1, null ids and null texts are left out; an id labelled more than once has its least label. Without
    labelled rows the score is 1/2, with rows of one class its share.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, held))
    ids = ids.groupBy(F.col("doc_id").alias("id")).agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(o.max_rows)
    texts = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == ids.id)  # max_rows at most
    texts = written(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxicity-sample")
    small_batches(docs.sparkSession)
    terms = find_terms(texts, o)

    def run(got: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(terms, o)
        for b in got:
            n, counts, patterns = [], [], []
            for t in b["text"]:
                words = known.of(t)
                n.append(len(words)), counts.append(known.counts(words).astype("<f4").tobytes()), patterns.append(known.patterns(t, words).astype("<f4").tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "n": n, "counts": counts, "patterns": patterns})

    rows = texts.mapInPandas(run, "doc_id long, label int, n long, counts binary, patterns binary").toArrow().sort_by("doc_id")  # a few kB a row
    discard(texts)
    label, n = rows["label"].to_numpy(), rows["n"].to_numpy()
    counts, patterns = (np.frombuffer(b"".join(rows[c].to_pylist()), "<f4").reshape(len(label), -1).astype(float) if len(label) else np.zeros((0, k)) for c, k in (("counts", len(LEXICONS) + len(terms)), ("patterns", len(PATTERNS))))
    voters = len(LEXICONS) + min(len(terms), o.most_voters)
    spoken = speaks(counts, n[:, None], o)
    quiet = ~spoken[:, len(LEXICONS) :].any(1, keepdims=True)
    votes = np.hstack([spoken[:, :voters], patterns > 0, quiet, label[:, None] == 0, label[:, None] == 1]).astype(float)
    found = label_model(votes, 0.05 + 0.9 * (label == 1), o) if len(label) else None
    weight, bias = train(counts * density(n, o)[:, None], found.posterior if found else np.zeros(0), o.ridge)
    return Model(terms, weight, bias, o, found)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds column `to`, the chance of label 1, to every row from its whole text; a null text counts as an empty one. One of that name before is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(to)
    at = rest.columns.index(text)
    names, schema = [*rest.columns, to], T.StructType([*rest.schema.fields, T.StructField(to, T.DoubleType())])

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = Words(m.terms, m.options, m.weight)
        for b in got:
            out = np.empty(b.num_rows)
            for k, t in enumerate(b.column(at).to_pylist()):
                words = known.of(t)
                out[k] = known.sum[words].sum() * density(len(words), m.options) + m.bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], names)

    return rest.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, o: Options = Options()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row of docs.

    Labels are read only to fit; scores depend on the text alone. Repeated rows stay, a null doc_id counts as an empty one for
    the fold and stays null, other columns are ignored.
    """
    model = fit(docs, labels, o)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
