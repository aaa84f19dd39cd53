"""Alignment of two tokenizers: which tokens of each cover the same bytes of a text.

Both tokenizers cut the same bytes, so the ends of their tokens are two rising
rows of offsets. A merge of the two rows finds where both have an end: there
one group of tokens ends and the next begins, and the two tokens that end there
are linked. Each batch of documents counts its linked pairs of ids; Spark
sums these over the corpus, takes each id's highest count, and joins both back
to the batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm import batches, bpe
from lumivox.llm.common import discard, small_batches, written

#: Fixed value: the mark for a space in pieces.
SPACE_MARK = "▁"
ALIGNED = "doc_id long, batch long, n_a long, n_b long, groups string, links binary, pair array<long>, n array<long>"


class Side:
    """A tokenizer's ids by their bytes: `lengths` of each, and `texts`, its number followed by a separator, by 3 * id + separator (0 comma, 1 bar, 2 semicolon)."""

    def __init__(self, of: dict[int, bytes]):
        size = max(of) + 1
        self.bytes = [of.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.texts = [f"{i}{mark}" for i in range(size) for mark in ",|;"]


class ByteLevel(Side):
    """A byte-level tokenizer file, special tokens left out; encodes a space and the text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, special = bpe._byte_chars(), {t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in special}
        self.path, ranks = path, {bytes(map(of.__getitem__, t)): i for t, i in vocab.items()}
        merged = [vocab[a + b] for a, b in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        super().__init__({i: t for t, i in ranks.items()})
        self.library = tiktoken.Encoding("aligned", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return list(map(self._encode, texts))

    def _encode(self, text: str) -> np.ndarray:
        try:
            return self.library.encode_to_numpy(" " + text).astype(np.int64)
        except ValueError:  # its pattern engine gives up on very long runs of white space
            return own_codec(self.path).encode(" " + text).astype(np.int64)


@lru_cache(maxsize=1)
def own_codec(path: str) -> bpe.Codec:
    codec = bpe.Codec(path)
    codec.splitter = None  # special tokens' strings are plain text
    return codec


class Pieces(Side):
    """A piece model; encodes the text, before which it puts a space itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        of = {}
        for i in range(self.library.vocab_size()):
            piece, byte = self.library.id_to_piece(i), re.fullmatch("<0x([0-9A-F]{2})>", self.library.id_to_piece(i))
            of[i] = bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()
        super().__init__(of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.library.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, made once in each Python worker."""
    return ByteLevel(path_a), Pieces(path_b)


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in either row of what stands in both; a stable sort of two rising rows, one after the other, is their merge."""
    both = np.concatenate([ends_a, ends_b])
    order = both.argsort(kind="stable")
    met = np.flatnonzero(both[order[:-1]] == both[order[1:]])
    return order[met], order[met + 1] - len(ends_a)


def group_text(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, side_a: Side, side_b: Side) -> str:
    """The groups as a1,a2|b1;a3|b2,b3: those of a end at the places at_a, those of b at at_b."""
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[at_a], mark_b[at_b] = 1, 2
    group_a = np.cumsum(mark_a == 1) - (mark_a == 1)  # groups that ended before
    group_b = np.cumsum(mark_b == 2) - (mark_b == 2)
    before_a, through_a = np.concatenate([[0], at_b + 1])[group_a], (at_a + 1)[group_b]  # tokens of the other side that come first
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + before_a] = 3 * a + mark_a
    code[np.arange(len(b)) + through_a] = 3 * b + mark_b + len(side_a.texts)
    known = side_a.texts, side_b.texts
    first = len(known[0])
    return "".join([known[0][c] if c < first else known[1][c - first] for c in code.tolist()])[:-1]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of each row of docs (doc_id, text) the tokens' numbers n_a and n_b, the groups as text, and the links by place in the batch's list of pairs.

    A batch's first row holds that list, `pair` (the id of A times 2^32, and that of B), and how often the batch links each, `n`. A text that is null
    or empty, or whose tokens don't give back its bytes, has no tokens: zeros, '' and no links. Null ids and repeated rows stay, other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (side_a, side_b), numbers = sides(path_a, path_b), batches.numbers()
        none = np.zeros(0, np.int64)
        for batch in got:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_a, n_b, groups, pairs = [], [], [], []
            for t, a, b in zip(texts, side_a.encode(texts), side_b.encode(texts)):
                raw = (" " + t).encode()
                whole = t and all(b"".join(map(s.bytes.__getitem__, x.tolist())) == raw for s, x in ((side_a, a), (side_b, b)))
                if not whole:
                    n_a.append(0), n_b.append(0), groups.append(""), pairs.append(none)
                    continue
                at_a, at_b = shared_ends(side_a.lengths[a].cumsum(), side_b.lengths[b].cumsum())
                n_a.append(len(a)), n_b.append(len(b))
                groups.append(group_text(a, b, at_a, at_b, side_a, side_b))
                pairs.append(a[at_a] << 32 | b[at_b])
            place, pair = pd.factorize(np.concatenate([none, *pairs]))
            ends = np.cumsum([len(p) for p in pairs])
            links = [p.astype(np.int32).tobytes() for p in np.split(place, ends[:-1])]
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([next(numbers)] * rows, pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.string()), pa.array(links[:rows], pa.binary()),
                 batches.first_row(pa.array(pair), rows), batches.first_row(pa.array(np.bincount(place, minlength=len(pair))), rows)],
                ["doc_id", "batch", "n_a", "n_b", "groups", "links", "pair", "n"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b and links of each pair of ids that is linked anywhere, and whether no other pair of its a (best_a), of its b (best_b) has more."""
    counts = written(batches.asked(aligned, "pair", "n").groupBy("pair").agg(F.sum("n").alias("links")), "align-pairs")
    split = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "links")
    most_a, most_b = (split.groupBy(side).agg(F.max("links").alias(f"most_{side}")) for side in "ab")  # a row for each id of a vocabulary at most
    out = split.join(F.broadcast(most_a), "a").join(F.broadcast(most_b), "b")
    out = out.select("pair", "a", "b", "links", *((F.col("links") == F.col(f"most_{s}")).alias(f"best_{s}") for s in "ab"))
    out.scratch_path = counts.scratch_path
    return out


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """To each row of `aligned` its n_links, the sum of their pairs' counts over the corpus, and how many of them are the best of their b and of their a."""
    keep = [c for c in aligned.columns if c not in ("links", "pair", "n", "batch")]
    answers = batches.asked(aligned, "pair", "n").join(counts.select("pair", F.col("links").alias("count"), "best_a", "best_b"), "pair").select("batch", "at", "count", "best_a", "best_b")

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        at = answers["at"].to_numpy()
        found = {}
        for name in ("count", "best_a", "best_b"):
            found[name] = np.zeros(len(at), np.int64)
            found[name][at] = answers[name].to_numpy(zero_copy_only=False)
        links = [np.frombuffer(x, np.int32) for x in rows["links"].to_pylist()]
        out = rows.select(keep).append_column("n_links", pa.array([len(x) for x in links], pa.int64()))
        for to, name in (("count_sum", "count"), ("n_best", "best_b"), ("n_best_a", "best_a")):
            out = out.append_column(to, pa.array([int(found[name][x].sum()) for x in links], pa.int64()))
        return out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*keep).schema] + ["n_links long, count_sum long, n_best long, n_best_a long"])
    return batches.answered(aligned.drop("pair", "n"), answers, run, schema)


def summary(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs; its alignment is kept as a table while pairs are counted."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = written(align(docs, path_a, path_b).withColumn("groups_sha256", digest).drop("groups"), "align-rows")
    counts = pair_counts(aligned)
    out = written(with_counts(aligned, counts), "align-counted")
    discard(aligned, counts)
    # tokens have bytes, so that a group holds one link: the two tokens that end it
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
