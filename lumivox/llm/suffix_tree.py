"""Text scores from a probabilistic suffix tree over words.

A context of up to `depth` words is tried if it comes `least` times in the training rows, whatever their number, so the tree grows
with the corpus. It is looked for only where its parts are frequent, level by level. It stays if its next-symbol
distribution diverges from its suffix's, tested over classes of symbols, and so do the suffixes of what stays.

Texts are tokenized once, into batches of places in a dictionary. Each batch asks once for its words' numbers, small ones for frequent
words, and how often training rows hold them; all else reads those batches. What follows the contexts that stay is one table of
blocks, sorted by context and symbol. Each batch asks each block once for what it has there and is scored from the answers. A symbol's
chance is that of the longest suffix in the tree, discounted and interpolated with the next shorter one down to the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.batches import numbers as batch_numbers
from lumivox.llm.common import conf, discard, held_out, small_batches, written

BUFFER = 1 << 20
BLOCK = "part int, keys binary, counts binary"
BATCH = "batch long, size long, ids binary, flags binary, lengths binary, ranks binary, words binary, seen binary"
PAIRS = "contexts binary, runs binary, symbols binary"


@dataclass(frozen=True)
class Options:
    """least: see above; classes: of symbols, by hash, in the divergence test; gain: nats a symbol beyond the test's own noise; discount: of
    each count in a context; batch_tokens: texts of so many are coded and scored together; filter_bits: the most that a filter of contexts takes, beyond which it passes more of what isn't one.
    """

    depth: int = 3
    least: int = 50
    classes: int = 64
    gain: float = 0.01
    discount: float = 0.75
    batch_tokens: int = 1 << 20
    filter_bits: int = 1 << 27


END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space
#: Under what a context's own numbers are kept, in the place of a next symbol: how many come after it, and how many kinds. Words have numbers from FIRST on, 0 where training rows don't hold them.
TOTAL, KINDS, FIRST = 0, 1, 2
#: Bits of a symbol's number beside a context's place, and how often a context may come before its pairs are dealt into shares by symbol.
SYMBOL_BITS, SHARE = 40, 1 << 18


class Dictionary(dict):
    """Gives each word that it is asked for a place."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def tokenize(texts: list[str | None], words: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens, and each text's number of tokens: its words and one end."""
    out, n, end = [], [], words[b"\n"]
    for t in texts:
        w = (t or "").encode().lower().split()  # on bytes both act on ASCII alone
        a = np.empty(len(w) + 1, dtype=np.int32)
        a[:-1] = np.fromiter(map(words.__getitem__, w), dtype=np.int32, count=len(w))
        a[-1] = end
        out.append(a), n.append(len(a))
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.array(n, dtype=np.int64)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and each one's place among them."""
    code, distinct = pd.factorize(values)
    order = np.argsort(distinct)
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    return distinct[order], place[code]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def contexts(tokens: np.ndarray, n: np.ndarray, counts: np.ndarray, least: int, passes: list[Callable | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For depth 1, 2, ...: places that have so many frequent words of the same text before them, the hash of those, and the least of their counts, where that and its suffixes' pass."""
    at, h, times = np.arange(len(tokens)), np.zeros(len(tokens), np.uint64), np.full(len(tokens), np.iinfo(np.int64).max)
    before = at - np.repeat(np.cumsum(n) - n, n)
    for d, may in enumerate(passes, 1):
        some = np.flatnonzero(before[at] >= d)
        some = some[counts[at[some] - d] >= least]
        at = at[some]
        h, times = mix(h[some], tokens[at - d]), np.minimum(times[some], counts[at - d])
        if may is not None:
            some = may(h)
            at, h, times = at[some], h[some], times[some]
        yield at, h, times


# whole numbers as bytes: first all lowest ones, then all second ones, up to the last that isn't 0 everywhere, compressed; sorted keys by differences


def packed(values: np.ndarray) -> bytes:
    values = values.astype("<u8")
    k = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :k].T)
    return bytes([k]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    k, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :k] = np.frombuffer(pa.decompress(memoryview(raw)[9:], k * n, "zstd"), np.uint8).reshape(k, n).T
    return out.view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def parts_of(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Parts by the keys' highest bits, and where in the sorted keys those of each stand."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    number, first = np.unique(part, return_index=True)
    for p, a, b in zip(number.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield p, slice(a, b)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def found(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The count of each wanted key among the sorted ones, 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted), counts.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


@dataclass
class Batch:
    """Texts' ids and flags (LEARNED, UNNAMED), lengths, tokens as places among the words; these words' hashes, where training rows hold them `least` times, else 0, classes, numbers, and counts in training rows."""

    ids: np.ndarray
    flags: np.ndarray
    lengths: np.ndarray
    places: np.ndarray
    words: np.ndarray
    classes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray

    def learned(self) -> Batch:
        """Of training rows alone."""
        own = (self.flags & LEARNED) > 0
        return self if own.all() else Batch(self.ids[own], self.flags[own], self.lengths[own], self.places[np.repeat(own, self.lengths)], self.words, self.classes, self.symbols, self.counts)

    def contexts(self, least: int, passes: list[Callable | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return contexts(self.words[self.places], self.lengths, self.counts[self.places], least, passes)


LEARNED, UNNAMED = 1, 2


def places_of(row) -> np.ndarray:
    """Tokens' places among the words, from their ranks by how often the batch has them."""
    return np.argsort(-unpacked(row.seen).astype(np.int64), kind="stable")[unpacked(row.ranks).astype(np.int64)]


def opened(batches: Iterator[pd.DataFrame], least: int, learned: bool = False) -> Iterator[Batch]:
    for b in batches:
        for r in b.itertuples():
            small = [unpacked(x).astype(np.int64) for x in (r.ids, r.flags, r.lengths)]
            classes, symbols, counts = (unpacked(x).astype(np.int64) for x in (r.classes, r.symbols, r.counts))
            words = np.zeros(len(counts), np.uint64)
            words[counts >= least] = unpacked_keys(r.words)
            whole = Batch(*small, places_of(r), words, classes, symbols, counts)
            yield whole.learned() if learned else whole


def batches_of(docs: DataFrame, learned, o: Options) -> DataFrame:
    """The texts of docs (doc_id, text) in batches of tokens; learned: a column, whether a row is for training."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size, words = batch_numbers(), [], 0, Dictionary()

        def flush() -> pd.DataFrame:
            ids, flags, t, n = (np.concatenate(x) for x in zip(*held))
            keys = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
            order = np.argsort(keys)
            seen = np.bincount(t, minlength=len(words))[order]
            rank = np.empty(len(words), np.int64)
            rank[order[np.argsort(-seen, kind="stable")]] = np.arange(len(words))
            row = (next(number), len(t), packed(ids), packed(flags), packed(n), packed(rank[t]), packed_keys(keys[order]), packed(seen))
            return pd.DataFrame([row], columns=["batch", "size", "ids", "flags", "lengths", "ranks", "words", "seen"])

        for b in batches:
            if len(b):
                held.append((b["doc_id"].to_numpy(np.int64), b["flags"].to_numpy(np.int64), *tokenize(b["text"].tolist(), words)))
                size += len(held[-1][2])
            if size >= o.batch_tokens:
                yield flush()
                held, size, words = [], 0, Dictionary()
        if held:
            yield flush()

    own = F.col("doc_id").cast("long")
    flags = F.when(learned, LEARNED).otherwise(0) + F.when(own.isNull(), UNNAMED).otherwise(0)
    rows = docs.select(F.coalesce(own, F.lit(0)).cast("long").alias("doc_id"), flags.cast("int").alias("flags"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInPandas(run, BATCH), "suffix-tree-batches")


def bits_of(batches: DataFrame) -> int:
    """Two million tokens to a part at most, of 2^bits."""
    size = batches.agg(F.sum("size")).first()[0] or 0
    return max(int(conf(batches.sparkSession, "spark.sql.shuffle.partitions") or 1) - 1, size >> 21).bit_length()


def questions(batches: DataFrame, bits: int) -> DataFrame:
    """part, batch, keys, times: each batch's words by part, and how often its training rows hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                words, own = unpacked_keys(r.words), np.repeat((unpacked(r.flags) & np.uint64(LEARNED)) > 0, unpacked(r.lengths).astype(np.int64))
                times = np.bincount(places_of(r)[own], minlength=len(words))
                rows = [(p, r.batch, packed_keys(words[s]), packed(times[s])) for p, s in parts_of(words, bits)]
                yield pd.DataFrame(rows, columns=["part", "batch", "keys", "times"])

    return batches.select("batch", "flags", "lengths", "ranks", "words", "seen").mapInPandas(run, "part int, batch long, keys binary, times binary")


def roots_of(asked: DataFrame) -> DataFrame:
    """Blocks (part, keys, counts) of the training rows' symbols."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = summed(np.concatenate([unpacked_keys(k) for k in rows["keys"]]), np.concatenate([unpacked(c) for c in rows["times"]]))
        keys, n = keys[n > 0], n[n > 0]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "keys": [packed_keys(keys)], "counts": [packed(n)]})

    return asked.groupBy("part").applyInPandas(merged, BLOCK)


def coded(batches: DataFrame, asked: DataFrame, roots: DataFrame, bits: int, o: Options) -> DataFrame:
    """The batches with `classes`, `symbols` and `counts` of their words, and hashes of the frequent ones alone. A word's number is its rank in its part, so frequent ones have few digits, and the part."""

    def answered(asked: pd.DataFrame, root: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"batch": [], "part": [], "symbols": [], "counts": []})
        keys, n = (unpacked_keys(root["keys"].iloc[0]), unpacked(root["counts"].iloc[0]).astype(np.int64)) if len(root) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        symbols = np.empty(len(keys), np.int64)
        symbols[np.argsort(-n, kind="stable")] = FIRST + int(asked["part"].iloc[0]) + (np.arange(len(keys)) << bits)
        wanted = [unpacked_keys(k) for k in asked["keys"]]
        return pd.DataFrame({"batch": asked["batch"], "part": asked["part"], "symbols": [packed(found(keys, symbols, w)) for w in wanted], "counts": [packed(found(keys, n, w)) for w in wanted]})

    def joined(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("part")  # the order of the words' hashes
        symbols, counts = (np.concatenate([unpacked(x) for x in answers[c]]) for c in ("symbols", "counts"))
        words = unpacked_keys(rows["words"].iloc[0])
        often = packed_keys(words[counts >= o.least])
        return rows.assign(words=[often], classes=[packed(words % np.uint64(o.classes))], symbols=[packed(symbols)], counts=[packed(counts)])

    answers = asked.groupBy("part").cogroup(roots.withColumnRenamed("part", "of").groupBy("of")).applyInPandas(answered, "batch long, part int, symbols binary, counts binary")
    return written(batches.groupBy("batch").cogroup(answers.withColumnRenamed("batch", "to").groupBy("to")).applyInPandas(joined, BATCH + ", classes binary, symbols binary, counts binary"), "suffix-tree-coded")


def counted(texts: DataFrame, keys_of: Callable[[Batch], np.ndarray], bits: int, least: int) -> DataFrame:
    """Blocks (part, keys, counts) of the keys that keys_of gives for training rows, with how often it does, where that is `least` times or more.

    Counts are summed in tasks before the shuffle; a part, one of 2^bits, is what a task then holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0

        def flush() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            rows = [(p, packed_keys(keys[s]), packed(n[s])) for p, s in parts_of(keys, bits)]
            return pd.DataFrame(rows, columns=["part", "keys", "counts"])

        for b in opened(batches, least, learned=True):
            held.append(keys_of(b))
            n_held += len(held[-1])
            if n_held >= BUFFER:
                yield flush()
                held, n_held = [], 0
        if n_held:
            yield flush()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = summed(np.concatenate([unpacked_keys(k) for k in rows["keys"]]), np.concatenate([unpacked(c) for c in rows["counts"]]))
        keys, n = keys[n >= least], n[n >= least]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "keys": [packed_keys(keys)], "counts": [packed(n)]})

    return texts.mapInPandas(run, BLOCK).groupBy("part").applyInPandas(merged, BLOCK)


class Filter:
    """Which keys may be among some; those are for sure. Its bits are bounded, and so is what the driver and each task hold."""

    def __init__(self, pages: dict[int, bytes], bits: int):
        self.bits, self.map = bits, np.zeros(bits >> 3, np.uint8)
        for p, raw in pages.items():
            self.map[p << 12 : (p << 12) + len(raw)] = np.frombuffer(raw, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(bits - 1)
        return (keys & mask).astype(np.int64), (mix(keys, keys) & mask).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys, self.bits)
        out = (self.map[a >> 3] >> (a & 7).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(out)
        out[at] = (self.map[b[at] >> 3] >> (b[at] & 7).astype(np.uint8) & 1).astype(bool)
        return out


def filter_of(keys: DataFrame, n: int, o: Options) -> Filter:
    """keys: rows of `keys`, packed in any order but by differences, or of `context`, one a row."""
    bits = max(1 << 16, min(o.filter_bits, 1 << (16 * max(n, 1)).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            for some in [b["context"].to_numpy(np.int64).view(np.uint64)] if "context" in b else map(unpacked_keys, b["keys"]):
                for at in Filter.places(some, bits):
                    np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        pages = own.reshape(-1, min(4096, len(own)))
        some = np.flatnonzero(pages.any(axis=1))
        yield pd.DataFrame({"page": some, "map": [pages[p].tobytes() for p in some]})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page": rows["page"].iloc[:1], "map": [np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in rows["map"]]).tobytes()]})

    pages = keys.mapInPandas(run, "page long, map binary").groupBy("page").applyInPandas(merged, "page long, map binary")
    return Filter({r.page: r.map for r in pages.toLocalIterator()}, bits)


def numbers(blocks: DataFrame) -> tuple[int, int, int]:
    """Sum of the counts, keys, and keys with a count of 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["counts"]:
                c = unpacked(raw)
                yield pd.DataFrame({"s": [int(c.sum())], "k": [len(c)], "one": [int((c == 1).sum())]})

    r = blocks.mapInPandas(run, "s long, k long, one long").agg(F.sum("s"), F.sum("k"), F.sum("one")).first()
    return tuple(int(x or 0) for x in r)


def context_classes(train: DataFrame, may: Filter, bits: int, o: Options) -> DataFrame:
    """context, suffix, n and classes: how often symbols of each class follow each context that comes `least` times, frequent words and longer ones among those that `may` passes."""
    schema = "part int, context binary, suffix binary, code binary, times binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            h, suffix, cls = (np.concatenate(x) for x in zip(*held))
            keys, at = ranked(h)
            of = np.empty(len(keys), np.uint64)
            of[at] = suffix
            code, n = np.unique(at * o.classes + cls, return_counts=True)  # a context's place and the class
            rows = []
            for p, s in parts_of(keys, bits):
                own = slice(*np.searchsorted(code, [s.start * o.classes, s.stop * o.classes]))
                rows.append((p, packed_keys(keys[s]), packed(of[s]), packed(np.diff(code[own], prepend=s.start * o.classes)), packed(n[own])))
            return pd.DataFrame(rows, columns=["part", "context", "suffix", "code", "times"])

        for b in opened(batches, o.least, learned=True):
            cls, before = b.classes[b.places], np.zeros(len(b.places), np.uint64)
            for at, h, _ in b.contexts(o.least, [None] + [may] * (o.depth - 1)):
                held.append((h, before[at], cls[at]))
                before[at] = h
            if sum(len(x[0]) for x in held) >= BUFFER // 2:
                yield flush()
                held = []
        if held:
            yield flush()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        own = [unpacked_keys(x) for x in rows["context"]]
        h, suffix = np.concatenate(own), np.concatenate([unpacked(x) for x in rows["suffix"]])
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        n = np.zeros((len(keys), o.classes), np.int64)
        start = 0
        for size, code, times in zip(map(len, own), rows["code"], rows["times"]):
            place, cls = np.divmod(np.cumsum(unpacked(code).astype(np.int64)), o.classes)
            n[at[start + place], cls] += unpacked(times).astype(np.int64)  # a row of the input has a context and class once
            start += size
        often = n.sum(1) >= o.least
        return pd.DataFrame({"context": keys[often].view(np.int64), "suffix": suffix[first][often].view(np.int64), "n": n[often].sum(1), "classes": list(n[often])})

    return train.mapInPandas(run, schema).groupBy("part").applyInPandas(merged, "context long, suffix long, n long, classes array<long>")


def divergent(of: DataFrame, root: np.ndarray, o: Options) -> DataFrame:
    """context and n of those whose next-symbol classes differ from their suffix's, a likelihood-ratio test with four deviations and the gain beyond it, and of their suffixes.

    of: context_classes(); root: the same of the empty context, 0. All that follows a context follows its suffix, which so is in the table as well.
    """
    empty = F.array(*[F.lit(int(x)) for x in root])
    parent = of.select(F.col("context").alias("p"), F.col("classes").alias("parent"))
    each = of.join(parent, of.suffix == parent.p, "left").withColumn("parent", F.when(F.col("suffix") == 0, empty).otherwise(F.col("parent"))).where("parent is not null")

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c, p, n = np.stack(b["classes"]).astype(float), np.stack(b["parent"]).astype(float), b["n"].to_numpy(float)
                q = (p + 0.5) / (p.sum(1) + 0.5 * o.classes)[:, None]
                g = np.where(c > 0, c * np.log(np.where(c > 0, c, 1) / n[:, None] / q), 0).sum(1)
                df = np.maximum((p > 0).sum(1) - 1, 1)
                yield b.loc[2 * g >= df + 4 * np.sqrt(2 * df) + 2 * o.gain * n, ["context"]]

    kept = [written(each.select("context", "n", "classes", "parent").mapInPandas(tested, "context long"), "suffix-tree-divergent")]
    for _ in range(o.depth - 1):
        kept.append(kept[-1].join(of, "context").where("suffix <> 0").select(F.col("suffix").alias("context")).distinct())
    every = kept[0]
    for k in kept[1:]:
        every = every.union(k)
    return every.distinct().join(of.select("context", "n"), "context")


# pairs of a context and a symbol, each as one number: the context's place among sorted ones, and the symbol


def pairs(h: np.ndarray, symbols: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct contexts, into how many shares the pairs of each are dealt, and a number for each pair; times: how often the context comes, at most."""
    distinct, at = ranked(h)
    shares = np.ones(len(distinct), np.int64)
    shares[at] = 1 + times // SHARE
    return distinct, shares, at << SYMBOL_BITS | symbols


def pair_parts(distinct: np.ndarray, shares: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each pair, by context and the share of its symbols, so that no part has all of a frequent one's; its own numbers are in the first. Then how to sort by part, pairs in their order."""
    context, symbol = code >> SYMBOL_BITS, code & ((1 << SYMBOL_BITS) - 1)
    key = mix(distinct[context], np.where(symbol < FIRST, 0, symbol % shares[context]).astype(np.uint64))
    part = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)
    return part, np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")


def packed_pairs(distinct: np.ndarray, code: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted distinct pairs: their contexts, how many pairs each has, and the symbols by differences in a context."""
    context, symbol = code >> SYMBOL_BITS, code & ((1 << SYMBOL_BITS) - 1)
    first = np.flatnonzero(np.diff(context, prepend=-1))
    step = np.diff(symbol, prepend=0)
    step[first] = symbol[first]
    return packed_keys(distinct[context[first]]), packed(np.diff(first, append=len(code))), packed(step)


def unpacked_pairs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, numbers of their pairs, and symbols, of all rows."""
    out = []
    for r in rows.itertuples():
        runs, step = unpacked(r.runs).astype(np.int64), unpacked(r.symbols).astype(np.int64)
        first, symbol = np.cumsum(runs) - runs, np.cumsum(step)
        out.append((unpacked_keys(r.contexts), runs, symbol - np.repeat(symbol[first] - step[first], runs)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def pair_blocks(distinct: np.ndarray, shares: np.ndarray, code: np.ndarray, n: np.ndarray, bits: int) -> pd.DataFrame:
    """Sorted distinct pairs with their counts, as rows by part."""
    part, order = pair_parts(distinct, shares, code, bits)
    rows = []
    for p, at in zip(*_groups(part, order)):
        rows.append((p, *packed_pairs(distinct, code[at]), packed(n[at])))
    return pd.DataFrame(rows, columns=["part", "contexts", "runs", "symbols", "counts"])


def _groups(part: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    number, first = np.unique(part[order], return_index=True)
    return number.tolist(), np.split(order, first[1:])


@dataclass
class Tree:
    """contexts: (context, n); may: passes those at least; roots: blocks of the symbols' counts; model: blocks of what follows contexts, and of contexts' own numbers; 2^bits parts of each."""

    tokens: int
    symbols: int
    singles: int
    contexts: DataFrame
    may: Filter
    roots: DataFrame
    model: DataFrame
    bits: int

    @property
    def keys(self) -> np.ndarray:
        """The contexts' hashes, sorted: for a look at small trees."""
        return np.sort(np.array([r.context for r in self.contexts.select("context").collect()], np.int64).view(np.uint64))


def learn(train: DataFrame, o: Options = Options()) -> Tree:
    """The tree of the texts in `train`. Only sums and bounded filters come to the driver."""
    return _learned(batches_of(train, F.lit(True), o), o)[0]


def _learned(batches: DataFrame, o: Options) -> tuple[Tree, DataFrame]:
    """The tree of the training rows in batches_of(), and all of these coded by it."""
    bits = bits_of(batches)
    asked = questions(batches, bits)
    roots = written(roots_of(asked), "suffix-tree-symbols")
    tokens, symbols, singles = numbers(roots)
    texts = coded(batches, asked, roots, bits, o)
    discard(batches)

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, c in zip(b["keys"], b["counts"]):
                n = np.bincount((unpacked_keys(k) % np.uint64(o.classes)).astype(np.int64), unpacked(c).astype(float), o.classes)
                yield pd.DataFrame({"k": np.arange(o.classes), "n": n.astype(np.int64)})

    root = np.zeros(o.classes, np.int64)
    for r in roots.mapInPandas(classes, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        root[r.k] = r.n
    levels, last, total = [], None, 0
    for depth in range(2, o.depth + 1):

        def longer(b: Batch, depth: int = depth, last: Filter | None = last) -> np.ndarray:
            """Contexts of the depth whose suffix and whose first words may be frequent."""
            *_, (at, _, _), (at_d, h_d, _) = b.contexts(o.least, [None] * (depth - 2) + [last, None])
            fine = np.zeros(len(b.places), bool)
            fine[at] = True
            return h_d[fine[at_d - 1]]

        level = written(counted(texts, longer, bits, o.least), "suffix-tree-contexts")
        own = numbers(level)[1]
        levels.append(level)
        last, total = filter_of(level.select("keys"), own, o), total + own
    if len(levels) > 1:
        every = levels[0].select("keys")
        for level in levels[1:]:
            every = every.union(level.select("keys"))
        last = filter_of(every, total, o)
    of = written(context_classes(texts, last, bits, o), "suffix-tree-classes")
    kept = written(divergent(of, root, o), "suffix-tree-kept")
    discard(of, *levels)

    may = filter_of(kept.select("context"), kept.count(), o)  # from rows: a second Python stage in the same task would be a second worker
    after = written(following(texts, may, bits, o), "suffix-tree-following")
    kinds = after.select(F.explode(F.arrays_zip("distinct", "kinds")).alias("x")).groupBy(F.col("x.distinct").alias("context")).agg(F.sum("x.kinds").alias("kinds"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, n = b["context"].to_numpy(np.int64).view(np.uint64), b[["n", "kinds"]].to_numpy(np.int64)
            distinct, shares, code = pairs(np.repeat(h, 2), np.tile([TOTAL, KINDS], len(h)), np.zeros(2 * len(h), np.int64))
            order = np.argsort(code)
            yield pair_blocks(distinct, shares, code[order], n.ravel()[order], bits)

    block = f"part int, {PAIRS}, counts binary"
    numbered = written(kept.join(kinds, "context").mapInPandas(own, block), "suffix-tree-numbers")
    return Tree(tokens, symbols, singles, kept, may, roots, after.select("part", "contexts", "runs", "symbols", "counts").union(numbered), bits), texts


def following(texts: DataFrame, may: Filter, bits: int, o: Options) -> DataFrame:
    """Blocks of what follows the contexts that `may` passes in training rows, with the contexts and how many kinds of symbols each has in the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            distinct, shares, code = pairs(*(np.concatenate(x) for x in zip(*held)))
            return pair_blocks(distinct, shares, *np.unique(code, return_counts=True), bits)

        for b in opened(batches, o.least, learned=True):
            symbols = b.symbols[b.places]
            for at, h, times in b.contexts(o.least, [may] * o.depth):
                held.append((h, symbols[at], times))
            if sum(len(x[0]) for x in held) >= BUFFER:
                yield flush()
                held = []
        if held:
            yield flush()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        contexts, runs, symbols = unpacked_pairs(rows)
        distinct, at = ranked(contexts)
        code, n = summed(np.repeat(at, runs) << SYMBOL_BITS | symbols, np.concatenate([unpacked(c) for c in rows["counts"]]))
        out = dict(zip(("contexts", "runs", "symbols"), ([x] for x in packed_pairs(distinct, code))))
        return pd.DataFrame({"part": rows["part"].iloc[:1], **out, "counts": [packed(n)], "distinct": [distinct.view(np.int64)], "kinds": [np.bincount(code >> SYMBOL_BITS)]})

    block = f"part int, {PAIRS}, counts binary"
    return texts.mapInPandas(run, block).groupBy("part").applyInPandas(merged, block + ", distinct array<long>, kinds array<long>")


def _met(b: Batch, tree: Filter, o: Options) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's contexts that may be in the tree, by depth: places, where among the pairs asked for the contexts' own numbers and the pair stand (the end, where a symbol has no number). Then all distinct contexts, their shares, and the pairs to ask for."""
    met = list(b.contexts(o.least, [tree] * o.depth))
    symbols = b.symbols[b.places]
    distinct, shares, code = pairs(np.concatenate([h for _, h, _ in met]), np.concatenate([symbols[at] for at, _, _ in met]), np.concatenate([t for _, _, t in met]))
    context, own = code >> SYMBOL_BITS, np.arange(len(distinct)) << SYMBOL_BITS
    known = np.flatnonzero(code & ((1 << SYMBOL_BITS) - 1))
    wanted, place = ranked(np.concatenate([own | TOTAL, own | KINDS, code[known]]))
    total, kinds, of = place[: len(own)], place[len(own) : 2 * len(own)], np.full(len(code), len(wanted))
    of[known] = place[2 * len(own) :]
    end = np.cumsum([len(at) for at, _, _ in met])
    return [(at, total[context[e - len(at) : e]], kinds[context[e - len(at) : e]], of[e - len(at) : e]) for (at, _, _), e in zip(met, end)], distinct, shares, wanted


def score(docs: DataFrame, tree: Tree, o: Options = Options()) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of docs (doc_id, text)."""
    batches = batches_of(docs, F.lit(False), o)
    return _scored(coded(batches, questions(batches, tree.bits), tree.roots, tree.bits, o), tree, o)


def _scored(texts: DataFrame, tree: Tree, o: Options) -> DataFrame:
    may, bits, n, v, discount = texts.sparkSession.sparkContext.broadcast(tree.may), tree.bits, tree.tokens, tree.symbols, o.discount
    unseen = (tree.singles + 0.5) / (n + 1)  # the chance of a symbol that the training rows don't have

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for number, b in zip(frame["batch"], opened(iter([frame]), o.least)):
                _, distinct, shares, wanted = _met(b, may.value, o)
                rows = [(p, number, *packed_pairs(distinct, wanted[at])) for p, at in zip(*_groups(*pair_parts(distinct, shares, wanted, bits)))] if len(wanted) else []
                yield pd.DataFrame(rows, columns=["part", "batch", "contexts", "runs", "symbols"])

    def answered(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """Counts in the order of the pairs asked for, which the batch knows itself."""
        contexts, runs, symbols = unpacked_pairs(blocks)
        distinct, at = ranked(contexts)
        n = np.concatenate([unpacked(c) for c in blocks["counts"]]) if len(blocks) else np.zeros(0, np.uint64)
        code, n = summed(np.repeat(at, runs) << SYMBOL_BITS | symbols, n)
        counts = []
        for k in range(len(asked)):
            contexts, runs, symbols = unpacked_pairs(asked.iloc[k : k + 1])
            place = found(distinct, np.arange(1, len(distinct) + 1), contexts) - 1
            counts.append(packed(found(code, n, np.repeat(place, runs) << SYMBOL_BITS | symbols)))
        return pd.DataFrame({"batch": asked["batch"], "part": asked["part"], "counts": counts})

    question = f"part int, batch long, {PAIRS}"
    answers = texts.mapInPandas(asked, question).groupBy("part").cogroup(tree.model.withColumnRenamed("part", "of").groupBy("of")).applyInPandas(answered, "batch long, part int, counts binary")

    def scored(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in opened(iter([rows]), o.least):
            met, distinct, shares, wanted = _met(b, may.value, o)
            counts = np.zeros(len(wanted) + 1)
            if len(wanted):
                counts[pair_parts(distinct, shares, wanted, bits)[1]] = np.concatenate([unpacked(c) for c in answers.sort_values("part")["counts"]])
            c = b.counts[b.places]
            p = np.where(c > 0, (1 - unseen) * c / max(n, 1), unseen)
            alive = np.ones(len(c), dtype=bool)
            for at, total, kinds, of in met:
                some = (counts[total] > 0) & alive[at]
                at, total, kinds, of = at[some], counts[total[some]], counts[kinds[some]], counts[of[some]]
                p[at] = (np.maximum(of - discount, 0) + discount * kinds * p[at]) / total
                alive = np.zeros(len(c), dtype=bool)
                alive[at] = True
            text = np.repeat(np.arange(len(b.ids)), b.lengths)
            total_of = lambda x: np.bincount(text, weights=x, minlength=len(b.ids))  # noqa: B023, E731
            ids = pd.array(b.ids, dtype="Int64")
            ids[(b.flags & UNNAMED) > 0] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "n_tokens": b.lengths, "n_known": total_of(c > 0).astype(np.int64), "base_score": total_of(np.log10((c + 1) / (n + v + 1))), "score": total_of(np.log10(p))}))
        return pd.concat(out)

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    return texts.groupBy("batch").cogroup(answers.withColumnRenamed("batch", "to").groupBy("to")).applyInPandas(scored, schema)


def score_documents(docs: DataFrame, o: Options = Options(), modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) leaves another remainder, scores all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score. Null and empty texts have the end alone. A null doc_id counts as an
    empty one for the fold and stays null; repeated rows stay and count as often
    as they come; other columns are ignored. Without training rows both scores
    are those of an empty model.
    """
    small_batches(docs.sparkSession)
    tree, texts = _learned(batches_of(docs, ~held_out(F.col("doc_id").cast("long"), modulus, remainder), o), o)
    out = _scored(texts, tree, o)
    fold = held_out(F.col("doc_id"), modulus, remainder).alias("held_out")
    return out.select("doc_id", fold, "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")
