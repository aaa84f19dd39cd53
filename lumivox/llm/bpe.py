"""Byte-level BPE encoding and decoding, with cuts at byte pairs that no vocabulary token holds.

A merge only ever builds a vocabulary token. If two neighbouring bytes stand
together inside no token, no merge can span them: that place is a certain cut,
the fragments on its two sides merge independently, and their ids concatenate.
A text's bytes are cut at all such places first, but for a few at which the
pre-tokenizer would split one of the sides in another way (see `_cuts`), and
the ids of each distinct fragment are kept. A fragment's pieces are cut again
at every such pair before they are merged.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumivox.llm.common import small_batches

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of more than one byte in UTF-8, as the pattern's \\s has it.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SEPARATOR, APOSTROPHE = 0xFF, ord("'")  # the former is in no UTF-8
SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
CACHED_FRAGMENTS, CACHED_LENGTH, CACHED_PAIRS = 300_000, 32, 500_000


def _byte_chars() -> dict[str, int]:
    """The vocabulary file's printable character for each byte, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Cache(dict):
    """Ids by fragment, bounded: when full it takes no more until four times as many fragments have missed, then starts anew.

    Fragments of more than CACHED_LENGTH bytes are not kept.
    """

    def __init__(self, of: Callable[[bytes], Iterable[int]]):
        super().__init__()
        self.of, self.missed = of, 0

    def __missing__(self, fragment: bytes) -> tuple[int, ...]:
        ids = tuple(self.of(fragment))
        if len(self) < CACHED_FRAGMENTS:
            if len(fragment) <= CACHED_LENGTH:
                self[fragment] = ids
        elif (missed := self.missed + 1) <= 4 * CACHED_FRAGMENTS:
            self.missed = missed
        else:
            self.clear()
            self.missed = 0
        return ids


class Neighbours(dict):
    """Whether two tokens, one after the other, are what their bytes together merge to; bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        left, right = (self.codec.bytes[t] for t in pair)
        found = self[pair] = self.codec.merge(left + right) == list(pair)
        return found


class Codec:
    """One tokenizer file: encodes text to ids and decodes ids, like the library that the file is for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = _byte_chars(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.target = [vocab[a + b] for a, b in spec["model"]["merges"]]
        self.joined = bytearray(1 << 16)  # pairs that some token holds
        for i, t in self.bytes.items():
            if i not in self.special.values():
                for a, b in zip(t, t[1:]):
                    self.joined[a << 8 | b] = 1
        self.split = regex.compile(PATTERN).findall
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {t: i for i, t in self.bytes.items() if i not in self.special.values()}
        self.longest = max(map(len, self.token))
        # by pair of bytes: whether it is a certain cut; a cut inside a character is left to the second cutting, and so is one next to an apostrophe
        first, second = np.divmod(np.arange(1 << 16), 256)
        self.cut = (np.frombuffer(self.joined, np.uint8) == 0) & (second & 0xC0 != 0x80) & (first != ord("'")) & (second != ord("'"))
        self.neighbours = Neighbours(self)
        self.known = Cache(self._fragment)

    @property
    def size(self) -> int:
        return max(self.bytes) + 1

    def _cuts(self, raw: bytes) -> list[bytes]:
        """The text's bytes cut at certain cuts, but where that would change how the pre-tokenizer splits a side.

        It reads a side alone as it does in the text unless the cut stands in or before a contraction, which begin with an
        apostrophe, or between white space of two characters or more and something else, as the last of those belongs to
        what follows.
        """
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self.cut[b[:-1].astype(np.uint16) << 8 | b[1:]]) + 1
        before, last, after = b[np.maximum(at - 2, 0)], b[at - 1], b[at]
        if WIDE_SPACE.search(raw):
            mask = SPACE[b]
            for m in WIDE_SPACE.finditer(raw):
                mask[m.start() : m.end()] = True
            run = mask[np.maximum(at - 2, 0)] & mask[at - 1] & ~mask[at]
        else:
            run = SPACE[before] & SPACE[last] & ~SPACE[after]
        at = at[~((run | (before == APOSTROPHE)) & (at > 1))]
        return np.insert(b, at, SEPARATOR).tobytes().split(b"\xff") if len(at) else [raw]

    def _fragment(self, fragment: bytes) -> Iterable[int]:
        """Ids of a fragment of the text: its pieces by the pre-tokenizer, cut at every certain cut."""
        pieces = map(str.encode, self.split(fragment.decode()))
        return chain.from_iterable(map(self.encode_fragment, chain.from_iterable(map(self.fragments, pieces))))

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut at every pair of bytes that no token holds."""
        joined, start, out = self.joined, 0, []
        for i in range(1, len(piece)):
            if not joined[piece[i - 1] << 8 | piece[i]]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def encode_fragment(self, fragment: bytes) -> list[int]:
        """The one row of tokens each two neighbours of which are what their own bytes merge to.

        Longest token first, going back where no token fits after the last one;
        merging by rank gives that row, and no other has the property.
        """
        n, known, joins, longest = len(fragment), self.token.get, self.neighbours, self.longest
        out: list[int] = []
        ends, dead, at, end = [], set(), 0, min(n, longest)
        while at < n:
            while end > at:
                t = known(fragment[at:end])
                if t is not None and end not in dead and (not out or joins[out[-1], t]):
                    break
                end -= 1
            if end > at:
                out.append(t), ends.append(end)
                at, end = end, min(n, end + longest)
            else:
                dead.add(at)
                out.pop(), ends.pop()
                end, at = at - 1, ends[-1] if ends else 0
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Lowest rank first and leftmost first, by a heap over a linked list: n log n for any length."""
        ids = [self.byte_id[b] for b in fragment]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, *p) for i, p in enumerate(zip(ids, ids[1:])) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = self.target[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.rank.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> Iterator[int]:
        """Ids of a text without special tokens."""
        return chain.from_iterable(map(self.known.__getitem__, self._cuts(text.encode()))) if text else iter(())

    def encode(self, text: str) -> np.ndarray:
        if self.splitter and any(s in text for s in self.special):
            parts = self.splitter.split(text)
            ids = chain.from_iterable([self.special[p]] if k % 2 else self._plain(p) for k, p in enumerate(parts))
        else:
            ids = self._plain(text)
        return np.fromiter(ids, dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The file's codec, made once in each Python worker."""
    return Codec(path)


def id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row's whole text; a null text gives no ids, as an empty one does.

    Special tokens found in a text become their own id; none are added. `path`
    must name the tokenizer file on every machine. Repeated rows stay, the key
    may be null, other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), id_lists([c.encode(t or "") for t in b.column(1).to_pylist()])], ["key", "ids"])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds `text`, decoded from `ids`; null ids give a null text. A column named `text` before is replaced."""
    small_batches(encoded.sparkSession)
    rest = encoded.drop(text)
    at = rest.columns.index(ids)
    names, schema = [*rest.columns, text], T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            flat, texts = b.column(at), []
            for k in range(b.num_rows):
                row = flat[k]
                texts.append(c.decode(row.values.to_numpy(zero_copy_only=False).tolist()) if row.is_valid else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return rest.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, through encode and decode."""
    back = decode(encode(docs, path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
