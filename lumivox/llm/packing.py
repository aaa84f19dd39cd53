"""Token ids packed into fixed-length rows and written as binary shards.

Each task packs bounded groups of segments by best fit, longest first: a
segment tree over the free capacities finds the fullest row that still takes
the segment. Overlong documents are cut into segments of a row's length, none
of their tokens lost. A shard has the id matrix, the cumulative segment lengths
of each row and the position resets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.bpe import PATTERN
from lumivox.llm.common import conf, filesystem, scratch, small_batches, written

MANIFEST = "doc_id long, segment int, first_token long, n_tokens int, shard string, pack string, row int, at int"


class FreeSpace:
    """Rows by free capacity, with a segment tree that finds the least capacity of at least n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += by
            node //= 2

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._count(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """Removes and returns (row, capacity) of the tightest row with n free, None if there is none."""
        node = self.leaves + n
        while not self.tree[node]:
            while node & 1:  # a right child: what lies to the right starts above
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit(lengths: list[int], length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and start of each segment, and the number of rows; longest first, ties in the order given."""
    row, at, free, rows = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32), FreeSpace(length), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = free.take(lengths[k])
        if found is None:
            found, rows = (rows, length), rows + 1
        row[k], at[k] = found[0], length - found[1]
        if found[1] > lengths[k]:
            free.put(found[1] - lengths[k], found[0])
    return row, at, rows


def write_shard(path: str, segments: list[np.ndarray], length: int, pad: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Packs and writes one shard, four .npy files; returns row and start of each segment."""
    row, at, rows = best_fit([len(s) for s in segments], length)
    ids, resets = np.full((rows, length), pad, dtype), np.zeros((rows, length), bool)
    for s, r, a in zip(segments, row, at):
        ids[r, a : a + len(s)] = s
        resets[r, a] = True
    order = np.lexsort((at, row))
    ends = np.array([at[k] + len(segments[k]) for k in order], dtype=np.int32)
    per_row = np.bincount(row, minlength=rows)
    starts = np.cumsum(per_row) - per_row
    lengths = np.insert(ends, starts, 0)  # of each row 0 and then the end of each segment
    splits = np.concatenate([[0], np.cumsum(per_row + 1)]).astype(np.int64)
    fs, root = filesystem(path)
    for name, array in (("ids", ids), ("cu_seqlens", lengths), ("row_splits", splits), ("resets", np.packbits(resets, axis=1))):
        with fs.open_output_stream(f"{root}.{name}.npy") as out:
            np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return row, at


def read_array(path: str, name: str) -> np.ndarray:
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}.{name}.npy") as f:
        return np.lib.format.read_array(f, allow_pickle=False)


@lru_cache(maxsize=2)
def ranked(path: str, pattern: str) -> tiktoken.Encoding:
    """A tokenizer from a file of byte strings and ranks, made once in each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, path: str, out: str, length: int = 2048, group_tokens: int = 1 << 22) -> DataFrame:
    """Encodes whole texts, packs them and writes shards into the shared folder `out`; returns the manifest.

    `path`: a file of token byte strings and ranks, on every machine; no special
    tokens are read or added. The pad is the first id beyond the vocabulary.

    One manifest row per segment: doc_id, segment (from 0), first_token in the
    document, n_tokens, shard, pack (row's name), row, at. Every token is in
    exactly one segment. A null or empty text has one row with n_tokens 0 and
    no place. A group is closed at group_tokens, so memory doesn't grow with
    the partition. The manifest names files of finished attempts only; what a
    lost attempt left in `out` is in no manifest row. Repeated rows stay, other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = ranked(path, PATTERN), TaskContext.get()
        pad = encoder.max_token_value + 1
        dtype = "<u2" if pad < 1 << 16 else "<u4"
        part, attempt, group = context.partitionId(), context.taskAttemptId(), 0
        keys: list[tuple] = []
        segments: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            shard, name = f"{out}/part-{part:06d}-{attempt}-{group:05d}", f"{part:06d}-{group:05d}"
            row, at = write_shard(shard, segments, length, pad, dtype)
            return rows([(*k, len(s), shard, f"{name}-{r:06d}", int(r), int(a)) for k, s, r, a in zip(keys, segments, row, at)])

        def rows(values: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*values), kinds)], names)

        for b in batches:
            empty = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(encoder.encode_ordinary(text or ""), dtype=dtype)
                if not len(ids):
                    empty.append((doc, 0, 0, 0, None, None, None, None))
                for k, first in enumerate(range(0, len(ids), length)):
                    keys.append((doc, k, first)), segments.append(ids[first : first + length])
                    held += len(segments[-1])
                    if held >= group_tokens:
                        yield flush()
                        keys, segments, held, group = [], [], 0, group + 1
            if empty:
                yield rows(empty)
        if segments:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(run, MANIFEST), "packing-manifest")


SHARDS_PER_TASK = 8


def unpack(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Reads the shards back: the manifest's rows that have a place, with `ids` from the matrix.

    With digest, instead `ids_sha256`, of the ids as little-endian 32-bit numbers.

    A shard whose cumulative lengths or resets disagree with the manifest is an error.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = rows["shard"].iloc[0]
        ids, ends, splits = (read_array(shard, n) for n in ("ids", "cu_seqlens", "row_splits"))
        resets = np.unpackbits(read_array(shard, "resets"), axis=1, count=ids.shape[1])
        found = {(r, int(a)): int(b) for r in range(len(ids)) for a, b in zip(ends[splits[r] : splits[r + 1] - 1], ends[splits[r] + 1 : splits[r + 1]])}
        told = {(r, a): a + n for r, a, n in zip(rows["row"], rows["at"], rows["n_tokens"])}
        if found != told or int(resets.sum()) != len(told) or not all(resets[r, a] for r, a in told):
            raise ValueError(f"{shard} doesn't hold what its manifest says")
        own = [ids[r, a : a + n].astype("<i4") for r, a, n in zip(rows["row"], rows["at"], rows["n_tokens"])]
        return rows.assign(ids_sha256=[hashlib.sha256(x.tobytes()).hexdigest() for x in own]) if digest else rows.assign(ids=own)

    placed = manifest.where("shard is not null")
    shards = placed.agg(F.count_distinct("shard")).first()[0]
    tasks = max(int(conf(manifest.sparkSession, "spark.sql.shuffle.partitions") or 1), -(-shards // SHARDS_PER_TASK))
    return placed.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, f"{MANIFEST}, {'ids_sha256 string' if digest else 'ids array<int>'}")


def packed_digests(docs: DataFrame, path: str, length: int = 2048) -> DataFrame:
    """A row per segment with the digest of its ids, as read back from the shards; empty texts with n_tokens 0."""
    manifest = pack(docs, path, scratch(docs.sparkSession, "packed"), length)
    keep = ["doc_id", "segment", "first_token", "n_tokens", "pack", "at"]
    empty = manifest.where("shard is null").select(*keep, F.sha2(F.lit(""), 256).alias("ids_sha256"))
    return unpack(manifest, digest=True).select(*keep, "ids_sha256").union(empty)
