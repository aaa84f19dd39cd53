"""Near-duplicate documents by 64-bit SimHash, joined through the words of a covering code.

Two blocks of 23 bits of a fingerprint are read against the perfect binary
Golay code (covering radius 3 in each block). The anchors are pairs of code
words; each fingerprint has one home anchor, within the radius in both blocks.
If two fingerprints differ in at most t bits, the second lies within radius
plus t of the first one's home anchor, counted over both blocks; so a copy of
each fingerprint at every such anchor meets the home of each linked one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.common import components, conf, discard, small_batches, written

WIDTH, RADIUS, GENERATOR = 23, 3, 0xC75  # the Golay code and its generator polynomial


def _remainder(v: np.ndarray) -> np.ndarray:
    """v modulo the generator polynomial over GF(2): equal for v that differ by a code word."""
    v = v.copy()
    for bit in range(WIDTH - 1, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


@lru_cache(maxsize=1)
def _error_lists() -> list[tuple[np.ndarray, np.ndarray]]:
    """For 0, 1 and 2 steps beyond the radius: starts by remainder, and error patterns of that weight in its order.

    The first list holds weights up to the radius: one pattern for each remainder, as the code is perfect.
    """
    out = []
    for weights in (range(RADIUS + 1), (RADIUS + 1,), (RADIUS + 2,)):
        e = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(WIDTH), w)], dtype=np.int64)
        r = _remainder(e)
        order = np.argsort(r, kind="stable")
        out.append((np.concatenate([[0], np.cumsum(np.bincount(r, minlength=2048))]), e[order]))
    return out


def anchors(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of fp and their anchors within the radius plus bits (at most 2), and whether each is the home."""
    mask = (1 << WIDTH) - 1
    blocks = [(fp & mask).astype(np.int64), (fp >> WIDTH & mask).astype(np.int64)]
    rem, lists = [_remainder(b) for b in blocks], _error_lists()
    rows, keys, homes = [], [], []
    for i, j in ((i, j) for i in range(bits + 1) for j in range(bits + 1 - i)):
        (s1, e1), (s2, e2) = lists[i], lists[j]
        n1, n2 = s1[rem[0] + 1] - s1[rem[0]], s2[rem[1] + 1] - s2[rem[1]]
        n = n1 * n2
        row = np.repeat(np.arange(len(fp)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a1 = blocks[0][row] ^ e1[s1[rem[0]][row] + k // n2[row]]
        a2 = blocks[1][row] ^ e2[s2[rem[1]][row] + k % n2[row]]
        rows.append(row), keys.append(a1 | a2 << WIDTH), homes.append(np.full(len(row), i + j == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a whole text; 0 where it has no word."""
    w = (text or "").encode().lower().split()  # on bytes both act on ASCII alone
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = w[at : at + (1 << 16) + words - 1] if n > 1 else w
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if n > 1 else [b" ".join(w)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long. A null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def _at_anchors(fps: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(dtype=np.int64)
            for at in range(0, len(fp), 512):
                row, key, home = anchors(fp[at : at + 512], bits)
                yield pd.DataFrame({"anchor": key, "fp": fp[at : at + 512][row], "home": home})

    return fps.select("fp").mapInPandas(run, "anchor long, fp long, home boolean")


def _by_shared_points(fps: DataFrame) -> DataFrame:
    """Links at 2 bits or fewer through the points at 1 bit or fewer: a point has 65 fingerprints about it at most."""
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    points = fps.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
    near = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return near.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def links(fps: DataFrame, bits: int = 2, crowd: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all those at `bits` (1 or 2) or fewer apart.

    Homes and replicas are compared at each anchor. Where more than `crowd`
    homes share an anchor, pairs would grow with the square of the crowd; all
    fingerprints at such anchors are linked through shared points one bit
    away instead, which connects the same ones exactly at 2 bits.
    """
    spread = _at_anchors(fps, bits)
    homes = spread.where("home").select("anchor", "fp")
    crowded = written(homes.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "simhash-crowded") if bits == 2 else None
    extra = None
    if crowded is not None and not crowded.isEmpty():
        extra = _by_shared_points(spread.join(crowded, "anchor", "left_semi").select("fp").distinct())
        homes = homes.join(crowded, "anchor", "left_anti")
    h, r = homes.select("anchor", F.col("fp").alias("a")), spread.select("anchor", F.col("fp").alias("b"))
    # hinted: Spark takes these rows for no more than the fingerprints, and would send all of them to the driver where those are few
    met = h.hint("merge").join(r, (h.anchor == r.anchor) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    return met.union(extra) if extra is not None else met


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in `bits` or fewer of 64.
    component_id is the smallest doc_id reachable. Texts without a word,
    null ones included, have fingerprint zero and link like any other. Rows
    with a null doc_id take part and get their component's smallest id, null if
    all its ids are. Repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    prints = written(fingerprints(docs, words), "simhash-prints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = written(components(links(fps, bits), "simhash"), "simhash-roots")
    labelled = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    single = labelled.join(ids.where("n > 1").select("root", F.col("component_id").alias("shared")), "root", "left")
    classes = written(single.select(F.col("fp").alias("key"), F.coalesce("shared", "least").alias("component_id")), "simhash-classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, prints.fp == classes.key).select("doc_id", hexed, "component_id")


# texts of a given Jaccard similarity: wide fingerprints, many pairs of blocks, and an exact check


LANES, TABLE_SHIFT, BITS = ["f0", "f1", "f2", "f3"], 50, 256
FEW, BLOCK = 8, 512  # classes at an anchor that are compared as pairs; classes of a block at the others


def tables_for(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Plain bits beside the anchor so that n texts have 1/16 of a chance partner in a table, and tables for the recall.

    Bits of two texts differ with a chance of half their distance; a home
    anchor is shared 0.83 times as often as 12 plain bits would be, by simulation. At a similarity
    of 0.8 the tables grow as the 0.15th power of the number of texts.
    """
    extra, same = max(0, math.ceil(math.log2(max(n, 2))) + 4 - 12), (1 + similarity) / 2
    return extra, math.ceil(math.log(1 - recall) / math.log(1 - 0.83 * same ** (12 + extra)))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles; a text of fewer words has one, without a word none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = set(map(b" ".join, zip(*(w[k:] for k in range(words))))) if len(w) >= words else {b" ".join(w)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), dtype=np.uint64, count=len(shingles)))


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(13).integers(1 << 32, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """256 bits as four words: of each of 256 orders of the hashes one bit of the least, so bits follow the Jaccard similarity.

    Two texts of similarity s differ in (1 - s) / 2 of them; sums of signs would differ in acos(2 s / (1 + s)) / pi, half as many again at 0.8.
    """
    least = np.full(BITS, ~np.uint64(0))
    for at in range(0, len(h), 1 << 9):
        x = h[at : at + (1 << 9), None] * _multipliers()[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(axis=0))
    bits = (least >> np.uint64(17) & np.uint64(1)).astype(np.uint8) if len(h) else np.zeros(BITS, np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)


def _table_keys(lanes: np.ndarray, extra: int, tables: int) -> np.ndarray:
    """(rows, tables) keys: in each table the home anchor of 23 of the bits and `extra` plain ones, drawn anew for each table."""
    bits = np.unpackbits(np.ascontiguousarray(lanes, dtype="<u8").view(np.uint8).reshape(-1, 32), axis=1, bitorder="little").astype(np.int64)
    rng, leader, power = np.random.default_rng(11), _error_lists()[0][1], 1 << np.arange(WIDTH, dtype=np.int64)
    out = np.empty((len(lanes), tables), np.int64)
    for t in range(tables):
        take = rng.permutation(BITS)[: WIDTH + extra]
        a, b = bits[:, take[:WIDTH]] @ power, bits[:, take[WIDTH:]] @ (1 << np.arange(extra, dtype=np.int64))
        out[:, t] = (a ^ leader[_remainder(a)]) | b << WIDTH | t << TABLE_SHIFT
    return out


def _candidates(rows: pd.DataFrame, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs across a block pair, or within one block, that are near in bits and not linked yet."""
    lanes, root, side = rows[LANES].to_numpy(np.int64).view(np.uint64), rows["root"].to_numpy(np.int64), rows["side"].to_numpy()
    x, y = (np.flatnonzero(side == k) for k in (0, 1))
    y = y if len(y) or rows["bx"].iloc[0] != rows["by"].iloc[0] else x
    far = sum(np.bitwise_count(lanes[x, k][:, None] ^ lanes[y, k][None, :]).astype(np.int64) for k in range(4))
    i, j = np.nonzero((far <= apart) & (root[x][:, None] != root[y][None, :]))
    return x[i], y[j]


def _shared_shingles(sets: list[np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
    """How many members each two of the sets share, by products of bounded pieces of their incidence matrix."""
    size = np.array([len(s) for s in sets])
    _, flat, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, flat = np.repeat(np.arange(len(sets)), size)[n[flat] > 1], flat[n[flat] > 1]
    ids, flat = np.unique(flat, return_inverse=True)
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, len(ids), chunk):
        a, b = np.searchsorted(flat, [at, at + chunk])
        piece = np.zeros((len(sets), chunk), np.float32)
        piece[row[a:b], flat[a:b] - at] = 1
        out += piece @ piece.T
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that connect what all of them do, no more than there are nodes."""
    up, keep = {}, []

    def top(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (x := top(x)) != (y := top(y)):
            up[x] = y
            keep.append(k)
    return np.array(keep, dtype=np.int64)


def _crowd_links(at: DataFrame, classes: DataFrame, roots: DataFrame, texts: DataFrame, words: int, similarity: float, apart: int) -> DataFrame | None:
    """Edges (a, b) that connect all similar classes with a common anchor in `at` (key, rep) that `roots` hasn't linked; None if no pair is near.

    Classes at an anchor are dealt into salted blocks, those of a large
    component into blocks of their own, and all blocks are compared with each
    other but those of one component, on bits alone. What is near at any anchor makes clusters, whose members' shingles are then
    compared in blocks once, however many anchors they have in common. Tasks return
    spanning forests.
    """
    at = written(at.join(roots, at.rep == roots.node, "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), "similar-crowded")
    of_root = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    keys = of_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0)).alias("mixed")).where("roots > 1").select("key", "mixed")
    crowds = written(of_root.join(keys, "key"), "similar-crowds")
    of_root = crowds.select("key", "root", (F.col("c") >= BLOCK).alias("own"), F.ceil(F.when(F.col("c") >= BLOCK, F.col("c")).otherwise(F.col("mixed")) / BLOCK).cast("int").alias("salts"))
    if of_root.isEmpty():
        discard(at, crowds)
        return None
    name = F.when(F.col("own"), F.col("root").cast("string")).otherwise("mixed")
    blocks = of_root.select("key", "own", name.alias("name"), "salts").distinct().select("key", "own", "name", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    side = lambda p: blocks.select("key", F.col("own").alias(f"o{p}"), F.col("name").alias(f"n{p}"), F.concat_ws(":", "name", "salt").alias(f"b{p}"))
    met = written(side("x").hint("merge").join(side("y"), "key").where("bx <= by and not (ox and nx = ny)").select("key", "bx", "by"), "similar-block-pairs")
    member = at.join(of_root, ["key", "root"]).join(classes, "rep")
    block = F.concat_ws(":", name, F.pmod(F.xxhash64("rep", F.lit(3)), F.col("salts")).cast("int"))
    member = written(member.select("key", "rep", "root", *LANES, block.alias("block")), "similar-members")
    sides = [met.where("true" if k == 0 else "bx < by").withColumnRenamed(b, "block").withColumn(b, F.col("block")).hint("merge").join(member, ["key", "block"]).select("key", "bx", "by", F.lit(k).alias("side"), "rep", "root", *LANES) for k, b in enumerate(("bx", "by"))]
    def near(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = _candidates(rows, apart)
        rep = rows["rep"].to_numpy(np.int64)
        keep = _forest(rep[i], rep[j])
        return pd.DataFrame({"a": rep[i[keep]], "b": rep[j[keep]]})

    edges = written(sides[0].union(sides[1]).groupBy("key", "bx", "by").applyInPandas(near, "a long, b long"), "similar-near")
    discard(at, crowds, met, member)
    if edges.isEmpty():
        return None
    cluster = written(components(edges, "similar-near"), "similar-clusters")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rep": b["doc_id"], "shingles": [shingle_hashes(t, words).view(np.int64) for t in b["text"]]})

    whole = texts.join(cluster.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    whole = whole.mapInPandas(shingled, "rep long, shingles array<long>")
    size = cluster.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    named = cluster.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).join(size, "cluster").join(classes, "rep").join(whole.hint("merge"), "rep").join(roots, F.col("rep") == roots.node, "left")
    salt = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("salts")).cast("int")
    named = named.select("cluster", "rep", F.coalesce("root", "rep").alias("root"), *LANES, "shingles", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("with"))
    named = named.select("cluster", F.least("salt", "with").alias("bx"), F.greatest("salt", "with").alias("by"), (F.col("salt") > F.col("with")).cast("int").alias("side"), "rep", "root", *LANES, "shingles")

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = _candidates(rows, apart)
        if not len(i):
            return pd.DataFrame({"a": i, "b": j})
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        sets = [np.asarray(rows["shingles"].iloc[k], dtype=np.int64) for k in used]
        p, q = at[: len(i)], at[len(i) :]
        size, both = np.array([len(s) for s in sets]), _shared_shingles(sets)[p, q]
        like = both >= similarity * (size[p] + size[q] - both)
        root, rep = rows["root"].to_numpy(np.int64), rows["rep"].to_numpy(np.int64)
        i, j = i[like], j[like]
        keep = _forest(root[i], root[j])
        return pd.DataFrame({"a": rep[i[keep]], "b": rep[j[keep]]})

    return written(named.groupBy("cluster", "bx", "by").applyInPandas(linked, "a long, b long"), "similar-crowd-links")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """The rows (key, rep) whose key more than one rep has, with n, low and high of the key.

    Hinted, like other joins of rows that came out of a few or of texts that are written tightly: Spark's size of them is far too low to send them to the driver.
    """
    ends = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    return rows.hint("merge").join(ends, "key")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, apart: int = 45, recall: float = 0.9995) -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of `similarity` or more of their distinct shingles.

    Texts with one 256-bit fingerprint are one class. In each table, all classes
    with the same home anchor are compared, where there are few of them as
    pairs. Where there are more, each first meets the least and the largest of
    them, and those not yet linked are then compared in blocks.
    Pairs of `apart` of 256 bits or fewer are checked on their whole
    texts: more differ with a chance of 3e-5 in a pair just at the similarity, which shares an anchor in one of the tables
    with a chance of `recall` if it differs in as many bits as is to be expected, with a smaller one if in more. component_id is the smallest doc_id reachable; rows with a
    null doc_id are left out; of texts with one doc_id the least counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = np.array([wide_fingerprint(shingle_hashes(t, words)) for t in b["text"]], dtype=np.uint64).reshape(-1, 4).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {c: f[:, k] for k, c in enumerate(LANES)})

    prints = written(texts.mapInPandas(printed, "doc_id long, f0 long, f1 long, f2 long, f3 long"), "similar-prints")
    classes = written(prints.groupBy(*LANES).agg(F.min("doc_id").alias("rep")), "similar-classes")

    n = classes.count()
    extra, tables = tables_for(n, similarity, recall)
    spread = max(int(conf(spark, "spark.sql.shuffle.partitions") or 1), -(-n // 50_000))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = _table_keys(b[LANES].to_numpy(np.int64).view(np.uint64), extra, tables)
            yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(b["rep"].to_numpy(np.int64), tables)})

    rows = classes.repartition(spread, "rep").mapInPandas(keyed, "key long, rep long")
    at = written(_shared_keys(rows), "similar-at")
    few = at.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("rep").alias("all"))
    few = few.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    pairs = few.union(at.where(F.col("n") > FEW).select(F.col("rep").alias("x"), F.explode(F.array("low", "high")).alias("y"))).where("x <> y")
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    side = lambda n: classes.select(F.col("rep").alias(n), *[F.col(c).alias(f"{n}{c}") for c in LANES])
    pairs = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    pairs = written(pairs.where(sum(F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in LANES) <= apart).select("a", "b"), "similar-pairs")
    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["at"], b["bt"]):
                p, q = shingle_hashes(x, words), shingle_hashes(y, words)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield b.loc[keep, ["a", "b"]]

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole texts are similar."""
        some = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        whole = written(texts.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "similar-texts")
        met = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("text").alias("at")).hint("merge"), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("text").alias("bt")).hint("merge"), "b")
        out = written(met.select("a", "b", "at", "bt").mapInPandas(checked, "a long, b long"), "similar-checked")
        discard(whole)
        return out

    # each text with its least partner first: of the other pairs, most are in one component then
    first = similar(pairs.groupBy("a").agg(F.min("b").alias("b")))
    roots = written(components(first, "similar-first"), "similar-first-roots")
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    left = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    second = similar(written(left.select("a", "b"), "similar-left"))
    before, roots = roots, written(components(first.union(second), "similar"), "similar-roots")
    discard(pairs, first, second, before)
    more = _crowd_links(at.where(F.col("n") > FEW).select("key", "rep"), classes, roots, texts, words, similarity, apart)
    if more is not None:
        roots = written(components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "similar-all"), "similar-all-roots")
    named = written(classes.join(roots, classes.rep == roots.node, "left").select(*LANES, F.coalesce("root", "rep").alias("component_id")), "similar-named")
    discard(at, classes, roots, more)
    return prints.join(named, LANES).select("doc_id", "component_id")
