"""Near-duplicate embeddings through an inverted multi-index.

Vectors are scaled to length one and split in halves; each half has a codebook
of its own, and the pairs of codes form a grid of cells. The number of codes
follows the number of vectors, so a cell keeps about `cell` of them. Every distinct vector
is indexed in its cell and visits cells by multi-sequence traversal, nearest
first by the sum of its two half distances, as many as the calibration found for the target recall: the
ranks at which a bounded set of queries has its true neighbours among all rows.
Each vector is sent once to its own cell and once to each cell that it visits.
Crowded cells are dealt into blocks of bounded size; blocks are compared as matrices in
double precision, and tasks return counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumivox.llm.common import components, small_batches, written


@dataclass(frozen=True)
class Options:
    """cell: vectors of a cell, on average, from which the number of codes follows; sample_per_code vectors fit a codebook, most_sampled
    at most; queries meet all rows for the calibration, and where fewer than few_linked of them have a neighbour, partners made for them count too; data_block, query_block: vectors of a cell that one task compares.
    """

    cell: int = 512
    sample_per_code: int = 40
    most_sampled: int = 60_000
    queries: int = 1000
    few_linked: int = 50
    recall: float = 0.995
    spare: int = 4
    rounds: int = 15
    data_block: int = 1024
    query_block: int = 8192
    seed: int = 5

    def codes(self, n: int) -> int:
        """Codes of each half for n vectors, as many as the bounded sample can fit."""
        return max(1, min(math.ceil(math.sqrt(n / self.cell)), self.most_sampled // self.sample_per_code))


def multi_sequence(d1: np.ndarray, d2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n cells nearest to each vector by d1[a] + d2[b], nearest first, as the codes a and b; d1 and d2: (vectors, codes).

    Both lists of half distances are sorted. Of each place in the first list
    the next place in the second that hasn't been visited is open, and each
    step visits the nearest open cell, for all vectors at once.
    """
    m, n = len(d1), min(n, d1.shape[1] * d2.shape[1])
    near1, near2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(d1, near1, 1)[:, :n], np.take_along_axis(d2, near2, 1)
    row, depth = np.arange(m), s1.shape[1]
    at = np.zeros((m, depth), np.int64)
    next_ = np.full((m, depth), np.inf)  # the open cell's distance, of each place in the first list
    next_[:, 0] = s1[:, 0] + s2[:, 0]
    first, second = np.empty((m, n), np.int64), np.empty((m, n), np.int64)
    reach = 1
    for step in range(n):
        a = np.argmin(next_[:, :reach], axis=1)
        b = at[row, a]
        first[:, step], second[:, step] = near1[row, a], near2[row, b]
        at[row, a] = b + 1
        further = np.where(b + 1 < s2.shape[1], s2[row, np.minimum(b + 1, s2.shape[1] - 1)], np.inf)
        next_[row, a] = s1[row, a] + further
        opened = (b == 0) & (a + 1 < depth)  # its first cell visited, the place after it opens
        next_[row[opened], a[opened] + 1] = s1[row[opened], a[opened] + 1] + s2[opened, 0]
        reach = min(depth, max(reach, int(a.max()) + 2))
    return first, second


@dataclass
class MultiIndex:
    books: tuple[np.ndarray, np.ndarray]
    visits: int  # cells that each vector visits

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to the codes."""
        half = self.books[0].shape[1]
        d1, d2 = (np.maximum((p**2).sum(1)[:, None] - 2 * p @ b.T + (b**2).sum(1), 0) for p, b in zip((x[:, :half], x[:, half:]), self.books))
        return d1, d2

    def own(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.halves(x)
        return d1.argmin(1) * len(self.books[1]) + d2.argmin(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector visits, its own first."""
        out = np.empty((len(x), self.visits), np.int64)
        some = max(1, (1 << 20) // self.visits)
        for k in range(0, len(x), some):
            a, b = multi_sequence(*self.halves(x[k : k + some]), self.visits)
            out[k : k + some] = a * len(self.books[1]) + b
        return out

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """In which place each vector's traversal comes to the cell beside it: how many cells are nearer, and one."""
        d1, d2 = self.halves(x)
        a, b = np.divmod(cells, len(self.books[1]))
        out = np.empty(len(x), np.int64)
        for k in range(len(x)):
            near = np.sort(d2[k])
            out[k] = 1 + np.searchsorted(near, d1[k, a[k]] + d2[k, b[k]] - d1[k] - 1e-12, "left").sum()
        return out


def _codebook(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        order = np.argsort(nearest, kind="stable")
        used, at = np.unique(nearest[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], at, axis=0) / np.diff([*at, len(x)])[:, None]
    return centres


def fit(sample: np.ndarray, codes: int, o: Options = Options()) -> MultiIndex:
    """Codebooks of a sample of unit vectors; all cells are visited until visits are set."""
    rng = np.random.default_rng(o.seed)
    half = (sample.shape[1] + 1) // 2
    books = tuple(_codebook(p, min(codes, len(p)), o.rounds, rng) for p in (sample[:, :half], sample[:, half:]))
    return MultiIndex(books, len(books[0]) * len(books[1]))


def needed_ranks(each: DataFrame, shared, queries, threshold: float, recall: float) -> list:
    """(query, rank): the place in its traversal by which a query has met the target share of its neighbours among all rows, itself left out.

    shared and queries: broadcasts of the index, and of the queries' classes and unit vectors. No row for a query without neighbours.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, (names, q) = shared.value, queries.value
        names = np.array(names)
        for b in batches:
            x, _ = _unit(b["embedding"])
            i, j = np.nonzero(q @ x.T >= threshold)
            other = names[i] != b["class"].to_numpy()[j]
            i, cell = i[other], index.own(x)[j[other]]
            pair, n = np.unique(np.stack([i, cell]), axis=1, return_counts=True)
            yield pd.DataFrame({"query": pair[0].astype(np.int32), "rank": index.ranks(q[pair[0]], pair[1]), "n": n})

    found = each.select("class", "embedding").mapInPandas(run, "query int, rank long, n long").groupBy("query", "rank").agg(F.sum("n").alias("n"))
    so_far, all_ = F.sum("n").over(Window.partitionBy("query").orderBy("rank")), F.sum("n").over(Window.partitionBy("query"))
    met = found.select("query", "rank", so_far.alias("met"), all_.alias("all")).where(F.col("met") >= recall * F.col("all") - 1e-9)
    return met.groupBy("query").agg(F.min("rank").alias("rank")).collect()


def made_ranks(index: MultiIndex, q: np.ndarray, threshold: float, o: Options = Options()) -> list:
    """(query, rank) as needed_ranks() gives, of partners made for the queries: just at the threshold, each in a direction of its own."""
    if q.shape[1] < 2 or not len(q):
        return []
    aside = np.random.default_rng(o.seed).normal(size=q.shape)
    aside -= (aside * q).sum(1)[:, None] * q
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
    partner = threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * aside
    return list(enumerate(index.ranks(q, index.own(partner)).tolist()))


def visits_for(ranks: list, q: np.ndarray, cells: int, threshold: float, o: Options = Options()) -> int:
    """Cells to visit for the target recall of the groups that the queries stand for; all where no query has a neighbour.

    Queries linked with each other count once, by the one that needs most, so
    that a large group doesn't hide the others.
    """
    if not ranks:
        return cells
    group = np.arange(len(q))
    a, b = np.nonzero(np.triu(q @ q.T >= threshold, 1))
    if len(a):
        far, root = _spanning(a, b)
        group[far] = root
    most: dict[int, int] = {}
    for i, rank in ranks:
        most[group[i]] = max(most.get(group[i], 0), rank)
    return min(cells, int(np.quantile(list(most.values()), o.recall, method="higher")) + o.spare)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def _unit(batch: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and the values that they come from."""
    x = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, 1))
    return (_unit_rows(x), x) if len(x) else (x, x)


def usable(vector: Column) -> Column:
    """Whether an array<double> links at all: it has components, all of them finite, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, class) of each row that links, and per class its least vec_id, copies and vector.

    class is a 128-bit hash of the vector's bits; equal vectors are one class, and vectors of one component by their sign.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    v = v.withColumn("embedding", F.when(F.size("embedding") == 1, F.array(F.signum(F.get("embedding", F.lit(0))))).otherwise(F.transform("embedding", lambda x: x + 0.0)))  # no zero is negative
    v = v.withColumn("class", F.concat_ws("-", F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit(1), "embedding"))))
    each = v.groupBy("class").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    return v.select("vec_id", "class"), each


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the edges as connect what all of them do, made into stars about each component's least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def link(vectors: DataFrame, threshold: float = 0.9, o: Options = Options()) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of `threshold` or more, in double precision,
    copies included. Vectors that are null, zero or hold null or non-finite
    components link with nothing; vectors link with those of their own width alone, whatever it is. A repeated
    vec_id keeps its rows, each of which counts as a vector. Rows with a null vec_id
    have no links and a null component_id, and are kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    alone = ids.where(~(F.col("vec_id").isNotNull() & usable(F.col("e")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    small_batches(spark)
    rows, each = distinct_vectors(vectors)
    each = written(each, "embed-classes")
    widths = {r.w: r.n for r in each.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = None
    for width, n in sorted(widths.items()):
        part = _found(each.where(F.size("embedding") == width), n, threshold, o)
        found = part if found is None else found.union(part)
    if found is None:
        return alone.withColumn("kept", F.lit(True))
    links = found.where("n is not null").groupBy(F.col("a").alias("least")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("n is null").select("a", "b"), "embed")
    named = each.select("class", "least", "copies").join(links, "least", "left")
    named = named.join(roots, named.least == roots.node, "left")
    named = written(named.select("class", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "least").alias("component_id")), "embed-named")
    linked = rows.join(named, "class").select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _found(each: DataFrame, n: int, threshold: float, o: Options) -> DataFrame:
    """(a, b, n) of the n classes, all of one width: rows with n give links to add to a's count, the others edges."""
    spark, codes = each.sparkSession, o.codes(n)
    sampled = min(o.most_sampled, o.sample_per_code * codes)
    sample = each.orderBy(F.xxhash64("class"), "class").limit(sampled + o.queries).select("class", "embedding").toArrow()
    x, names = _unit(pd.Series(sample.column("embedding").to_pylist()))[0], sample.column("class").to_pylist()
    index, q = fit(x[:sampled], codes, o), x[-o.queries :]  # the queries are others than the codebooks come from, where there are enough
    queries = spark.sparkContext.broadcast((names[-o.queries :], q))
    if index.visits > 1:
        ranks = needed_ranks(each, spark.sparkContext.broadcast(index), queries, threshold, o.recall)
        if len(ranks) < o.few_linked:  # few neighbours or none tell little of where others' are
            ranks = [tuple(r) for r in ranks] + made_ranks(index, q, threshold, o)
        index.visits = visits_for(ranks, q, index.visits, threshold, o)
    shared = spark.sparkContext.broadcast(index)
    del sample, x, names

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit, raw = _unit(b["embedding"])
            single = raw.astype("<f4")
            raw = single if (single == raw).all() else raw.astype("<f8")
            visited = shared.value.visited(unit)
            yield pd.DataFrame({"least": b["least"], "copies": b["copies"], "x": [v.tobytes() for v in raw], "single": raw.dtype == "<f4", "own": visited[:, 0], "visits": list(visited)})

    at = written(each.select("least", "copies", "embedding").mapInPandas(placed, "least long, copies long, x binary, single boolean, own long, visits array<long>"), "embed-cells")
    data = at.groupBy(F.col("own").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / o.data_block).cast("int").alias("data_blocks"))
    asked = at.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / o.query_block).cast("int").alias("query_blocks"))
    blocks = written(data.join(asked, "cell"), "embed-blocks")
    # each block of a cell's vectors meets each block of those that visit the cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, seed: F.pmod(F.xxhash64("least", F.lit(seed)), F.col(n)).cast("int")
    q_side = at.select(F.explode("visits").alias("cell"), "least", "copies", "x", "single", "own").join(blocks, "cell")
    q_side = q_side.select("cell", every("data_blocks").alias("block"), dealt("query_blocks", 1).alias("part"), "least", "copies", "x", "single", "own")
    d_side = at.withColumn("cell", F.col("own")).join(blocks, "cell")
    d_side = d_side.select("cell", dealt("data_blocks", 0).alias("block"), every("query_blocks").alias("part"), "least", "copies", "x", "single", "visits")

    q_side, d_side = (d.select([F.col(c).alias(f"{p}_{c}") for c in d.columns]) for d, p in ((q_side, "q"), (d_side, "d")))

    def units(rows: pd.DataFrame) -> np.ndarray:
        return _unit_rows(np.stack([np.frombuffer(x, "<f4" if s else "<f8").astype(np.float64) for x, s in zip(rows["x"], rows["single"])]))

    def compared(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)] * 2
        if len(q) and len(d):
            q, d = (x.rename(columns=lambda c: c[2:]) for x in (q, d))
            xq, xd = units(q), units(d)
            met = [np.argwhere(xq[k : k + 1024] @ xd.T >= threshold) + [k, 0] for k in range(0, len(xq), 1024)]
            i, j = np.concatenate(met).T
            a, b = q["least"].to_numpy(np.int64), d["least"].to_numpy(np.int64)
            other = a[i] != b[j]
            i, j = i[other], j[other]
            ca, cb = q["copies"].to_numpy(np.int64), d["copies"].to_numpy(np.int64)
            # where the other one doesn't visit this one's cell, the link is found only here
            home, visits = q["own"].to_numpy(np.int64), np.stack(d["visits"].to_numpy())
            one_way = np.empty(len(i), bool)
            for k in range(0, len(i), 1 << 16):
                one_way[k : k + (1 << 16)] = ~(visits[j[k : k + (1 << 16)]] == home[i[k : k + (1 << 16)]][:, None]).any(1)
            links = np.bincount(i, weights=cb[j], minlength=len(q)), np.bincount(j[one_way], weights=ca[i[one_way]], minlength=len(d))
            counts = np.concatenate([np.stack([who[n > 0], n[n > 0].astype(np.int64)], 1) for who, n in zip((a, b), links)])
            out = [counts, np.stack(_spanning(a[i], b[j]), 1) if len(i) else out[1]]
        counts, edges = out
        none = [None]
        return pd.DataFrame({"a": np.concatenate([counts[:, 0], edges[:, 0]]), "b": pd.array(none * len(counts) + edges[:, 1].tolist(), dtype="Int64"), "n": pd.array(counts[:, 1].tolist() + none * len(edges), dtype="Int64")})

    q_key, d_key = ([f"{p}_{c}" for c in ("cell", "block", "part")] for p in "qd")
    return written(q_side.groupBy(*q_key).cogroup(d_side.groupBy(*d_key)).applyInPandas(compared, "a long, b long, n long"), "embed-found")
