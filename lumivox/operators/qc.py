"""Image quality: neighbour correlations, contrast, outlier slices, fibre coherence and the report row.

Correlations are one aggregation in which each voxel meets its scan's pairs of
volumes; slices and directions meet their neighbours by joins on the grid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.functions.storage import checkpointed
from lumivox.operators.order_stats import nearest_rank
from lumivox.operators.voxel import KEY

NAN = float("nan")


@dataclass(frozen=True)
class SliceOptions:
    axis: int = 2
    min_voxels: int = 100
    sigma: float = 2.0
    threshold: float = 2.5


def q_vectors(gradient: DataFrame) -> DataFrame:
    """Adds qx, qy, qz: the direction scaled by the root of the b-value."""
    q = F.sqrt(F.greatest(F.col("bval"), F.lit(0.0)))
    return gradient.withColumns({f"q{a}": q * F.col(f"g{a}") for a in "xyz"})


def _pairs(gradient: DataFrame, threshold: float) -> DataFrame:
    """Each weighted volume i beside each other one j of its scan; the number of volumes bounds it."""
    g = q_vectors(gradient).where(F.col("bval") > threshold).select("scan_id", "vol", "qx", "qy", "qz")
    i, j = (g.select("scan_id", *[F.col(c).alias(f"{n}_{c}") for c in ("vol", "qx", "qy", "qz")]) for n in "ij")
    return i.join(j, "scan_id").where("i_vol <> j_vol")


def neighbour_pairs(gradient: DataFrame, threshold: float = 50.0) -> DataFrame:
    """scan_id, i, j: the weighted volume nearest to i in q-space, up to sign; ties to the lowest j."""
    p = _pairs(gradient, threshold)
    d = lambda s: F.sqrt(sum((F.col(f"i_{a}") + s * F.col(f"j_{a}")) ** 2 for a in ("qx", "qy", "qz")))
    near = p.groupBy("scan_id", F.col("i_vol").alias("i")).agg(F.min(F.struct(F.least(d(-1), d(1)).alias("d"), F.col("j_vol").alias("j"))).alias("m"))
    return near.select("scan_id", "i", "m.j")


def contrast_pairs(gradient: DataFrame, threshold: float = 50.0) -> DataFrame:
    """scan_id, i, j: the volume whose part perpendicular to i, scaled to i's length, is nearest to j itself; ties to the lowest j."""
    p = _pairs(gradient, threshold)
    axes = ("qx", "qy", "qz")
    ii, ij = (sum(F.col(f"i_{a}") * F.col(f"{n}_{a}") for a in axes) for n in "ij")
    p = p.withColumn("t", ij / ii).withColumn("length", F.sqrt(ii))
    perp = {a: F.col(f"j_{a}") - F.col("t") * F.col(f"i_{a}") for a in axes}
    p = p.withColumns({f"p_{a}": x for a, x in perp.items()}).withColumn("norm", F.sqrt(sum(F.col(f"p_{a}") ** 2 for a in axes)))
    p = p.where(F.col("norm") > 1e-8 * F.greatest(F.col("length"), F.lit(1.0)))
    far = F.sqrt(sum((F.col(f"j_{a}") - F.col(f"p_{a}") / F.col("norm") * F.col("length")) ** 2 for a in axes))
    best = p.groupBy("scan_id", F.col("i_vol").alias("i")).agg(F.min(F.struct(far.alias("d"), F.col("j_vol").alias("j"))).alias("m"))
    return best.select("scan_id", "i", "m.j")


def contrast_triples(gradient: DataFrame, threshold: float = 50.0) -> DataFrame:
    """scan_id, i, near, contrast, for volumes that have both."""
    near, far = neighbour_pairs(gradient, threshold), contrast_pairs(gradient, threshold)
    return near.withColumnRenamed("j", "near").join(far.withColumnRenamed("j", "contrast"), ["scan_id", "i"])


def pair_statistics(voxels: DataFrame, pairs: DataFrame, masked: bool = False) -> DataFrame:
    """scan_id, i, j, r, mean_i, mean_j over the given voxels, and the same within the mask if `masked`; r is NaN where either volume is constant.

    Each voxel row meets its scan's pairs, so both values of a pair come from the
    same row: one aggregation and no join of the long view with itself. Sums are
    taken about the pair's means.
    """
    v = voxels.select("scan_id", "signal", *(["in_mask"] if masked else [])).join(pairs, "scan_id")
    a, b = F.get("signal", "i"), F.get("signal", "j")
    sums, out = [], []
    for end in ("", "_masked")[: 1 + masked]:
        x, y = (F.when(F.col("in_mask"), c) if end else c for c in (a, b))
        sums += [F.covar_pop(x, y).alias(f"c{end}"), F.stddev_pop(x).alias(f"sx{end}"), F.stddev_pop(y).alias(f"sy{end}"), F.avg(x).alias(f"mean_i{end}"), F.avg(y).alias(f"mean_j{end}")]
        ok = (F.col(f"sx{end}") > 0) & (F.col(f"sy{end}") > 0)
        out += [F.when(ok, F.try_divide(f"c{end}", F.col(f"sx{end}") * F.col(f"sy{end}"))).otherwise(F.lit(NAN)).alias(f"r{end}"), F.col(f"mean_i{end}"), F.col(f"mean_j{end}")]
    return v.groupBy("scan_id", "i", "j").agg(*sums).select("scan_id", "i", "j", *out)


def pair_correlations(voxels: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, i, j, r, mean_i, mean_j of each pair."""
    return pair_statistics(voxels, pairs)


def ndc(voxels: DataFrame, gradient: DataFrame) -> DataFrame:
    """scan_id, ndc: mean correlation of weighted volumes with their nearest one; no row for a scan without pairs."""
    return pair_correlations(voxels, neighbour_pairs(gradient)).groupBy("scan_id").agg(F.avg("r").alias("ndc"))


def correlation_report(voxels: DataFrame, gradient: DataFrame, masked: bool = True) -> DataFrame:
    """scan_id, ndc, contrast_ratio, and both within the mask, from one pass over the voxels."""
    kind = lambda pairs, name: pairs.select("scan_id", "i", "j", F.lit(name).alias("kind"))
    triples = contrast_triples(gradient)
    wanted = kind(neighbour_pairs(gradient), "ndc").union(kind(triples.withColumnRenamed("near", "j"), "near")).union(kind(triples.withColumnRenamed("contrast", "j"), "contrast"))
    ends = ("", "_masked")[: 1 + masked]
    r = wanted.join(pair_statistics(voxels, wanted.select("scan_id", "i", "j").distinct(), masked), ["scan_id", "i", "j"])
    m = r.groupBy("scan_id").agg(*[F.avg(F.when(F.col("kind") == k, F.col(f"r{e}"))).alias(f"{k}{e}") for k in ("ndc", "near", "contrast") for e in ends])
    return m.select("scan_id", *[c for e in ends for c in (F.col(f"ndc{e}"), F.try_divide(f"near{e}", f"contrast{e}").alias(f"contrast_ratio{e}"))])


def contrast_ratio(voxels: DataFrame, gradient: DataFrame) -> DataFrame:
    """scan_id, contrast_ratio: mean correlation with the nearest volume over that with the contrast volume, over volumes that have both."""
    return correlation_report(voxels, gradient, masked=False).select("scan_id", "contrast_ratio").where("contrast_ratio is not null")


def contrast_grade(ratio: Column) -> Column:
    """poor, fair or good; NaN is below no bound and so counts as good, and has a warning of its own."""
    return F.when(F.isnan(ratio), "good").when(ratio < 1.1, "poor").when(ratio <= 1.3, "fair").otherwise("good")


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights at -r..r with r = int(4 sigma + 0.5), summing to 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def reflect(i: Column, n: Column | int) -> Column:
    """Half-sample symmetric index into 0..n-1."""
    n = F.lit(n) if isinstance(n, int) else n
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")


def _reflected(n: int, r: int) -> np.ndarray:
    """(n, 2 r + 1) indices that a kernel of radius r reads about each place, reflected at the border."""
    at = (np.arange(n)[:, None] + np.arange(-r, r + 1)) % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def smooth_in_plane(voxels: DataFrame, sigma: float, axis: int = 2) -> DataFrame:
    """scan_id, x, y, z, signal of each plane with a voxel, each volume smoothed along the two axes but `axis`, the lower axis first.

    Planes are independent of each other: each is one group, and has its scan's whole grid, where a place without a row counts as 0 and gets one.
    Results of either pass are stored in single precision; sigma 0 changes nothing.
    """
    if sigma == 0:
        return voxels.select(*KEY, "signal")
    kernel, names = np.array(gaussian_kernel(sigma)), [c for k, c in enumerate("xyz") if k != axis]

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        at, first = [rows[c].to_numpy() for c in names], rows.iloc[0]
        plane = np.zeros((first["n0"], first["n1"], len(first["signal"])), np.float32)
        plane[at[0], at[1]] = np.stack(rows["signal"].to_numpy())
        for _ in range(2):  # one axis, then the other, which the transposition brings to the front and back
            out = np.zeros(plane.shape)
            for w, i in zip(kernel, _reflected(len(plane), len(kernel) // 2).T):
                out += w * plane[i]
            plane = out.astype(np.float32).transpose(1, 0, 2)
        places = dict(zip(names, np.indices(plane.shape[:2]).reshape(2, -1)))
        return pd.DataFrame({"scan_id": first["scan_id"]} | {c: places.get(c, first[c]) for c in "xyz"} | {"signal": list(plane.reshape(-1, plane.shape[2]))})

    grid = voxels.groupBy("scan_id").agg(*[(F.max(c) + 1).alias(f"n{k}") for k, c in enumerate(names)])
    whole = voxels.select(*KEY, "signal").join(F.broadcast(grid), "scan_id")
    return whole.groupBy("scan_id", "xyz"[axis]).applyInPandas(smooth, "scan_id string, x int, y int, z int, signal array<float>")


def outlier_slices(voxels: DataFrame, o: SliceOptions = SliceOptions()) -> DataFrame:
    """scan_id, vol, slice, ratio, outlier for interior slices with enough voxels in the mask, each volume smoothed in its planes first.

    The ratio sets each slice's difference from the mean of its two neighbours
    against half theirs from one another; NaN where they don't differ, and NaN is no
    outlier. Neighbours need not be in the mask. Whole signals meet their
    neighbours, so there is one key for each voxel and not for each volume of it.
    """
    axis = "xyz"[o.axis]
    smooth = smooth_in_plane(voxels, o.sigma, o.axis)
    ends = smooth.groupBy("scan_id").agg(F.max(axis).alias("last"))
    sent = smooth.select(*KEY, "signal", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("d"))
    sent = sent.select(*[(F.col(c) - F.col("d")).alias(c) if c == axis else F.col(c) for c in KEY], F.struct("d", "signal").alias("p"))
    near = sent.groupBy(*KEY).agg(*[F.max(F.when(F.col("p.d") == d, F.col("p.signal"))).alias(n) for d, n in ((-1, "below"), (0, "own"), (1, "above"))])
    near = near.join(voxels.where("in_mask").select(*KEY), KEY).join(ends, "scan_id").where((F.col(axis) > 0) & (F.col(axis) < F.col("last")))
    each = near.select("scan_id", F.col(axis).alias("slice"), F.posexplode(F.arrays_zip("below", "own", "above")).alias("vol", "v"))
    below, own, above = (F.col(f"v.{c}").cast("double") for c in ("below", "own", "above"))
    s = each.groupBy("scan_id", "vol", "slice").agg(F.sum(F.abs(own - (below + above) / 2)).alias("off"), F.sum(F.abs(above - below) / 2).alias("spread"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("spread") > 0, F.try_divide("off", "spread")).otherwise(F.lit(NAN))
    s = s.where(F.col("n") >= o.min_voxels).withColumn("ratio", ratio)
    return s.select("scan_id", "vol", "slice", "ratio", (~F.isnan("ratio") & (F.col("ratio") > o.threshold)).alias("outlier"))


def _dir(k: int, column: str = "principal_dir") -> Column:
    return F.get(column, F.lit(k))


def evaluated(dti: DataFrame, quantile: float) -> DataFrame:
    """Voxels with a direction whose anisotropy isn't below the scan's `quantile`; adds the cut. Written, as several joins read it."""
    some = dti.where((F.col("fa") > 0) & (_dir(0) ** 2 + _dir(1) ** 2 + _dir(2) ** 2 > 0)).select(*KEY, "fa", "principal_dir")
    return checkpointed(some.join(nearest_rank(some, ["scan_id"], "fa", {"cut": quantile}), "scan_id").where("fa >= cut"))


def _connected(some: DataFrame, angle: float, voxel_mm: tuple[float, float, float]) -> DataFrame:
    """some with `agree`: whether the direction one lattice step forward or backward along a voxel's own is within the angle of it."""
    index = [_dir(k) / voxel_mm[k] for k in range(3)]
    top = F.greatest(*[F.abs(x) for x in index])
    step = F.array(*[F.round(x / top).cast("int") for x in index])
    met = some.select(*KEY, "fa", F.col("principal_dir").alias("own_dir"), step.alias("step"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    met = met.select(*KEY, "fa", "own_dir", *[(F.col(n) + F.col("way") * F.get("step", F.lit(k))).cast("int").alias(f"to_{n}") for k, n in enumerate("xyz")])
    other = some.select("scan_id", *[F.col(n).alias(f"to_{n}") for n in "xyz"], F.col("principal_dir").alias("to_dir"))
    cos = F.abs(sum(_dir(k, "own_dir") * _dir(k, "to_dir") for k in range(3)))
    met = met.join(other, ["scan_id", "to_x", "to_y", "to_z"], "left")
    return met.groupBy(*KEY).agg(F.first("fa").alias("fa"), F.coalesce(F.bool_or(cos >= math.cos(math.radians(angle))), F.lit(False)).alias("agree"))


def fixel_coherence(dti: DataFrame, angle: float = 15.0, quantile: float = 0.1, voxel_mm: tuple[float, float, float] = (1.0, 1.0, 1.0), apart: float = 0.05) -> DataFrame:
    """scan_id, coherence, elasticity, n_evaluated, n_connected, fa_threshold: whether directions continue one step along themselves.

    dti: key, fa and principal_dir, a unit vector along the voxel axes. Voxels below the
    `quantile` of anisotropies aren't evaluated. Of those that are, a voxel is connected if the one a lattice step forward or
    backward agrees within `angle` degrees; coherence is their share by anisotropy. elasticity: its logarithm's slope
    over that of the threshold, between thresholds `apart` below and above.
    """
    some = evaluated(dti, quantile)
    share = lambda: F.try_divide(F.sum(F.when(F.col("agree"), F.col("fa")).otherwise(0.0)), F.sum("fa"))
    cuts = some.select("scan_id", "cut").distinct()
    out = _connected(some, angle, voxel_mm).groupBy("scan_id").agg(share().alias("coherence"), F.count(F.lit(1)).alias("n_evaluated"), F.count(F.when(F.col("agree"), 1)).alias("n_connected"))
    for name, factor in (("lower", 1 - apart), ("higher", 1 + apart)):
        part = dti.join(cuts, "scan_id").where((F.col("fa") > 0) & (F.col("fa") >= F.col("cut") * factor))
        out = out.join(_connected(part, angle, voxel_mm).groupBy("scan_id").agg(share().alias(name)), "scan_id", "left")
    slope = F.when((F.col("lower") > 0) & (F.col("higher") > 0), (F.log("higher") - F.log("lower")) / math.log((1 + apart) / (1 - apart)))
    return out.join(cuts, "scan_id").select("scan_id", "coherence", slope.alias("elasticity"), "n_evaluated", "n_connected", F.col("cut").alias("fa_threshold"))


def _ends(some: DataFrame, by: list[str], angle: float, voxel_mm: tuple[float, float, float]) -> DataFrame:
    """by, x, y, z, end, best: each voxel's best-aligned neighbour on either end of its direction."""
    offsets = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
    mm = lambda t: [c * m for c, m in zip(t, voxel_mm)]
    o = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip(("dx", "dy", "dz"), t)], *[F.lit(c).alias(n) for n, c in zip(("mx", "my", "mz"), mm(t))], F.lit(math.sqrt(sum(c * c for c in mm(t)))).alias("len")) for t in offsets])
    near = some.withColumn("o", F.explode(o))
    ahead = sum(_dir(k) * F.col(f"o.{n}") for k, n in enumerate(("mx", "my", "mz"))) / F.col("o.len")
    near = near.withColumn("ahead", ahead).where(F.abs("ahead") >= math.cos(math.radians(60)))
    near = near.select(*by, "x", "y", "z", F.col("principal_dir").alias("own_dir"), "ahead", "o.len", *[(F.col(n) + F.col(f"o.d{n}")).cast("int").alias(f"to_{n}") for n in "xyz"])
    other = some.select(*by, *[F.col(n).alias(f"to_{n}") for n in "xyz"], F.col("principal_dir").alias("to_dir"))
    met = near.hint("merge").join(other, [*by, "to_x", "to_y", "to_z"])
    cos = F.abs(sum(_dir(k, "own_dir") * _dir(k, "to_dir") for k in range(3)))
    met = met.withColumn("cos", cos).where(F.col("cos") >= math.cos(math.radians(angle)))
    return met.groupBy(*by, "x", "y", "z", (F.col("ahead") > 0).alias("end")).agg(F.max(F.struct(F.col("cos") * F.abs("ahead"), F.struct("to_x", "to_y", "to_z").alias("to"), "len")).alias("best"))


def _links(some: DataFrame, by: list[str], angle: float, voxel_mm: tuple[float, float, float]) -> DataFrame:
    """by, a, b, len: mutual best links, kept where both ends choose each other."""
    ends = _ends(some, by, angle, voxel_mm)
    chosen = checkpointed(ends.select(*by, F.struct("x", "y", "z").alias("a"), F.struct(*[F.col(f"best.to.to_{n}").alias(n) for n in "xyz"]).alias("b"), "best.len"))
    back = chosen.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    return chosen.hint("merge").join(back, [*by, "a", "b"]).where("a < b").distinct()


def _chains(some: DataFrame, by: list[str], angle: float, voxel_mm: tuple[float, float, float], long_mm: float, rounds: int = 60) -> DataFrame:
    """by, chain_length, share_long of the chains that the voxels of `some` form.

    A voxel's label is one of its chain's voxels. Each round gives every label's own voxel the least label
    that stands beside it, and every voxel its label's label, so chains of any length settle in a number
    of rounds that follows the logarithm of their length. Rounds are written; labels that don't settle are an error.
    Joins are hinted: places and tables' names are written in a small part of their size in memory, so Spark would send them all to the driver.
    """
    links = checkpointed(_links(some, by, angle, voxel_mm))
    both = links.select(*by, "a", "b").union(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    label = some.select(*by, F.struct("x", "y", "z").alias("a"), "fa").withColumn("root", F.col("a"))
    for _ in range(rounds):
        own, other = label.select(*by, "a", F.col("root").alias("ra")), label.select(*by, F.col("a").alias("b"), F.col("root").alias("rb"))
        met = both.hint("merge").join(own, [*by, "a"]).hint("merge").join(other, [*by, "b"]).where("rb < ra")
        lower = checkpointed(met.groupBy(*by, F.col("ra").alias("root")).agg(F.min("rb").alias("low")))
        if lower.isEmpty():
            break
        label = label.hint("merge").join(lower, [*by, "root"], "left").select(*by, "a", "fa", F.coalesce("low", "root").alias("root"))
        hop = label.select(*by, F.col("a").alias("root"), F.col("root").alias("further"))
        label = label.hint("merge").join(hop, [*by, "root"], "left").select(*by, "a", "fa", F.least("root", F.coalesce("further", "root")).alias("root"))
        label = checkpointed(label)
    else:
        raise RuntimeError(f"chains did not settle in {rounds} rounds")
    length = links.hint("merge").join(label, [*by, "a"]).groupBy(*by, "root").agg(F.sum("len").alias("mm"))
    each = label.hint("merge").join(length, [*by, "root"], "left").withColumn("mm", F.coalesce("mm", F.lit(0.0)))
    return each.groupBy(*by).agg((F.sum(F.col("fa") * F.col("mm")) / F.sum("fa")).alias("chain_length"), (F.sum(F.when(F.col("mm") >= long_mm, F.col("fa")).otherwise(0.0)) / F.sum("fa")).alias("share_long"))


def chain_lengths(dti: DataFrame, voxel_mm: tuple[float, float, float] = (1.0, 1.0, 1.0), angle: float = 15.0, quantile: float = 0.1, long_mm: float = 20.0) -> DataFrame:
    """scan_id, chain_length (weighted by anisotropy, mm), share_long: chains of voxels that choose each other along their directions.

    Voxels below the `quantile` of anisotropies aren't evaluated; a voxel without a link is a chain of length 0.
    """
    return _chains(evaluated(dti, quantile), ["scan_id"], angle, voxel_mm, long_mm)


def table_candidates() -> list[tuple[str, tuple[int, int, int], tuple[int, int, int]]]:
    """The 24 axis permutations and flips that differ beyond a common sign: name such as 012 or 012fx, permutation, signs."""
    from itertools import permutations

    flips = (("", (1, 1, 1)), ("fx", (-1, 1, 1)), ("fy", (1, -1, 1)), ("fz", (1, 1, -1)))
    return [("".join(map(str, perm)) + name, perm, sign) for perm in permutations(range(3)) for name, sign in flips]


CURRENT = "012"


def gradient_table_check(dti: DataFrame, voxel_mm: tuple[float, float, float] = (1.0, 1.0, 1.0), angle: float = 15.0, quantile: float = 0.9) -> DataFrame:
    """scan_id, table, score for the 24 candidates: the mean chain length that each candidate's directions give, over voxels of the top anisotropies."""
    tables = F.array(*[F.struct(F.lit(n).alias("table"), F.array(*[F.lit(p) for p in perm]).alias("p"), F.array(*[F.lit(float(s)) for s in sign]).alias("s")) for n, perm, sign in table_candidates()])
    each = evaluated(dti, quantile).withColumn("t", F.explode(tables))
    turned = F.transform(F.col("t.p"), lambda p, k: F.get("principal_dir", p) * F.get(F.col("t.s"), k))
    each = each.select(*KEY, "t.table", "fa", turned.alias("principal_dir"))
    return _chains(checkpointed(each), ["scan_id", "table"], angle, voxel_mm, 20.0).select("scan_id", "table", F.col("chain_length").alias("score"))


def table_ratio(scores: DataFrame) -> DataFrame:
    """scan_id, best, current_is_best, gradient_table_ratio from gradient_table_check's rows; at equal scores the current table is the best."""
    order = F.struct("score", (F.col("table") == CURRENT).alias("now"), "table")
    best = scores.groupBy("scan_id").agg(F.max(order).alias("b"), F.max(F.when(F.col("table") == CURRENT, F.col("score"))).alias("now"))
    return best.select("scan_id", F.col("b.table").alias("best"), (F.col("b.table") == CURRENT).alias("current_is_best"), F.when(F.col("now") > 0, F.col("b.score") / F.col("now")).alias("gradient_table_ratio"))


def warnings(row: DataFrame) -> DataFrame:
    """scan_id, warnings from a report row; masked values are preferred where there are any."""
    low = lambda c, t: F.coalesce(F.isnan(c) | (c < t), F.lit(False))
    ndc_, contrast = F.coalesce("ndc_masked", "ndc"), F.coalesce("dwi_contrast_ratio_masked", "dwi_contrast_ratio")
    parts = [F.when(low(ndc_, 0.4), "low neighbour correlation"), F.when(low(contrast, 1.1), "low contrast between directions"), F.when(F.col("gradient_table_ratio") > 1, "another gradient table fits better")]
    return row.select("scan_id", F.filter(F.array(*parts), lambda w: w.isNotNull()).alias("warnings"))


#: The report's columns in order, and what they hold.
COLUMNS = {
    "dimension_x": "voxels along x", "dimension_y": "voxels along y", "dimension_z": "voxels along z",
    "voxel_size_x": "voxel size along x, mm", "voxel_size_y": "voxel size along y, mm", "voxel_size_z": "voxel size along z, mm",
    "max_b": "largest b-value, s/mm2", "n_dwi_volumes": "weighted volumes", "n_b0_volumes": "unweighted volumes",
    "ndc": "mean correlation of neighbouring weighted volumes", "ndc_masked": "the same within the mask",
    "dwi_contrast_ratio": "neighbour over contrast correlation", "dwi_contrast_ratio_masked": "the same within the mask",
    "n_outlier_slices": "slices that stand out from both neighbours", "fixel_coherence": "anisotropy-weighted agreement of directions one step along them",
    "fixel_chain_length": "anisotropy-weighted length of direction chains, mm", "gradient_table_ratio": "best over current gradient table score",
}


def assess(voxels: DataFrame, gradient: DataFrame, voxel_mm: tuple[float, float, float] = (1.0, 1.0, 1.0), dti: DataFrame | None = None, o: SliceOptions = SliceOptions()) -> DataFrame:
    """One row per scan with COLUMNS; those that need a tensor fit are null without one."""
    shape = voxels.groupBy("scan_id").agg(*[(F.max(a) + 1).cast("double").alias(f"dimension_{a}") for a in "xyz"])
    size = shape.withColumns({f"voxel_size_{a}": F.lit(float(m)) for a, m in zip("xyz", voxel_mm)})
    counts = gradient.groupBy("scan_id").agg(F.max("bval").alias("max_b"), F.count(F.when(F.col("bval") > 50, 1)).cast("double").alias("n_dwi_volumes"), F.count(F.when(F.col("bval") <= 50, 1)).cast("double").alias("n_b0_volumes"))
    r = correlation_report(voxels, gradient)
    r = r.withColumnsRenamed({"contrast_ratio": "dwi_contrast_ratio", "contrast_ratio_masked": "dwi_contrast_ratio_masked"})
    slices = outlier_slices(voxels, o).groupBy("scan_id").agg(F.count(F.when(F.col("outlier"), 1)).cast("double").alias("n_outlier_slices"))
    out = size.join(counts, "scan_id", "left").join(r, "scan_id", "left").join(slices, "scan_id", "left").withColumn("n_outlier_slices", F.coalesce("n_outlier_slices", F.lit(0.0)))
    if dti is not None:
        out = out.join(fixel_coherence(dti, voxel_mm=voxel_mm).select("scan_id", F.col("coherence").alias("fixel_coherence")), "scan_id", "left")
        out = out.join(chain_lengths(dti, voxel_mm).select("scan_id", F.col("chain_length").alias("fixel_chain_length")), "scan_id", "left")
        out = out.join(table_ratio(gradient_table_check(dti, voxel_mm)).select("scan_id", "gradient_table_ratio"), "scan_id", "left")
    missing = {c: F.lit(None).cast("double") for c in COLUMNS if c not in out.columns}
    return out.withColumns(missing).select("scan_id", *COLUMNS)


def input_quality(voxels: DataFrame, gradient: DataFrame) -> DataFrame:
    """scan_id, ndc, dwi_contrast, summary, warnings within the mask: what a fit says about its input before it starts."""
    r = correlation_report(voxels.where("in_mask"), gradient, masked=False).select("scan_id", "ndc", F.col("contrast_ratio").alias("dwi_contrast"))
    shown = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("n/a"))
    grade = F.when(F.col("dwi_contrast").isNull(), "").otherwise(F.concat(F.lit(" ("), contrast_grade(F.col("dwi_contrast")), F.lit(")")))
    low = lambda c, t: F.coalesce(F.isnan(c) | (F.col(c) < t), F.lit(False))
    said = F.filter(F.array(F.when(low("ndc", 0.4), "low neighbour correlation"), F.when(low("dwi_contrast", 1.1), "low contrast between directions")), lambda w: w.isNotNull())
    return r.select("scan_id", "ndc", "dwi_contrast", F.concat(F.lit("NDC "), shown("ndc"), F.lit(", DWI contrast "), shown("dwi_contrast"), grade).alias("summary"), said.alias("warnings"))
