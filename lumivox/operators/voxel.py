"""Masks, predicates, projections and set operations on voxel rows; see the schemas in sources.schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["scan_id", "x", "y", "z"]
B0_THRESHOLD = 50.0


def masked(voxels: DataFrame) -> DataFrame:
    """Voxels in the mask."""
    return voxels.where("in_mask")


def long_view(voxels: DataFrame) -> DataFrame:
    """A row per voxel and volume: key, vol, value."""
    return voxels.select(*KEY, *[c for c in ("in_mask", "label") if c in voxels.columns], F.posexplode("signal").alias("vol", "value"))


def is_b0(bval: Column, threshold: float = B0_THRESHOLD) -> Column:
    return bval <= threshold


def mean_b0(bvals: list[float], threshold: float = B0_THRESHOLD) -> Column:
    """Mean of the unweighted volumes of `signal`, of all volumes if there are none, accumulated in single precision as stored data are."""
    at = [i for i, b in enumerate(bvals) if b <= threshold] or list(range(len(bvals)))
    total = reduce(lambda a, i: (a + F.get("signal", F.lit(i)).cast("float")).cast("float"), at, F.lit(0.0).cast("float"))
    return (total / F.lit(float(len(at))).cast("float")).cast("float")


def fallback_mask(voxels: DataFrame, bvals: list[float], threshold: float = B0_THRESHOLD, share: float = 0.01) -> DataFrame:
    """in_mask set where the mean unweighted signal is above `share` of the scan's largest one."""
    b0 = voxels.withColumn("b0", mean_b0(bvals, threshold).cast("double"))
    top = b0.groupBy("scan_id").agg(F.max("b0").alias("top"))
    return b0.join(top, "scan_id").withColumn("in_mask", F.col("b0") > share * F.col("top")).drop("top")


def any_nonzero(coef: Column) -> Column:
    return F.exists(coef, lambda c: c != 0)


def erode(voxels: DataFrame, passes: int = 1) -> DataFrame:
    """Voxels of the mask that stay after `passes` erosions by their six face neighbours.

    A voxel without a row counts as outside the mask, so the grid's border goes.
    One shuffle a pass: each voxel is sent to itself and its neighbours, and
    stays where seven arrive.
    """
    kept = masked(voxels).select(*KEY)
    shifts = F.array(*[F.struct(*[F.lit(d[k]).alias(a) for k, a in enumerate(("dx", "dy", "dz"))]) for d in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    for _ in range(passes):
        sent = kept.select("*", F.explode(shifts).alias("d"))
        sent = sent.select("scan_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), (F.col("z") + F.col("d.dz")).alias("z"))
        kept = sent.groupBy(*KEY).count().where(F.col("count") == 7).drop("count")
    return kept


def select_where(mask: DataFrame, predicate: Column) -> DataFrame:
    return mask.where(predicate)


def projected(voxels: DataFrame, value: Column, name: str) -> DataFrame:
    """`value` inside the mask and 0 outside."""
    return voxels.select(*KEY, F.when(F.col("in_mask"), value).otherwise(0.0).alias(name))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_anti")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite(voxels: DataFrame, name: str, nonzero: bool = False) -> DataFrame:
    """Voxels of the mask with a finite value, by choice a non-zero one."""
    ok = is_finite(F.col(name)) & F.col("in_mask")
    return voxels.where(ok & (F.col(name) != 0) if nonzero else ok)


def without_degenerate(dti: DataFrame) -> DataFrame:
    """Tensor rows but those all zero, which a failed fit leaves."""
    return dti.where(~((F.col("s0") == 0) & (F.col("fa") == 0) & (F.col("md") == 0)))


def gather(features: DataFrame, mask: DataFrame) -> DataFrame:
    """Feature rows of the voxels in `mask`; voxels without features drop out."""
    return features.join(mask.select(*KEY), KEY)


def voxel_size(affine: list[list[float]]) -> list[float]:
    """Column norms of the affine's 3 x 3 part, in mm."""
    return [sum(affine[r][c] ** 2 for r in range(3)) ** 0.5 for c in range(3)]


def canonical_axes(affine: list[list[float]]) -> list[tuple[int, int]]:
    """For each output axis (to the right, front and top) the input axis and its sign, by the largest share of each column."""
    left, out = {0, 1, 2}, [None] * 3
    order = sorted(((abs(affine[r][c]) / (voxel_size(affine)[c] or 1), r, c) for r in range(3) for c in range(3)), key=lambda t: (-t[0], t[1], t[2]))
    for _, r, c in order:
        if out[r] is None and c in left:
            out[r] = (c, 1 if affine[r][c] >= 0 else -1)
            left.remove(c)
    return out


def canonical(voxels: DataFrame, affine: list[list[float]], shape: tuple[int, int, int]) -> tuple[DataFrame, list[list[float]]]:
    """Voxels on axes that run right, front and top, and the affine to match; values stay as they are."""
    axes, names = canonical_axes(affine), ("x", "y", "z")
    at = lambda c, sign: F.col(names[c]) if sign > 0 else F.lit(shape[c] - 1) - F.col(names[c])
    moved = voxels.select("scan_id", *[at(c, s).cast("int").alias(n) for n, (c, s) in zip(names, axes)], *[c for c in voxels.columns if c not in KEY])
    new = [[affine[r][c] * s for c, s in axes] + [affine[r][3] + sum(affine[r][c] * (shape[c] - 1) for c, s in axes if s < 0)] for r in range(3)]
    return moved, [*new, [0.0, 0.0, 0.0, 1.0]]


def sparsity(coef: Column) -> Column:
    """The share of coefficients that are not 0."""
    return F.size(F.filter(coef, lambda c: c != 0)) / F.size(coef)


def rmse(residual_l2: Column, n: Column | int) -> Column:
    return residual_l2 / F.sqrt(F.lit(n) if isinstance(n, int) else n)
