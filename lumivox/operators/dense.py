"""Dense-b responses of any number of scans: samples on one scale a scan, rows on a grid of b-values.

All tissues of a scan are divided by one number, the upper median of the unweighted signal of its single-fibre white matter, so
that what tissues differ in without weighting stays in their rows. Samples are summed where they are; what is solved for a
scan's tissue has as many rows as the grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.operators import order_stats as O
from lumivox.operators import solvers, tissue
from lumivox.operators.models import B0, effective_table_column, nominal_table_column
from lumivox.operators.voxel import KEY

SQRT4PI = float(np.sqrt(4 * np.pi))
RESPONSE = "scan_id string, tissue string, row int, b double, coeffs array<double>"
#: What a second difference weighs where no data are near, and what pins an unweighted row.
GAP_TENSION, PIN = 1e-3, 1e6


def unweighted_mean(bvals: np.ndarray) -> Column:
    """The mean of a voxel's unweighted samples."""
    at = np.flatnonzero(bvals <= B0)
    return sum((F.get("signal", F.lit(int(v))).cast("double") for v in at), F.lit(0.0)) / float(len(at))


def levels(selected: DataFrame, bvals: np.ndarray, reference: str = "wm") -> DataFrame:
    """scan_id, tissue, reference, level: the scan's reference signal, and the tissue's mean unweighted signal over it.

    selected: scan_id, tissue and signal of the voxels of each tissue. The reference is the upper median over the tissue of that
    name; the means leave out voxels without a positive unweighted signal. A scan whose reference isn't positive has no row.
    """
    b0 = selected.select("scan_id", "tissue", unweighted_mean(bvals).alias("b0"))
    ref = O.upper_median(b0.where(F.col("tissue") == reference), ["scan_id"], "b0").withColumnRenamed("median", "reference").where("reference > 0")
    means = b0.where("b0 > 0").groupBy("scan_id", "tissue").agg(F.avg("b0").alias("mean"))
    return means.join(ref, "scan_id").select("scan_id", "tissue", "reference", (F.col("mean") / F.col("reference")).alias("level"))


def pooled_samples(selected: DataFrame, of: DataFrame, bvals: np.ndarray, directions: np.ndarray, weighted: bool = True, rotation: np.ndarray | None = None) -> DataFrame:
    """scan_id, tissue, level, b, cos, y, s0: every sample of the selected voxels, or every weighted one, over the scan's reference.

    of: what levels() gives. cos is to principal_dir, 1 where there is none; s0 is the voxel's own unweighted signal over the reference.
    A column `graddev` (9 numbers) puts a voxel's samples at the b-values and directions that it saw itself; rotation: from the voxel
    grid's axes, in which deviations are, to those of the directions.
    """
    own = effective_table_column(F.col("graddev"), bvals, directions, rotation) if "graddev" in selected.columns else nominal_table_column(bvals, directions)
    axis = F.col("principal_dir") if "principal_dir" in selected.columns else F.lit(None).cast("array<double>")
    each = selected.withColumn("_b0", unweighted_mean(bvals)).where("_b0 > 0").join(of, ["scan_id", "tissue"])
    each = each.select("scan_id", "tissue", "level", "reference", "_b0", axis.alias("axis"), F.explode(F.arrays_zip(F.col("signal").alias("s"), own.alias("t"))).alias("p"))
    if weighted:
        each = each.where(F.col("p.t.weighted"))
    dot = F.abs(sum((F.get("p.t.g", F.lit(k)) * F.get("axis", F.lit(k)).cast("double") for k in range(3)), F.lit(0.0)))
    cos = F.coalesce(F.least(dot, F.lit(1.0)), F.lit(1.0))
    return each.select("scan_id", "tissue", "level", F.col("p.t.b").alias("b"), cos.alias("cos"), (F.col("p.s").cast("double") / F.col("reference")).alias("y"), (F.col("_b0") / F.col("reference")).alias("s0"))


def shapes(samples: DataFrame) -> DataFrame:
    """Samples over their own voxel's unweighted signal, times the tissue's level, and the squares of those signals as weights w.

    So a voxel counts by its signal as before, but its brightness isn't mixed with the decay where rows are informed by other voxels.
    """
    return samples.withColumns({"y": F.col("y") / F.col("s0") * F.col("level"), "w": F.col("s0") * F.col("s0")})


def grid(b_max: float, step: float) -> np.ndarray:
    """Multiples of the step, from 0 to the first that reaches b_max."""
    return np.arange(int(np.ceil(b_max / step - 1e-9)) + 1) * step


def _zonal(lmax: int) -> list[Column]:
    """Zonal harmonics of even order at `cos`."""
    return [F.lit(float(np.sqrt((2 * l + 1) / (4 * np.pi)))) * tissue._legendre_column(l, F.col("cos")) for l in range(0, lmax + 1, 2)]


def _rows(key: tuple, step: float, coefficients: np.ndarray) -> pd.DataFrame:
    n = len(coefficients)
    return pd.DataFrame({"scan_id": key[0], "tissue": key[1], "row": np.arange(n, dtype=np.int32), "b": np.arange(n) * float(step), "coeffs": list(coefficients)})


def _moments(found: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal matrices and right sides of each row, from their columns g<i>_<j> and r<i>."""
    g = np.stack([np.stack([found[f"g{min(i, j)}_{max(i, j)}"].to_numpy() for j in range(size)], 1) for i in range(size)], 1)
    return g, np.stack([found[f"r{i}"].to_numpy() for i in range(size)], 1)


def kernel_rows(samples: DataFrame, b_max: float, lmax: int = 8, step: float = 50.0, sigma: float = 150.0, share: float = 0.05, anisotropic: str = "wm") -> DataFrame:
    """Rows by a Gaussian window in b over samples of weight 1; unweighted rows are the tissue's level.

    The tissue named `anisotropic` has zonal coefficients up to lmax, others their mean; its rows of less than `share` of the
    average row's weight take the row before, as others' rows without any weight do. Samples are summed by b before they meet the grid.
    """
    x, bs = _zonal(lmax), grid(b_max, step)
    most = len(x)
    moment = lambda i, j: F.sum(x[i] * x[j]).alias(f"g{i}_{j}")
    names = [f"g{i}_{j}" for i in range(len(x)) for j in range(i, len(x))] + [f"r{i}" for i in range(len(x))]
    by_b = samples.groupBy("scan_id", "tissue", "level", "b").agg(*[moment(i, j) for i in range(len(x)) for j in range(i, len(x))], *[F.sum(c * F.col("y")).alias(f"r{i}") for i, c in enumerate(x)], F.count(F.lit(1)).alias("n"))
    near = F.exp(-((F.col("b") - F.col("row") * F.lit(float(step))) ** 2) / (2 * sigma * sigma))
    on = by_b.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(len(bs) - 1))))
    sums = on.groupBy("scan_id", "tissue", "level", "row").agg(*[F.sum(near * F.col(c)).alias(c) for c in names], F.sum(near * F.col("n")).alias("w"), F.sum("n").alias("n"))

    def solve(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("row")
        wide = key[1] == anisotropic
        size = most if wide else 1
        g, r = _moments(found, size)
        w, level = found["w"].to_numpy(), float(found["level"].iloc[0])
        least = share * float(found["n"].iloc[0]) / len(bs) if wide else 1e-12
        out = np.zeros((len(bs), size))
        for k, b in enumerate(bs):
            if b <= B0:
                out[k, 0] = level * SQRT4PI
            elif w[k] < least or not w[k] > 0:
                out[k] = out[k - 1]
            elif np.linalg.cond(g[k]) < 1e13:
                out[k] = np.linalg.solve(g[k], r[k])
        return _rows(key, step, out)

    return sums.groupBy("scan_id", "tissue").applyInPandas(solve, RESPONSE)  # as many rows as the grid has


def smooth_rows(samples: DataFrame, b_max: float, lmax: int = 8, step: float = 50.0, smoothing_b: float = 150.0, anisotropic: str = "wm") -> DataFrame:
    """All rows of a tissue in one constrained least squares: linear in b between them, second differences held small where data are near.

    samples: of shapes(). First coefficients aren't negative and don't rise with b, higher ones alternate in sign; unweighted rows
    are pinned to the level.
    """
    bs, x = grid(b_max, step), _zonal(lmax)
    n, most = len(bs), len(x)
    if n < 3:
        raise ValueError("the grid needs three rows")
    k = F.greatest(F.least(F.floor(F.col("b") / step), F.lit(n - 2)), F.lit(0)).cast("int")
    t = F.least(F.col("b") / step - F.col("k"), F.lit(1.0))
    both = [*[(1 - F.col("t")) * c for c in x], *[F.col("t") * c for c in x]]
    sums = [F.sum(F.col("w") * both[i] * both[j]).alias(f"g{i}_{j}") for i in range(2 * most) for j in range(i, 2 * most)] + [F.sum(F.col("w") * both[i] * F.col("y")).alias(f"r{i}") for i in range(2 * most)]
    met = samples.where(F.col("b") > B0).withColumn("k", k).withColumn("t", t).groupBy("scan_id", "tissue", "level", "k").agg(*sums)

    def solve(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        width, level = most if key[1] == anisotropic else 1, float(found["level"].iloc[0])
        g, r = _moments(found, 2 * most)
        pick = np.concatenate([np.arange(width), most + np.arange(width)])
        gram, rhs = np.zeros((n * width, n * width)), np.zeros(n * width)
        for interval, gk, rk in zip(found["k"], g, r):
            at = np.concatenate([interval * width + np.arange(width), (interval + 1) * width + np.arange(width)])
            gram[np.ix_(at, at)] += gk[np.ix_(pick, pick)]
            rhs[at] += rk[pick]
        return _rows(key, step, smooth_solution(gram, rhs, bs, level, smoothing_b / step))

    return met.groupBy("scan_id", "tissue").applyInPandas(solve, RESPONSE)  # as many rows as the grid has intervals


def smooth_solution(gram: np.ndarray, rhs: np.ndarray, bs: np.ndarray, level: float, sigma_rows: float) -> np.ndarray:
    """The constrained rows from their data's normal equations; sigma_rows: the smoothing length in rows.

    A row's second difference weighs by the data within that length, so sampled rows are pooled over it and gaps only bridged.
    """
    n = len(bs)
    width = len(rhs) // n
    data = np.diag(gram).reshape(n, width).sum(1)
    sampled = data > 1e-9 * data.max()
    if not data.max() > 0:
        raise ValueError("no weighted samples")
    unit = data[sampled].mean() / width
    gram, rhs, weight = gram / unit, rhs / unit, data / unit / width
    apart = np.arange(n)[:, None] - np.arange(n)[None]
    window = np.where(np.abs(apart) <= np.ceil(3 * sigma_rows), np.exp(-0.5 * (apart / sigma_rows) ** 2), 0)
    tension = (0.85 * sigma_rows) ** 4 * (window @ weight) / window.sum(1) + GAP_TENSION
    second = np.zeros((n - 2, n))
    for i in range(n - 2):
        second[i, i : i + 3] = (1, -2, 1)
    gram = gram + np.kron(second.T @ (tension[1:-1, None] * second), np.eye(width))
    pinned = bs <= B0
    for k in np.flatnonzero(pinned):
        at = k * width + np.arange(width)
        gram[at, at] += PIN
        rhs[k * width] += PIN * level * SQRT4PI
    rows = []
    for k in np.flatnonzero(~pinned):
        for c in range(width):
            e = np.zeros(n * width)
            e[k * width + c] = 1.0 if c % 2 == 0 else -1.0
            rows.append(e)
        e = np.zeros(n * width)
        e[(k - 1) * width], e[k * width] = 1.0, -1.0
        rows.append(e)
    scale = np.abs(np.diag(gram)).max()
    qp = solvers.Inequality(None, np.array(rows), gram=gram / scale, max_iter=100_000, epsilon=1e-9)
    return qp.solve_moments((rhs / scale)[None])[0][0].reshape(n, width)


def kurtosis_rows(samples: DataFrame, b_max: float, lmax: int = 8, step: float = 50.0, anisotropic: str = "wm") -> DataFrame:
    """Rows of a parametric decay fitted to each tissue's samples, unweighted ones included.

    samples: of shapes(), with all volumes. They are pooled by b to the next whole number and by the angle's cosine to two digits, so that a fit reads a bounded number.
    """
    bins = samples.groupBy("scan_id", "tissue", F.round("b").alias("bin"), F.round("cos", 2).alias("at"))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    pooled = bins.agg(mean("b"), mean("cos"), mean("y"), F.sum("w").alias("w"))
    bs = grid(b_max, step)

    def solve(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        wide = key[1] == anisotropic
        s = s.sort_values(["b", "cos"])
        fit = tissue.fit_kurtosis(*(s[c].to_numpy() for c in ("b", "cos", "y", "w")), isotropic=not wide)
        return _rows(key, step, tissue.kurtosis_rows(fit, bs, lmax if wide else 0))

    return pooled.groupBy("scan_id", "tissue").applyInPandas(solve, RESPONSE)


def responses(selected: DataFrame, bvals: np.ndarray, directions: np.ndarray, estimator: str = "kernel", lmax: int = 8, step: float = 50.0, b_max: float | None = None, rotation: np.ndarray | None = None, reference: str = "wm") -> DataFrame:
    """scan_id, tissue, row, b, coeffs on the grid k * step, two steps beyond the largest b-value, for every scan and tissue in `selected`.

    selected: scan_id, tissue, signal, for the reference tissue principal_dir, and graddev where voxels have tables of their own.
    b_max: the largest effective b-value, if above the table's.
    """
    if estimator not in ("kernel", "smooth", "kurtosis"):
        raise ValueError("an estimator is kernel, smooth or kurtosis")
    samples = pooled_samples(selected, levels(selected, bvals, reference), bvals, directions, estimator != "kurtosis", rotation)
    top = max(float(bvals.max()), b_max or 0.0) + 2 * step
    if estimator == "kernel":
        return kernel_rows(samples, top, lmax, step, anisotropic=reference)
    return (smooth_rows if estimator == "smooth" else kurtosis_rows)(shapes(samples), top, lmax, step, anisotropic=reference)


def b_shift(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, q: float = 0.95, rotation: np.ndarray | None = None) -> DataFrame:
    """scan_id, largest, shift: the largest effective b-value of the voxels in the mask, at least the table's, and the q quantile of how far deviations move weighted ones.

    rotation: as in pooled_samples().
    """
    t = F.explode(effective_table_column(F.col("graddev"), bvals, directions, rotation)).alias("t")
    at = F.array(*[F.lit(float(b)) for b in bvals])
    each = voxels.where("in_mask").select("scan_id", t).where(F.col("t.weighted")).select("scan_id", F.col("t.b").alias("b"), F.abs(F.col("t.b") - F.get(at, F.col("t.vol"))).alias("off"))
    largest = each.groupBy("scan_id").agg(F.greatest(F.max("b"), F.lit(float(bvals.max()))).alias("largest"))
    return largest.join(O.nearest_rank(each, ["scan_id"], "off", {"shift": q}), "scan_id")


def union_of(selection: tissue.Selection, voxels: DataFrame, dti: DataFrame) -> DataFrame:
    """What responses() takes, of a selection's voxels."""
    keys = [df.select(*KEY, F.lit(name).alias("tissue")) for name, df in (("wm", selection.wm), ("gm", selection.gm), ("csf", selection.csf))]
    some = keys[0].union(keys[1]).union(keys[2])
    return some.join(voxels.select(*KEY, "signal", *(["graddev"] if "graddev" in voxels.columns else [])), KEY).join(dti.select(*KEY, "principal_dir"), KEY, "left")
