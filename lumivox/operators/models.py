"""Voxel-wise fits and projections: tensors, oscillator-basis coefficients, synthesis, propagator scalars, densities and peaks.

A plan (matrices, factors) is made once on the driver and broadcast; tasks take
Arrow batches of voxel rows as one matrix. Spark filters the mask and prunes
columns before anything reaches Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.functions import numeric as N
from lumivox.operators import solvers
from lumivox.operators.voxel import KEY

KEY_SCHEMA = "scan_id string, x int, y int, z int"
REGULARISATION = {"l1": 1, "l2": 2, "nonneg": 3}


def map_rows(df: DataFrame, columns: list[str], f: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """KEY and what f gives for the stacked array columns, batch by batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = f(*(np.stack(b[c].to_numpy()).astype(np.float64) if isinstance(b[c].iloc[0], (list, np.ndarray)) else b[c].to_numpy(dtype=np.float64) for c in columns))
                yield pd.DataFrame({k: b[k] for k in KEY} | {n: (list(out[n]) if np.ndim(out[n]) > 1 else out[n]) for n in names})

    return df.select(*KEY, *columns).mapInPandas(run, f"{KEY_SCHEMA}, {schema}")


@dataclass(frozen=True)
class TensorOptions:
    max_iter: int = 50
    tol: float = 1e-6
    outlier: float = 0.04
    min_signal: float = 1e-6


#: b-values up to here count as unweighted.
B0 = 50.0

DTI = "s0 float, fa float, md float, outlier_fraction float, tensor array<float>, principal_dir array<float>, evals array<double>, iterations int, converged boolean"


def fit_tensor(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, o: TensorOptions = TensorOptions()) -> DataFrame:
    """Robust tensor fits of the voxels in the mask; zeros where there is no definite system."""
    shared = voxels.sparkSession.sparkContext.broadcast(solvers.tensor_design(bvals, directions))
    return map_rows(voxels.where("in_mask"), ["signal"], lambda s: solvers.robust_tensor(s, shared.value, o.max_iter, o.tol, o.outlier, o.min_signal), DTI)


def fit_tensor_graddev(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, o: TensorOptions = TensorOptions()) -> DataFrame:
    """The same with a table per voxel, from the column `graddev` (9 numbers, rows first)."""

    def fit(s: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
        parts = []
        for k in range(len(s)):
            b, g = effective_table(bvals, directions, t[k].reshape(3, 3))
            parts.append(solvers.robust_tensor(s[[k]], solvers.tensor_design(b, g), o.max_iter, o.tol, o.outlier, o.min_signal))
        return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

    return map_rows(voxels.where("in_mask"), ["signal", "graddev"], fit, DTI)


def effective_table(bvals: np.ndarray, directions: np.ndarray, t: np.ndarray, b0_threshold: float = B0, rotation: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """b-values and directions that a voxel sees through its deviation matrix; unweighted volumes stay.

    rotation: from the voxel grid's axes, in which the matrix is, to those of the directions.
    """
    if np.abs(t - np.eye(3)).max() <= 1e-6:
        return bvals, directions
    if rotation is not None:
        t = rotation @ t @ rotation.T
    size = np.linalg.norm(directions, axis=1)
    q = directions / np.where(size > 0, size, 1)[:, None] @ t
    n = np.linalg.norm(q, axis=1)
    weighted = (bvals > b0_threshold) & (n > 0)
    return np.where(weighted, bvals * n * n, bvals), np.where(weighted[:, None], q / np.where(n > 0, n, 1)[:, None], directions)


def nominal_table_column(bvals: np.ndarray, directions: np.ndarray) -> Column:
    """array of (vol, b, g, weighted), the same for every voxel."""
    one = lambda v, b, g: F.struct(F.lit(v).alias("vol"), F.lit(float(b)).alias("b"), F.array(*[F.lit(float(x)) for x in g]).alias("g"), F.lit(bool(b > B0)).alias("weighted"))
    return F.array(*[one(v, b, g) for v, (b, g) in enumerate(zip(bvals, directions))])


def effective_table_column(graddev: Column, bvals: np.ndarray, directions: np.ndarray, rotation: np.ndarray | None = None) -> Column:
    """The same as effective_table() sees it, a null deviation being none."""
    r = np.eye(3) if rotation is None else np.asarray(rotation, dtype=float)
    size = np.linalg.norm(directions, axis=1)
    unit = directions / np.where(size > 0, size, 1)[:, None]
    grid = unit @ r  # in the voxel grid's axes
    table = F.array(*[F.struct(F.lit(v).alias("vol"), F.lit(float(b)).alias("b"), *(F.array(*[F.lit(float(x)) for x in g]).alias(n) for g, n in ((directions[v], "g"), (grid[v], "h")))) for v, b in enumerate(bvals)])
    three = F.array(*[F.lit(k) for k in range(3)])
    turn = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in r])
    seen = lambda t: F.transform(three, lambda k: sum(F.get(graddev, 3 * F.lit(i) + k).cast("double") * F.get(t.h, F.lit(i)) for i in range(3)))
    back = lambda q: F.transform(three, lambda k: sum(F.get(F.get(turn, k), F.lit(i)) * F.get(q, F.lit(i)) for i in range(3)))
    with_q = F.transform(table, lambda t: F.struct(t.vol.alias("vol"), t.b.alias("b"), t.g.alias("g"), seen(t).alias("q")))
    with_n = F.transform(with_q, lambda t: F.struct(t.vol.alias("vol"), t.b.alias("b"), t.g.alias("g"), t.q.alias("q"), F.aggregate(t.q, F.lit(0.0), lambda a, x: a + x * x).alias("n2")))
    moved = lambda t: (t.b > B0) & F.coalesce(t.n2 > 0, F.lit(False))
    eye = F.array(*[F.lit(float(x)) for x in np.eye(3).ravel()])
    off = F.exists(F.zip_with(graddev, eye, lambda a, b: F.abs(a.cast("double") - b)), lambda x: x > 1e-6)
    own = F.transform(with_n, lambda t: F.struct(t.vol.alias("vol"), F.when(moved(t), t.b * t.n2).otherwise(t.b).alias("b"), F.when(moved(t), F.transform(back(t.q), lambda x: x / F.sqrt(t.n2))).otherwise(t.g).alias("g"), (t.b > B0).alias("weighted")))
    return F.when(off, own).otherwise(nominal_table_column(bvals, directions))


def fiber_dominance(evals: Column) -> Column:
    """The largest eigenvalue over the mean of the other two."""
    rest = (F.get(evals, F.lit(1)) + F.get(evals, F.lit(2))) / 2
    return F.try_divide(F.get(evals, F.lit(0)), rest)


@dataclass(frozen=True)
class ShoreOptions:
    """regularisation: l1, l2 or nonneg; strategy, for l1: fixed, ratio, bic or l2-anchored. eps: the path's end over its start, None for 1e-3 by bic, else 1e-4."""

    order: int = 6
    zeta: float = 700.0
    regularisation: str = "l1"
    strategy: str = "l2-anchored"
    alpha: float = 1.0
    ratio: float = 1e-3
    n: int = 20
    eps: float | None = None
    slack: float = 0.05
    lambda_n: float = 1e-8
    lambda_l: float = 1e-8
    max_iter: int = 1000
    tol: float = 1e-6
    positive: bool = False
    allow_single_shell: bool = False

    @property
    def path_end(self) -> float:
        return self.eps if self.eps is not None else 1e-3 if self.strategy == "bic" else 1e-4

    def checked(self) -> ShoreOptions:
        if self.regularisation not in REGULARISATION or self.strategy not in ("fixed", "ratio", "bic", "l2-anchored"):
            raise ValueError("unknown regularisation or strategy")
        if self.n < 2 or not 0 < self.path_end < 1 or not 0 < self.ratio < 1 or self.slack < 0 or self.order < 0:
            raise ValueError("n is 2 at least, eps and ratio lie between 0 and 1, slack and order aren't negative")
        return self


SHORE = "coef array<float>, r2 float, residual_l2 float, alpha float, bic float, rss_l2 float, iterations int, reg_kind tinyint"


def shore_design(bvals: np.ndarray, directions: np.ndarray, big_delta: float, small_delta: float, o: ShoreOptions) -> np.ndarray:
    q = N.q_magnitude(bvals, N.diffusion_time(big_delta, small_delta))[:, None] * directions
    return N.shore_matrix(q, o.order, o.zeta)


def fit_shore(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, big_delta: float = 0.0431, small_delta: float = 0.0107, o: ShoreOptions = ShoreOptions()) -> DataFrame:
    """Basis coefficients of the voxels in the mask, with r2, residual, and for l1 the chosen alpha and criterion."""
    o = o.checked()
    weighted = [g for g in N.shells(list(bvals)) if g[0] > 0]
    if not weighted or (len(weighted) < 2 and not o.allow_single_shell):
        raise ValueError(f"{len(weighted)} shells don't determine the radial part")
    m = shore_design(bvals, directions, big_delta, small_delta, o)
    pn, pl = N.shore_penalties(o.order)
    ridge = o.lambda_n * pn + o.lambda_l * pl + (1e-12 if m.shape[0] < m.shape[1] else 0)
    l2, plan = solvers.Tikhonov(m, ridge), None
    if o.regularisation == "l1":
        plan = solvers.Lasso(m, o.max_iter, o.tol, o.positive)
    elif o.regularisation == "nonneg":
        amplitudes = N.sh_matrix(N.hemisphere(), o.order - o.order % 2) @ N.shore_to_odf(o.order, o.zeta)
        plan = solvers.Inequality(m, amplitudes, ridge, 1e-10, 200, 1e-9)
    shared = voxels.sparkSession.sparkContext.broadcast((m, l2, plan))

    def fit(s: np.ndarray) -> dict[str, np.ndarray]:
        m, l2, plan = shared.value
        missing, n = np.full(len(s), np.nan), len(m)
        base = l2.fit(s)
        rss_l2 = np.sum((s - base @ m.T) ** 2, axis=1)
        alpha = criterion = missing
        used = np.ones(len(s), np.int32)
        if o.regularisation == "l2":
            c, rss_l2 = base, missing
        elif o.regularisation == "nonneg":
            (c, used, _), rss_l2 = plan.solve(s), missing
        elif o.strategy in ("fixed", "ratio"):
            alpha = np.full(len(s), o.alpha) if o.strategy == "fixed" else o.ratio * plan.alpha_max(s)
            (c, used), rss_l2 = plan.fit(s, alpha), missing
            criterion = solvers.bic(np.sum((s - c @ m.T) ** 2, axis=1), n, np.count_nonzero(c, axis=1))
        else:
            r = solvers.lasso_path(plan, s, o.n, o.path_end, "bic" if o.strategy == "bic" else "l2", o.slack, rss_l2)
            c, used, alpha, criterion = r["coef"], r["iterations"], r["alpha"], r["bic"]
        rss, total = np.sum((s - c @ m.T) ** 2, axis=1), np.sum((s - s.mean(axis=1, keepdims=True)) ** 2, axis=1)
        r2 = np.where(total > 0, 1 - rss / np.where(total > 0, total, 1), 0)
        kind = np.full(len(s), REGULARISATION[o.regularisation], np.int8)
        return {"coef": c, "r2": r2, "residual_l2": np.sqrt(rss), "alpha": alpha, "bic": criterion, "rss_l2": rss_l2, "iterations": used, "reg_kind": kind}

    return map_rows(voxels.where("in_mask"), ["signal"], fit, SHORE)


def alpha_spread(fits: DataFrame) -> DataFrame:
    """Nearest-rank median, 10th and 90th percentile of the chosen alphas of each scan."""
    from lumivox.operators.order_stats import nearest_rank

    return nearest_rank(fits, ["scan_id"], "alpha", {"median": 0.5, "p10": 0.1, "p90": 0.9})


def dot(array: Column, weights: np.ndarray) -> Column:
    """The dot product of an array column with fixed weights, on the JVM."""
    at = [k for k in range(len(weights)) if weights[k] != 0]
    return sum((F.get(array, F.lit(k)).cast("double") * float(weights[k]) for k in at), F.lit(0.0))


def synthesize(fits: DataFrame, bvals: np.ndarray, directions: np.ndarray, big_delta: float = 0.0431, small_delta: float = 0.0107, o: ShoreOptions = ShoreOptions(), clip: bool = True) -> DataFrame:
    """`signal` at the given table from coefficients; rows of zeros are left out, negative values raised to 0 if clip."""
    shared = fits.sparkSession.sparkContext.broadcast(shore_design(bvals, directions, big_delta, small_delta, o))

    def predict(c: np.ndarray) -> dict[str, np.ndarray]:
        s = c @ shared.value.T
        return {"signal": np.maximum(s, 0) if clip else s}

    return map_rows(fits.where(F.exists("coef", lambda c: c != 0)), ["coef"], predict, "signal array<float>")


#: Factors to micrometres from millimetres.
MICRO = {"rtop": 1e-9, "rtap": 1e-6, "rtpp": 1e-3, "msd": 1e6, "qiv": 1e15, "ng": 1.0}


def propagator_scalars(fits: DataFrame, o: ShoreOptions = ShoreOptions(), micro: bool = True, axis: str | None = None) -> DataFrame:
    """rtop, msd, qiv, ng and, along the unit vector column `axis`, rtap and rtpp; over the signal at the origin.

    NaN where that is 0 or not finite. Weighted sums of the coefficients, but
    for the two along an axis all on the JVM.
    """
    w, nan = N.scalar_weights(o.order, o.zeta), F.lit(float("nan"))
    unit = MICRO if micro else dict.fromkeys(MICRO, 1.0)
    e0, c = F.col("_e0"), F.col("coef")
    df = fits.withColumn("_e0", dot(c, w["e0"]))
    fine = ~F.isnan(e0) & (F.abs(e0) < F.lit(float("inf"))) & (e0 != 0)
    ratio = lambda name: F.try_divide(dot(c, w[name]), e0)
    energy = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    first = F.get(c, F.lit(0)).cast("double")
    out = {
        "rtop": F.greatest(ratio("rtop"), F.lit(0.0)), "msd": F.greatest(ratio("msd"), F.lit(0.0)),
        "qiv": F.when(ratio("q2") > 0, F.try_divide(F.lit(1.0), ratio("q2"))).otherwise(nan),
        "ng": F.when(energy > 0, F.sqrt(F.greatest(1 - F.try_divide(first * first, energy), F.lit(0.0)))).otherwise(0.0),
    }
    cols = [F.when(fine, v * unit[k]).otherwise(nan).alias(k) for k, v in out.items()]
    if axis is None:
        return df.select(*KEY, *cols)
    wa, wp, degrees = (N.axis_weights(o.order, o.zeta, False), N.axis_weights(o.order, o.zeta, True), o.order - o.order % 2)
    at = np.array([N.sh_index(l, m) for _, l, m in N.shore_indices(o.order)])

    def along(coef: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        n = np.linalg.norm(d, axis=1)
        e = coef @ w["e0"]
        ok = (n > 0) & np.isfinite(n) & np.isfinite(e) & (e != 0)
        y = N.sh_matrix(np.where(ok[:, None], d / np.where(ok, n, 1)[:, None], [0, 0, 1.0]), degrees)[:, at]
        value = lambda ws, u: np.where(ok, np.maximum((coef * y * ws).sum(axis=1) / np.where(ok, e, 1), 0) * u, np.nan)
        return {"rtap": value(wa, unit["rtap"]), "rtpp": value(wp, unit["rtpp"])}

    directed = map_rows(fits, ["coef", axis], along, "rtap double, rtpp double")
    return df.select(*KEY, *cols).join(directed, KEY)


def odf(fits: DataFrame, o: ShoreOptions = ShoreOptions()) -> DataFrame:
    """`sh`: harmonic coefficients of each voxel's orientation density."""
    shared = fits.sparkSession.sparkContext.broadcast(N.shore_to_odf(o.order, o.zeta))
    return map_rows(fits, ["coef"], lambda c: {"sh": c @ shared.value.T}, "sh array<double>")


def anisotropic_power(sh: Column, lmax: int, norm: float = 1e-5) -> Column:
    """ln of the mean power by degree (2 and above) over `norm`, 0 where there is none."""
    d = N.sh_degrees(lmax)
    power = sum((F.get(sh, F.lit(k)) ** 2 / float(2 * d[k] + 1) for k in range(len(d)) if d[k] > 0), F.lit(0.0))
    return F.when(power > 0, F.greatest(F.ln(power / norm), F.lit(0.0))).otherwise(0.0)


@dataclass(frozen=True)
class PeakOptions:
    count: int = 5
    relative: float = 0.5
    separation: float = 25.0


def peaks(odfs: DataFrame, lmax: int, o: PeakOptions = PeakOptions(), frequency: int = 8) -> DataFrame:
    """gfa, qa_scale (largest less smallest amplitude) and `fixels`, strongest first: dir, amplitude, qa, dispersion.

    A peak is a direction of a triangulated sphere above its neighbours, moved to the series' own maximum by Newton's steps. Dispersion is the
    integral over its lobe, both ends of it, over its amplitude; a lobe are the directions that lead up to the peak's own.
    """
    dirs = N.hemisphere(frequency)
    edges = N.hemisphere_edges(frequency)
    shared = odfs.sparkSession.sparkContext.broadcast((dirs, N.sh_matrix(dirs, lmax), edges, N.quadrature(dirs), N.SpherePolynomial(lmax)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dirs, y, edges, area, series = shared.value
        limit = np.cos(np.radians(o.separation))
        for b in batches:
            if not len(b):
                continue
            sh = np.stack(b["sh"].to_numpy()).astype(float)
            a = sh @ y.T
            low, high = a.min(axis=1), a.max(axis=1)
            rms = np.sqrt((a**2).mean(axis=1))
            gfa = np.where(rms > 0, a.std(axis=1, ddof=1) / np.where(rms > 0, rms, 1), 0)
            lobe = N.basins(a, edges)
            level = (a[:, edges[:, 0]] == a[:, edges[:, 1]])
            tops = (lobe == np.arange(len(dirs))) & (a > 0) & (a >= o.relative * high[:, None])
            for k in range(2):  # a top stands above all its neighbours
                row, e = np.nonzero(level)
                tops[row, edges[e, k]] = False
            voxel, top = np.nonzero(tops)
            keep = []
            for k, i in sorted(zip(voxel.tolist(), top.tolist()), key=lambda x: (x[0], -a[x])):
                own = [j for v, j in reversed(keep[-o.count :]) if v == k]
                if len(own) < o.count and all(abs(dirs[i] @ dirs[j]) < limit for j in own):
                    keep.append((k, i))
            out: list[list[dict]] = [[] for _ in range(len(a))]
            if keep:
                k, i = np.array(keep).T
                d, amplitude = series.tops(sh[k], dirs[i])
                whole = (np.maximum(a[k], 0) * area * (lobe[k] == i[:, None])).sum(axis=1)
                for n in range(len(k)):
                    out[k[n]].append({"dir": d[n].tolist(), "amplitude": float(amplitude[n]), "qa": float(amplitude[n] - low[k[n]]), "dispersion": float(whole[n] / amplitude[n])})
            yield pd.DataFrame({c: b[c] for c in KEY} | {"gfa": gfa, "qa_scale": high - low, "fixels": out})

    return odfs.select(*KEY, "sh").mapInPandas(find, f"{KEY_SCHEMA}, gfa double, qa_scale double, fixels array<struct<dir array<double>, amplitude double, qa double, dispersion double>>")


def normalised_qa(fixels: DataFrame) -> DataFrame:
    """qa of each fixel over the scan's largest."""
    each = fixels.select(*KEY, F.posexplode("fixels").alias("idx", "f")).select(*KEY, "idx", "f.*")
    top = each.groupBy("scan_id").agg(F.max("qa").alias("top"))
    return each.join(top, "scan_id").withColumn("qa", F.try_divide("qa", "top")).drop("top")


def amplitude_floor(fixels: DataFrame, absolute: float | None = None, fraction: float | None = None) -> DataFrame:
    """Exploded fixels at or above a floor: absolute, or a fraction of the upper median of each voxel's largest amplitude."""
    from lumivox.operators.order_stats import upper_median

    each = fixels.select(*KEY, F.posexplode("fixels").alias("idx", "f")).select(*KEY, "idx", "f.*")
    if absolute is not None:
        return each.where(F.col("amplitude") >= absolute)
    top = fixels.where(F.size("fixels") > 0).select("scan_id", F.array_max(F.transform("fixels", lambda f: f.amplitude)).alias("top"))
    cut = upper_median(top, ["scan_id"], "top")
    return each.join(cut, "scan_id").where(F.col("amplitude") >= (fraction or 0.0) * F.col("median")).drop("median")


def with_options(o: ShoreOptions, **changes) -> ShoreOptions:
    return replace(o, **changes).checked()
