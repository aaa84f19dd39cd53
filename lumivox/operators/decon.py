"""Constrained spherical deconvolution, by shells or along a dense b axis, and intensity normalisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.functions import numeric as N
from lumivox.operators import order_stats as O
from lumivox.operators import solvers
from lumivox.operators.levels import Level, NormaliseOptions, fit_level, fit_levels, normalise  # noqa: F401  normalisation belongs to deconvolution
from lumivox.operators.models import effective_table, effective_table_column, map_rows
from lumivox.operators.voxel import KEY, is_finite

SQRT4PI = float(np.sqrt(4 * np.pi))


def wm_columns(directions: np.ndarray, rows: np.ndarray, lmax: int) -> np.ndarray:
    """Forward columns of the orientation density: harmonics at each direction times the zonal response of its row."""
    degree = N.sh_degrees(lmax)
    zonal = np.zeros((len(rows), lmax // 2 + 1))
    width = min(rows.shape[1], zonal.shape[1])
    zonal[:, :width] = rows[:, :width]
    return N.sh_matrix(directions, lmax) * zonal[:, degree // 2] * N.zonal_factor(lmax)


def interpolate_rows(rows: np.ndarray, b: np.ndarray, step: float, linear: bool = False) -> np.ndarray:
    """Response rows at b from those at k * step: the nearest one, or linear between two."""
    at = np.clip(np.asarray(b, dtype=float) / step, 0, len(rows) - 1)
    if not linear:
        return rows[np.floor(at + 0.5).astype(int).clip(0, len(rows) - 1)]
    k = np.minimum(np.floor(at).astype(int), max(len(rows) - 2, 0))
    t = (at - k)[:, None]
    return (1 - t) * rows[k] + t * rows[np.minimum(k + 1, len(rows) - 1)]


def non_negative(extra: int, lmax: int) -> np.ndarray:
    """Constraint rows: `extra` leading coefficients and the density's amplitudes over the hemisphere."""
    y = N.sh_matrix(N.hemisphere(), lmax)
    return np.block([[np.eye(extra), np.zeros((extra, y.shape[1]))], [np.zeros((len(y), extra)), y]])


@dataclass(frozen=True)
class ShellOptions:
    rounds: int = 3
    bzero_percent: float = 10.0
    lmax: int | None = 8  # None: by the criterion, from the candidates
    candidates: tuple[int, ...] = (0, 2, 4, 6, 8)


@dataclass
class ShellPlan:
    weight: np.ndarray
    wm: np.ndarray
    gm: np.ndarray
    csf: np.ndarray
    with_wm: solvers.Inequality
    without: solvers.Inequality
    lmax: int


def shell_plan(bvals: np.ndarray, directions: np.ndarray, responses: dict[str, np.ndarray], o: ShellOptions, lmax: int) -> ShellPlan:
    """Matrices for one unweighted and one weighted shell; unweighted rows count for bzero_percent of the others together."""
    groups = N.shells(list(bvals))
    if len(groups) != 2 or groups[0][0] != 0:
        raise ValueError("one unweighted and one weighted shell are needed")
    if o.rounds < 2 or o.bzero_percent <= 0 or lmax % 2:
        raise ValueError("two rounds at least, a positive percentage and an even order are needed")
    lmax = min(lmax, 2 * (responses["wm"].shape[1] - 1))
    row = np.zeros(len(bvals), dtype=int)
    row[groups[1][1]] = 1
    weight = np.where(row == 0, np.sqrt(len(groups[1][1]) * o.bzero_percent / (100 * len(groups[0][1]))), 1.0)
    wm = weight[:, None] * wm_columns(np.where(row[:, None] == 0, [0, 0, 1.0], directions), responses["wm"][row], lmax)
    gm, csf = (weight * responses[t][row, 0] for t in ("gm", "csf"))
    h = np.column_stack([gm, wm])
    return ShellPlan(weight, wm, gm, csf, solvers.Inequality(h, non_negative(1, lmax), max_iter=2000, tol=1e-9), solvers.Inequality(np.column_stack([gm, csf]), np.eye(2)), lmax)


def _shell_fit(p: ShellPlan, s: np.ndarray, rounds: int) -> dict[str, np.ndarray]:
    s = s * p.weight
    two, used, ok = p.without.solve(s)
    gm, csf, wm = two[:, 0], two[:, 1], np.zeros((len(s), p.wm.shape[1]))
    for _ in range(rounds):
        x, k, fine = p.with_wm.solve(s - csf[:, None] * p.csf)
        wm, used, ok = x[:, 1:], used + k, ok & fine
        two, k, fine = p.without.solve(s - wm @ p.wm.T)
        gm, csf, used, ok = two[:, 0], two[:, 1], used + k, ok & fine
    rss = np.sum((s - wm @ p.wm.T - gm[:, None] * p.gm - csf[:, None] * p.csf) ** 2, axis=1)
    return {"wm": wm, "gm": gm, "csf": csf, "iterations": used, "converged": ok, "residual_l2": np.sqrt(rss), "rss": rss}


TISSUE = "wm array<float>, gm float, csf float, floor float, iterations int, converged boolean, residual_l2 float, chosen_lmax tinyint, bic float"


def fit_single_shell(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, responses: dict[str, np.ndarray], o: ShellOptions = ShellOptions()) -> DataFrame:
    """White matter density, grey matter and fluid from one shell, fitted in turns; the order fixed or, by voxel, the one of least criterion."""
    orders = [o.lmax] if o.lmax is not None else list(o.candidates)
    shared = voxels.sparkSession.sparkContext.broadcast([shell_plan(bvals, directions, responses, o, l) for l in orders])

    def fit(s: np.ndarray) -> dict[str, np.ndarray]:
        width = max(p.wm.shape[1] for p in shared.value)
        best: dict[str, np.ndarray] = {}
        for order, p in zip(orders, shared.value):
            r = _shell_fit(p, s, o.rounds)
            r["wm"] = np.pad(r["wm"], ((0, 0), (0, width - r["wm"].shape[1])))
            k = np.full(len(s), p.wm.shape[1] + 2)
            r["bic"] = np.where(r["rss"] > 0, solvers.bic(r["rss"], s.shape[1], k), -np.inf)
            r |= {"chosen_lmax": np.full(len(s), order, np.int8), "floor": np.zeros(len(s))}
            if not best:
                best = r
            else:
                better = r["bic"] < best["bic"]
                for n in best:
                    best[n] = np.where(better[:, None] if best[n].ndim > 1 else better, r[n], best[n])
        return best

    return map_rows(voxels.where("in_mask"), ["signal"], fit, TISSUE)


@dataclass(frozen=True)
class DenseOptions:
    """ridge_path: weights tried in turn, as multiples of the largest diagonal if relative; quantitative: results scaled back by the unweighted signal."""

    lmax: int = 8
    step: float = 50.0
    floor: bool = True
    quantitative: bool = True
    interpolate: bool = False
    ridge_path: tuple[float, ...] = ()
    relative: bool = False
    slack: float = 0.05
    max_iter: int = 2000


def dense_matrix(bvals: np.ndarray, directions: np.ndarray, responses: dict[str, np.ndarray], o: DenseOptions) -> np.ndarray:
    """Columns csf, gm, the noise floor if wanted, and the density."""
    rows = {t: interpolate_rows(r, bvals, o.step, o.interpolate) for t, r in responses.items()}
    unit = np.where(np.linalg.norm(directions, axis=1)[:, None] > 0, directions, [0, 0, 1.0])
    parts = [rows["csf"][:, :1], rows["gm"][:, :1], *([np.full((len(bvals), 1), 1.0)] if o.floor else []), wm_columns(unit, rows["wm"], o.lmax)]
    return np.hstack(parts)


def _dense_solvers(h: np.ndarray, o: DenseOptions) -> list[solvers.Inequality]:
    extra = 3 if o.floor else 2
    c = non_negative(extra, o.lmax)
    degree = N.sh_degrees(o.lmax)
    shape = np.concatenate([np.zeros(extra), (degree * (degree + 1.0)) ** 2 / max(1.0, (o.lmax * (o.lmax + 1.0)) ** 2)])
    scale = np.diag(h.T @ h).max() if o.relative else 1.0
    return [solvers.Inequality(h, c, ridge=r * scale * shape, max_iter=o.max_iter, tol=1e-9) for r in (o.ridge_path or (0.0,))]


def fit_dense(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, responses: dict[str, np.ndarray], o: DenseOptions = DenseOptions()) -> DataFrame:
    """Three tissues and a noise floor in one constrained fit along the whole b axis, of the signal over its unweighted mean.

    responses: rows on the grid k * step, with a unit unweighted signal. Along a
    ridge path the last weight within 1 + slack of the first one's residual is
    taken. Voxels without unweighted signal get zeros. A column `graddev` (9
    numbers) makes a voxel's own table; voxels at identity share the plan.
    """
    if o.lmax % 2:
        raise ValueError("the order must be even")
    if len({round(b) for b in np.where(bvals <= 50, 0, bvals)}) < 3:
        raise ValueError("three b-values, zero included, are needed")
    if not 0.2 <= responses["wm"][0, 0] / SQRT4PI <= 5:
        raise ValueError("responses must have an unweighted signal of about 1")
    if (len(responses["wm"]) - 1) * o.step + o.step / 2 < bvals.max():
        raise ValueError("the responses end before the largest b-value")
    h = dense_matrix(bvals, directions, responses, o)
    shared = voxels.sparkSession.sparkContext.broadcast((h, _dense_solvers(h, o)))
    b0, extra = np.flatnonzero(bvals <= 50), 3 if o.floor else 2

    def block(s: np.ndarray, h: np.ndarray, path: list[solvers.Inequality]) -> dict[str, np.ndarray]:
        s0 = s[:, b0].mean(axis=1)
        y = np.where(s0[:, None] > 0, s / np.where(s0 > 0, s0, 1)[:, None], 0)
        x, used, ok = path[0].solve(y)
        first = rss = np.sum((y - x @ h.T) ** 2, axis=1)
        going = np.ones(len(s), bool)
        for q in path[1:]:
            x2, k, fine = q.solve(y)
            r2 = np.sum((y - x2 @ h.T) ** 2, axis=1)
            going &= r2 <= (1 + o.slack) * first
            x, rss, ok = np.where(going[:, None], x2, x), np.where(going, r2, rss), np.where(going, fine, ok)
            used = used + k
        x = x * (np.where(s0 > 0, s0, 0)[:, None] if o.quantitative else (s0 > 0)[:, None])
        return {"wm": x[:, extra:], "csf": x[:, 0], "gm": x[:, 1], "floor": x[:, 2] if o.floor else np.zeros(len(x)), "iterations": used, "converged": ok, "residual_l2": np.sqrt(rss), "chosen_lmax": np.full(len(x), o.lmax, np.int8), "bic": np.full(len(x), np.nan)}

    def fit(s: np.ndarray, t: np.ndarray | None = None) -> dict[str, np.ndarray]:
        h, path = shared.value
        if t is None:
            return block(s, h, path)
        own = np.abs(t - np.eye(3).ravel()).max(axis=1) > 1e-6
        out = block(s, h, path)
        for k in np.flatnonzero(own):
            b, g = effective_table(bvals, directions, t[k].reshape(3, 3))
            hk = dense_matrix(b, g, responses, o)
            r = block(s[[k]], hk, _dense_solvers(hk, o))
            for n in out:
                out[n][k] = r[n][0]
        return out

    columns = ["signal", "graddev"] if "graddev" in voxels.columns else ["signal"]
    return map_rows(voxels.where("in_mask"), columns, fit, TISSUE)


def graddev_table(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """KEY, vol, b_eff and direction that each voxel sees through its `graddev`, on the JVM; rotation: of effective_table()."""
    each = voxels.select(*KEY, F.explode(effective_table_column(F.col("graddev"), bvals, directions, rotation)).alias("t"))
    return each.select(*KEY, "t.vol", F.col("t.b").alias("b_eff"), F.col("t.g").alias("direction"))


def reference_b0(voxels: DataFrame, bvals: np.ndarray, masks: dict[str, DataFrame | None]) -> tuple[float, str] | None:
    """Upper median of the positive mean unweighted signals over the first of the named masks that has any, and that mask's name."""
    at = [int(v) for v in np.flatnonzero(bvals <= 50)]
    b0 = voxels.select(*KEY, (sum((F.get("signal", F.lit(v)).cast("double") for v in at), F.lit(0.0)) / float(len(at))).alias("b0")).where("b0 > 0")
    for name, m in masks.items():
        r = None if m is None else O.upper_median(b0.join(m.select(*KEY), KEY).withColumn("all", F.lit(1)), ["all"], "b0").first()
        if r is not None:
            return r.median, name
    return None


def floor_corrected(tissue: DataFrame) -> DataFrame:
    """The noise floor over the field, where that is positive and the voxel is in the mask."""
    return tissue.withColumn("floor", F.when(F.col("in_mask") & (F.col("field") > 0), F.col("floor") / F.col("field")).otherwise(0.0))
