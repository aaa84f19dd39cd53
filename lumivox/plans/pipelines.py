"""Whole runs: quality control, single-shell and dense-b deconvolution, group responses."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.functions import numeric as N
from lumivox.operators import decon, models, qc, tissue
from lumivox.operators import dense as dense_rows
from lumivox.operators.voxel import KEY


@dataclass
class Run:
    tissue: DataFrame
    responses: dict[str, np.ndarray]
    dti: DataFrame
    details: dict = field(default_factory=dict)


def quality_report(voxels: DataFrame, gradient: DataFrame, bvals: np.ndarray, directions: np.ndarray, voxel_mm: tuple[float, float, float] = (1.0, 1.0, 1.0), coherence: bool = True) -> DataFrame:
    dti = models.fit_tensor(voxels, bvals, directions).persist() if coherence else None
    return qc.assess(voxels, gradient, voxel_mm, dti)


def matrix(rows: DataFrame, t: str | None = None) -> np.ndarray:
    """One tissue's response rows as a matrix, in order."""
    got = (rows if t is None else rows.where(F.col("tissue") == t)).orderBy("row").collect()  # a row for each shell or grid point
    return np.array([r.coeffs for r in got], dtype=float)


def shell_responses(selected: tissue.Selection, voxels: DataFrame, dti: DataFrame, groups: list, directions: np.ndarray, lmax: int = 8) -> dict[str, np.ndarray]:
    sv = voxels.select(*KEY, "signal")
    wm = sv.join(selected.wm.select(*KEY), KEY).join(dti.select(*KEY, "principal_dir"), KEY)
    out = {"wm": matrix(tissue.wm_response(wm, groups, directions, lmax))}
    for name, rows in (("gm", selected.gm), ("csf", selected.csf)):
        out[name] = matrix(tissue.isotropic_response(sv.join(rows.select(*KEY), KEY), groups, name))
    return out


def single_shell(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, shape: tuple[int, int, int], selection: tissue.Selection | None = None, o: decon.ShellOptions = decon.ShellOptions(), n: decon.NormaliseOptions = decon.NormaliseOptions(), responses: dict[str, np.ndarray] | None = None) -> Run:
    """Responses from the scan, where none are given, deconvolution, normalisation."""
    groups = N.shells(list(bvals))
    dti, counts = models.fit_tensor(voxels, bvals, directions), {}
    if responses is None:
        dti = dti.persist()
        selection = selection or tissue.select_staged(voxels, dti, N.merge_small_shells(N.shells(list(bvals), 100.0)))
        responses, counts = shell_responses(selection, voxels, dti, groups, directions), selection.counts
    fits = decon.fit_single_shell(voxels, bvals, directions, responses, o).withColumn("wm0", F.get("wm", F.lit(0))).withColumn("in_mask", F.lit(True))
    return Run(decon.normalise(fits, ["wm0", "gm", "csf"], shape, n), responses, dti, counts)


def dense_responses(selected: tissue.Selection, voxels: DataFrame, dti: DataFrame, bvals: np.ndarray, directions: np.ndarray, estimator: str = "kernel", lmax: int = 8, step: float = 50.0, b_max: float | None = None) -> dict[str, np.ndarray]:
    """One scan's rows on the b grid for the three tissues, all over its white matter's reference signal."""
    rows = dense_rows.responses(dense_rows.union_of(selected, voxels, dti), bvals, directions, estimator, lmax, step, b_max).persist()
    out = {t: matrix(rows, t) for t in ("wm", "gm", "csf")}
    rows.unpersist()
    if not all(len(v) for v in out.values()):
        raise ValueError("response estimation: no unweighted signal to scale by, or no voxel of a tissue")
    return out


def dense(voxels: DataFrame, bvals: np.ndarray, directions: np.ndarray, shape: tuple[int, int, int], selection: tissue.Selection | None = None, estimator: str | None = None, o: decon.DenseOptions = decon.DenseOptions(), n: decon.NormaliseOptions = decon.NormaliseOptions(), responses: dict[str, np.ndarray] | None = None, reference: DataFrame | None = None) -> Run:
    """The same along a dense b axis, with the reference unweighted signal and the floor corrected.

    reference: voxels (key) over which the reference is taken; else it is taken over the white matter that responses came from or, where they
    are given, over voxels of mostly white matter.
    """
    dti, counts = models.fit_tensor(voxels, bvals, directions), {}
    if responses is None:
        dti = dti.persist()
        selection = selection or tissue.select_staged(voxels, dti, N.merge_small_shells(N.shells(list(bvals), 100.0)))
        moved = dense_rows.b_shift(voxels, bvals, directions).first() if "graddev" in voxels.columns else None
        estimator = estimator or tissue.choose_estimator(moved.shift if moved else None, interpolate=o.interpolate)
        responses = dense_responses(selection, voxels, dti, bvals, directions, estimator, o.lmax, o.step, moved.largest if moved else None)
        counts = selection.counts | {"estimator": estimator}
    fits = decon.fit_dense(voxels, bvals, directions, responses, o).withColumn("wm0", F.get("wm", F.lit(0))).withColumn("in_mask", F.lit(True))
    level = decon.normalise(fits, ["wm0", "gm", "csf"], shape, n)
    total = F.col("wm0") + F.col("gm") + F.col("csf")
    masks = {"user mask": reference, "single-fibre white matter": selection.wm if selection else None, "white matter fraction": fits.where((total > 1e-9) & (F.col("wm0") / total >= 0.7))}
    found = decon.reference_b0(voxels, bvals, masks)
    return Run(decon.floor_corrected(level), responses, dti, counts | ({"reference_b0": found[0], "reference_b0_source": found[1]} if found else {"reference_b0": None}))


def group_responses(responses: DataFrame, statistic: str = "mean") -> tuple[DataFrame, DataFrame]:
    """Pooled rows across scans and each scan's deviation from them."""
    bad = tissue.pool_faults(responses).count()
    if bad:
        raise ValueError(f"{bad} tissues can't be pooled")
    pooled = tissue.pool(responses, statistic)
    return pooled, tissue.deviation_percent(responses, pooled)
